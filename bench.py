"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import decisions  # noqa: E402
from quotecurve.operators import choose, curve, elasticity, prepare, report, tuning  # noqa: E402
from quotecurve.plans import extract, review  # noqa: E402
from quotecurve.session import build_session, materialise  # noqa: E402
from quotecurve.sources import retail  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    run(spark.range(1000))  # start the executors
    seconds: dict[str, float] = {}

    def timed(name: str, job):
        start = time.time()
        result = job()
        seconds[name] = round(time.time() - start, 3)
        return result

    inputs = extract.retail_inputs(spark, folder)
    history = extract.whole_history()
    items = retail.products(spark, folder)

    # from the raw tables
    timed("base_orders", lambda: run(extract.orders_in_scope(inputs, history)))
    timed("promotion_calendar", lambda: run(extract.promotion_calendar(inputs, history)[1]))
    sales = timed("sales_extract", lambda: materialise(extract.sales_input(spark, folder), "sales"))
    # from the extracted sales
    weekly = timed(
        "weekly_sales", lambda: materialise(prepare.roll_up(prepare.with_products(sales, items)), "weekly")
    )
    thick = prepare.drop_thin_periods(weekly)
    timed("price_quantity", lambda: run(prepare.price_quantity(prepare.drop_thin_periods(prepare.keep_top_products(weekly)))))
    timed("elasticity", lambda: run(elasticity.elasticity_table(thick)))
    rows = timed("model_rows", lambda: materialise(review.model_rows(thick), "rows"))
    observed = timed(
        "support_counts", lambda: materialise(choose.with_support(decisions.observed_curve(thick)), "observed")
    )
    timed("price_choice", lambda: run(choose.choose_prices(observed)))
    best = choose.best_expected(observed)
    timed("opportunities", lambda: run(report.opportunity_summary(best, observed, report.current_prices(items))))
    timed("search", lambda: run(tuning.tune(rows)))
    fitted = timed("fit_all_products", lambda: materialise(curve.fit_curves(rows), "models"))
    timed("score_all_rows", lambda: run(curve.score_curves(rows, fitted)))

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
