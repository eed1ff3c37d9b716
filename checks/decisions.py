"""Checks of price choice and reports, on observed revenue with bands of 20 %."""

from functools import lru_cache

from pyspark.sql import functions as F

from quotecurve.functions import text
from quotecurve.operators import choose as ch
from quotecurve.operators import elasticity as ela
from quotecurve.operators import prepare as prep
from quotecurve.operators import report as rep
from quotecurve.operators import shape as shp
from quotecurve.sources import retail

from .base import compose, cte
from .sold import prepared_rows, sales, thick_rows
from . import weighting  # noqa: F401  (defines subqueries used here)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ["product", "item_id", "period_start", "event_name"]
KEYS = "product, item_id, period_start, event_name"


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return add


def observed_curve(rows):
    """Observed revenue standing in for the expected curve, with bands of 20 %."""
    revenue, units = F.col("revenue").cast("double"), F.col("shipped_units").cast("double")
    price = F.col("price").cast("double")
    return rows.select(
        *KEY,
        price.alias("price"),
        price.alias("asp"),
        revenue.alias("revenue_actual"),
        (F.lit(0.8) * units).alias("units_p025"),
        units.alias("units_p50"),
        (F.lit(1.2) * units).alias("units_p975"),
        (F.lit(0.8) * revenue).alias("revenue_p025"),
        revenue.alias("revenue_p50"),
        (F.lit(1.2) * revenue).alias("revenue_p975"),
    )


@lru_cache
def curve(spark, folder):
    return ch.with_support(observed_curve(thick_rows(spark, folder)))


@lru_cache
def best(spark, folder):
    return ch.best_expected(curve(spark, folder))


# A mean of cents can lie exactly between two roundings; its root does not, so means are
# compared by square or cube root.
def rooted(df):
    return df.withColumn("value", F.round(F.sqrt("value"), 6))


def rounded(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


cte("gaps", "SELECT product, cents, cents - lag(cents) OVER (PARTITION BY product ORDER BY cents) AS gap FROM spots")
cte(
    "steps",
    """SELECT product, coalesce(quantile_cont(gap::DOUBLE, 0.5), 25.0) AS step, coalesce(quantile_cont(gap::DOUBLE, 0.5), 25.0) * 1.25 AS win
FROM gaps GROUP BY product""",
)
cte(
    "support",
    """SELECT q.product, q.cents, CAST(sum(r.n) AS BIGINT) AS support_count
FROM spots q JOIN spots r USING (product) JOIN steps s USING (product) WHERE abs(q.cents - r.cents) <= s.win GROUP BY ALL""",
)
cte(
    "curve",
    """
SELECT t.product, t.item_id, t.period_start, t.event_name, t.cents, t.cents / 100.0::DOUBLE AS price, t.cents / 100.0::DOUBLE AS asp,
       rev AS revenue_actual, 0.8::DOUBLE * units AS units_p025, units AS units_p50, 1.2::DOUBLE * units AS units_p975,
       0.8::DOUBLE * rev AS revenue_p025, rev AS revenue_p50, 1.2::DOUBLE * rev AS revenue_p975, s.support_count,
       0.7::DOUBLE * rev + 0.3::DOUBLE * (0.8::DOUBLE * rev) AS score
FROM (SELECT *, revenue_cents / 100.0::DOUBLE AS rev, shipped_units::DOUBLE AS units FROM thick) t JOIN support s USING (product, cents)
""",
)
cte(
    "mean_points",
    "SELECT product, price, avg(score) AS value FROM curve WHERE score > 0 AND support_count >= 4 GROUP BY product, price",
)
cte(
    "slopes_at",
    """
SELECT *, count(*) OVER (PARTITION BY product) AS points,
       (coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value))
       / CASE WHEN coalesce(lead(price) OVER w, price) = coalesce(lag(price) OVER w, price) THEN 1e-6
              ELSE coalesce(lead(price) OVER w, price) - coalesce(lag(price) OVER w, price) END AS slope
FROM mean_points WINDOW w AS (PARTITION BY product ORDER BY price)
""",
)
cte("stable", "SELECT product, price, value FROM slopes_at WHERE points < 2 OR abs(slope) < 5000")
cte(
    "front",
    """SELECT * FROM stable a WHERE NOT EXISTS (SELECT 1 FROM stable b WHERE b.product = a.product AND b.price > a.price AND b.value >= a.value)""",
)
cte(
    "front_price",
    """SELECT product, max(price) AS price FROM (SELECT *, max(value) OVER (PARTITION BY product) AS top FROM front)
WHERE value >= 0.9::DOUBLE * top GROUP BY product""",
)
cte(
    "best50",
    """SELECT product, item_id, price, asp, units_p50, revenue_p50, support_count FROM (
SELECT *, row_number() OVER (PARTITION BY product ORDER BY (support_count >= 6) DESC, revenue_p50 DESC, price, item_id, period_start, event_name) AS rn
FROM curve) WHERE rn = 1""",
)
cte(
    "price_rows",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, asp ORDER BY revenue_p50 DESC, item_id, period_start, event_name) AS rn
FROM curve) WHERE rn = 1""",
)
cte("current_prices", "SELECT item_id, min(current_cents) / 100.0::DOUBLE AS current_price FROM products GROUP BY item_id")
cte(
    "product_prices",
    """SELECT product, min(current_cents) / 100.0::DOUBLE AS current_price FROM labelled GROUP BY product""",
)
cte(
    "opportunity",
    """
SELECT b.product, b.item_id, c.current_price, b.price AS best_price, b.units_p50 AS units_best, n.units_p50 AS units_curr,
       b.revenue_p50 AS revenue_best, n.revenue_p50 AS revenue_curr, b.units_p50 - n.units_p50 AS delta_units,
       b.revenue_p50 - n.revenue_p50 AS delta_revenue
FROM best50 b LEFT JOIN current_prices c USING (item_id)
LEFT JOIN LATERAL (SELECT * FROM price_rows p WHERE p.product = b.product ORDER BY abs(p.asp - c.current_price), p.asp LIMIT 1) n ON true
""",
)
cte(
    "item_rows",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, asp ORDER BY revenue_p50 DESC, period_start, event_name) AS rn
FROM curve) WHERE rn = 1""",
)
cte(
    "deltas",
    """
SELECT b.item_id, (x.units_p50 - y.units_p50) * 365.0::DOUBLE AS du, (x.revenue_p50 - y.revenue_p50) * 365.0::DOUBLE AS dr
FROM (SELECT item_id, min(asp) AS asp FROM best50 GROUP BY item_id) b JOIN current_prices c USING (item_id)
JOIN LATERAL (SELECT * FROM item_rows p WHERE p.item_id = b.item_id ORDER BY abs(p.asp - b.asp), p.asp LIMIT 1) x ON true
JOIN LATERAL (SELECT * FROM item_rows p WHERE p.item_id = b.item_id ORDER BY abs(p.asp - c.current_price), p.asp LIMIT 1) y ON true
""",
)


@check("w09_price_step", 'SELECT product, step, win AS "window" FROM steps')
def price_step(spark, folder):
    from quotecurve.operators.weights import price_counts

    return ch.price_steps(price_counts(thick_rows(spark, folder)))


@check("w14_support_counts", f"SELECT {KEYS}, support_count FROM curve")
def support_counts(spark, folder):
    return curve(spark, folder).select(*KEY, "support_count")


@check("j17_observations_in_window", "SELECT product, cents, support_count FROM support")
def in_window(spark, folder):
    return ch.support_table(thick_rows(spark, folder))


@check("c09_risk_adjusted_revenue", f"SELECT {KEYS}, round(score, 4) AS score FROM curve")
def score(spark, folder):
    return rounded(ch.with_score(curve(spark, folder)).select(*KEY, "score"), score=4)


@check("f11_positive_scores", "SELECT product, count(*) AS n FROM curve WHERE score > 0 GROUP BY product")
def positive(spark, folder):
    return ch.positive_scores(curve(spark, folder)).groupBy("product").agg(F.count(F.lit(1)).alias("n"))


@check(
    "a19_mean_score_by_price",
    "SELECT product, price, round(sqrt(avg(score)), 6) AS value FROM curve GROUP BY product, price",
)
def mean_scores(spark, folder):
    return rooted(ch.price_means(ch.with_score(curve(spark, folder))))


def _points(spark, folder):
    rows = ch.positive_scores(curve(spark, folder)).where(F.col("support_count") >= 4)
    return ch.price_means(rows)


@check("w06_marginal_revenue", "SELECT product, price, round(cbrt(slope), 5) AS slope FROM slopes_at")
def marginal(spark, folder):
    rows = ch.marginal_revenue(_points(spark, folder))
    return rows.select("product", "price", F.round(F.cbrt("slope"), 5).alias("slope"))


@check("w06_stable_points", "SELECT product, price, round(sqrt(value), 6) AS value FROM stable")
def stable(spark, folder):
    return rooted(ch.stable_points(_points(spark, folder)))


@check("w07_price_frontier", "SELECT product, price, round(sqrt(value), 6) AS value FROM front")
def price_frontier(spark, folder):
    return rooted(ch.frontier(ch.stable_points(_points(spark, folder))))


@check(
    "j21_dominated_points",
    """SELECT product, count(*) AS dominated FROM mean_points a WHERE EXISTS
(SELECT 1 FROM mean_points b WHERE b.product = a.product AND b.price > a.price AND b.value >= a.value) GROUP BY product""",
)
def dominated(spark, folder):
    points = _points(spark, folder)
    lost = points.join(ch.frontier(points).select("product", "price"), ["product", "price"], "left_anti")
    return lost.groupBy("product").agg(F.count(F.lit(1)).alias("dominated"))


@check("w08_frontier_price", "SELECT product, price FROM front_price")
def frontier_price(spark, folder):
    return ch.frontier_price(ch.frontier(ch.stable_points(_points(spark, folder))))


_CHOSEN = f"""
SELECT {KEYS}, price, round(score, 4) AS score FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.product
           ORDER BY revenue_p50 DESC, c.item_id, period_start, event_name) AS rn
  FROM curve c JOIN front_price f ON f.product = c.product AND f.price = c.price WHERE score > 0) WHERE rn = 1
UNION ALL
SELECT {KEYS}, price, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY support_count DESC, price, item_id, period_start, event_name) AS rn
  FROM curve WHERE score > 0 AND product NOT IN (SELECT product FROM front_price)) WHERE rn = 1"""


@check("m08_chosen_prices", _CHOSEN)
def chosen(spark, folder):
    return rounded(ch.choose_prices(curve(spark, folder)).select(*KEY, "price", "score"), score=4)


@check(
    "j16_rows_at_chosen_price",
    f"""SELECT {KEYS}, price, revenue_p50 FROM (SELECT c.*, row_number() OVER (PARTITION BY c.product
ORDER BY revenue_p50 DESC, c.item_id, period_start, event_name) AS rn FROM curve c JOIN front_price f USING (product, price)) WHERE rn = 1""",
)
def rows_at_choice(spark, folder):
    price = ch.frontier_price(ch.frontier(ch.stable_points(_points(spark, folder))))
    rows = ch.rows_at_price(curve(spark, folder)).join(price, ["product", "price"], "left_semi")
    return rows.select(*KEY, "price", "revenue_p50")


@check(
    "a20_best_row_by_product",
    f"""SELECT {KEYS}, price, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY product
ORDER BY score DESC, price, item_id, period_start, event_name) AS rn FROM curve WHERE score > 0) WHERE rn = 1""",
)
def best_by_product(spark, folder):
    return rounded(ch.highest_score(curve(spark, folder)).select(*KEY, "price", "score"), score=4)


@check("w12_best_expected_rows", "SELECT * FROM best50")
def best_rows(spark, folder):
    return best(spark, folder)


@check("u02_best_rows_by_tiers", "SELECT * FROM best50")
def best_tiers(spark, folder):
    return ch.best_expected_by_tiers(curve(spark, folder))


@check(
    "j12_products_without_support",
    """SELECT DISTINCT product FROM curve WHERE product NOT IN (SELECT product FROM curve WHERE support_count >= 40)""",
)
def uncovered(spark, folder):
    rows = curve(spark, folder)
    return ch.not_covered(rows, rows.where(F.col("support_count") >= 40)).select("product").distinct()


@check(
    "j13_nearest_price_row",
    """SELECT p.product, n.asp, n.revenue_p50 FROM product_prices p
JOIN LATERAL (SELECT * FROM price_rows r WHERE r.product = p.product ORDER BY abs(r.asp - p.current_price), r.asp LIMIT 1) n ON true""",
)
def nearest(spark, folder):
    labels = prep.with_products(sales(spark, folder), retail.products(spark, folder))
    wanted = labels.groupBy("product").agg(F.min("current_price").cast("double").alias("wanted_price"))
    return ch.nearest_rows(curve(spark, folder), wanted).select("product", "asp", "revenue_p50")


@check(
    "j14_predictions_with_actuals",
    f"""SELECT {', '.join('c.' + k for k in KEY)}, round(t.cents / 100.0::DOUBLE * t.shipped_units, 4) AS revenue_actual,
round(t.cents / 100.0::DOUBLE * (1 - coalesce(t.deal_discount_percent, 0) / 100.0::DOUBLE) * t.shipped_units, 4) AS actual_revenue_scaled
FROM prepared c JOIN prepared t ON t.product = c.product AND t.cents = c.cents""",
)
def with_actuals(spark, folder):
    rows = prepared_rows(spark, folder)
    bare = observed_curve(rows).drop("revenue_actual")
    out = rep.with_actuals(bare, rows, fan_out=True)
    return rounded(out.select(*KEY, "revenue_actual", "actual_revenue_scaled"), revenue_actual=4, actual_revenue_scaled=4)


@check(
    "j14_predictions_with_summed_actuals",
    f"""SELECT {', '.join('c.' + k for k in KEY)}, round(t.revenue, 4) AS revenue_actual, round(t.units, 4) AS units_actual,
round(t.scaled, 3) AS actual_revenue_scaled
FROM prepared c JOIN (SELECT product, cents, sum(cents / 100.0::DOUBLE * shipped_units) AS revenue, sum(shipped_units)::DOUBLE AS units,
  sum(cents / 100.0::DOUBLE * (1 - greatest(coalesce(deal_discount_percent, 0), 0) / 100.0::DOUBLE) * shipped_units) AS scaled
  FROM prepared GROUP BY product, cents) t USING (product, cents)""",
)
def with_summed_actuals(spark, folder):
    rows = prepared_rows(spark, folder)
    out = rep.with_actuals(observed_curve(rows).drop("revenue_actual"), rows)
    out = out.select(*KEY, "revenue_actual", "units_actual", "actual_revenue_scaled")
    return rounded(out, revenue_actual=4, units_actual=4, actual_revenue_scaled=3)


@check(
    "j15_item_lookup_texts",
    """SELECT b.item_id, b.product, '$' || format('{:,.2f}', c.current_price) AS current_price, '$' || format('{:,.2f}', b.asp) AS recommended_price
FROM best50 b LEFT JOIN current_prices c USING (item_id)""",
)
def lookup_texts(spark, folder):
    current = rep.current_prices(retail.products(spark, folder))
    rows = best(spark, folder).join(current, "item_id", "left")
    return rows.select(
        "item_id",
        "product",
        text.money_text(F.col("current_price"), 2).alias("current_price"),
        text.money_text(F.col("asp"), 2).alias("recommended_price"),
    )


@check(
    "f13_curve_schema",
    f"SELECT {KEYS}, asp, revenue_actual, revenue_p025, revenue_p50, revenue_p975 FROM curve",
)
def curve_schema(spark, folder):
    old = curve(spark, folder).drop("asp").withColumnsRenamed(
        {"revenue_p50": "rev_p50", "revenue_p025": "revenue_pred_p025", "revenue_p975": "revenue_pred_0.975", "revenue_actual": "revenue"}
    )
    return rep.normalise_curve(old).select(*KEY, *rep.CURVE_COLUMNS[1:])


@check(
    "f14_sanitised_predictions",
    f"""SELECT {KEYS}, greatest(coalesce(CASE WHEN units_p50 > 100 THEN NULL ELSE revenue_p50 - 20000 END, 0.0::DOUBLE), 0.0::DOUBLE) AS revenue_p50 FROM curve""",
)
def sanitised(spark, folder):
    raw = F.when(F.col("units_p50") <= 100, F.col("revenue_p50") - 20000)
    rows = curve(spark, folder).select(*KEY, raw.alias("revenue_p50"))
    return rep.sanitise_predictions(rows)


@check("f16_report_columns", "SELECT item_id, product, asp, revenue_actual, revenue_p025, revenue_p50, revenue_p975, units_p025, units_p50, units_p975 FROM curve")
def report_columns(spark, folder):
    return rep.ordered_columns(curve(spark, folder))


@check(
    "f18_baseline_and_promotion",
    "SELECT product, CASE WHEN event_name IS NOT NULL AND event_name <> 'BAU' THEN 'promotion' ELSE 'baseline' END AS kind, count(*) AS n FROM curve GROUP BY ALL",
)
def kinds(spark, folder):
    return rep.curve_frame(curve(spark, folder)).groupBy("product", "kind").agg(F.count(F.lit(1)).alias("n"))


_NOISY = "(SELECT *, revenue_p50 * (1 + (units_p50 - 50) / 500.0::DOUBLE) AS predicted FROM curve)"


def noisy(spark, folder):
    """Expected revenue moved away from the actual one, so that errors are not zero."""
    factor = F.lit(1) + (F.col("units_p50") - 50) / F.lit(500.0)
    return curve(spark, folder).withColumn("revenue_p50", F.col("revenue_p50") * factor)


@check(
    "a16_fit_quality",
    f"""SELECT round(sum((predicted - revenue_actual) / revenue_actual * revenue_actual) / sum(revenue_actual), 8) AS pct_diff_p50,
round(sum((asp * units_p50 * 1.1::DOUBLE - revenue_actual) / revenue_actual * revenue_actual) / sum(revenue_actual), 8) AS pct_diff_weighted
FROM {_NOISY} WHERE revenue_actual > 0""",
)
def fit_quality(spark, folder):
    rows = noisy(spark, folder).withColumn("weighted_pred", F.col("units_p50") * 1.1)
    return rounded(rep.fit_quality(rows), pct_diff_p50=8, pct_diff_weighted=8)


@check(
    "a17_fit_card",
    f"""SELECT item_id, round(sqrt(avg(pow(p - a, 2))), 4) AS rmse,
round(sum(CASE WHEN a > 0 THEN (p - a) / a * a END) / sum(CASE WHEN a > 0 THEN a END), 7) AS relative_error
FROM (SELECT item_id, asp, avg(revenue_actual) AS a, avg(predicted) AS p FROM {_NOISY} GROUP BY item_id, asp) GROUP BY item_id""",
)
def fit_card(spark, folder):
    return rounded(rep.fit_card(noisy(spark, folder)), rmse=4, relative_error=7)


@check(
    "a18_band_coverage",
    f"""SELECT item_id, count(*) AS points, round(avg((a BETWEEN revenue_p025 AND revenue_p975)::INT), 9) AS coverage
FROM (SELECT *, predicted AS a FROM {_NOISY}) GROUP BY item_id""",
)
def band_coverage(spark, folder):
    rows = noisy(spark, folder).withColumn("revenue_actual", F.col("revenue_p50"))
    return rounded(rep.band_coverage(rows), coverage=9)


@check(
    "a14_weighted_squared_error",
    f"""SELECT round(sum(support_count * pow((predicted - revenue_actual) / 1000, 2)) / sum(support_count), 6) AS loss FROM {_NOISY}""",
)
def squared_error(spark, folder):
    rows = noisy(spark, folder).select(
        (F.col("revenue_p50") / 1000).alias("p"), (F.col("revenue_actual") / 1000).alias("a"), "support_count"
    )
    return rounded(rep.weighted_squared_error(rows, "a", "p", "support_count"), loss=6)


_OPP = ", ".join(
    f"round({c} * 365.0::DOUBLE, 4) AS {c}_annual" for c in ("delta_units", "delta_revenue", "revenue_best")
)


@check(
    "r02_opportunity_summary",
    f"""SELECT product, item_id, current_price, best_price, units_best, units_curr, revenue_best, revenue_curr,
round(delta_units, 4) AS delta_units, round(delta_revenue, 4) AS delta_revenue, {_OPP} FROM opportunity""",
)
def opportunity(spark, folder):
    rows = rep.opportunity_summary(
        best(spark, folder), curve(spark, folder), rep.current_prices(retail.products(spark, folder))
    )
    return rounded(
        rows, delta_units=4, delta_revenue=4, delta_units_annual=4, delta_revenue_annual=4, revenue_best_annual=4
    )


@check(
    "c14_annualised",
    "SELECT product, round(revenue_p50 * 365.0::DOUBLE / 7, 4) AS yearly FROM best50",
)
def annualised(spark, folder):
    rows = best(spark, folder).select("product", rep.annual("revenue_p50", rep.ANNUAL_FACTOR / 7).alias("yearly"))
    return rounded(rows, yearly=4)


def product_prices(spark, folder):
    labels = prep.with_products(sales(spark, folder), retail.products(spark, folder))
    return labels.groupBy("product").agg(F.min("current_price").cast("double").alias("current_price"))


_UPSIDE = """SELECT b.product, round(b.revenue_p50 - n.revenue_p50, 4) AS upside, round(e.slope, 5) AS elasticity
FROM best50 b JOIN product_prices c USING (product)
JOIN LATERAL (SELECT * FROM price_rows p WHERE p.product = b.product ORDER BY abs(p.asp - c.current_price), p.asp LIMIT 1) n ON true
LEFT JOIN (SELECT product, CASE WHEN count(*) >= 5 THEN regr_slope(y, x) END AS slope FROM points GROUP BY product) e USING (product)"""


def upside(spark, folder, n):
    table = ela.elasticity_slopes(thick_rows(spark, folder), robust=False)
    rows = rep.upside_chart(table, best(spark, folder), product_prices(spark, folder), curve(spark, folder), n)
    return rounded(rows, upside=4, elasticity=5)


@check("r03_upside_chart", f"{_UPSIDE} ORDER BY b.revenue_p50 - n.revenue_p50 DESC, b.product LIMIT 12")
def upside_chart(spark, folder):
    return upside(spark, folder, rep.TOP_UPSIDES)


@check("t03_largest_upsides", f"SELECT product, upside FROM ({_UPSIDE}) ORDER BY upside DESC, product LIMIT 5")
def largest_upsides(spark, folder):
    return upside(spark, folder, 5).select("product", "upside")


@check(
    "j20_products_in_all_frames",
    "SELECT product FROM best50 INTERSECT SELECT product FROM product_prices INTERSECT SELECT product FROM curve",
)
def in_all_frames(spark, folder):
    return rep.common_products(curve(spark, folder), best(spark, folder), product_prices(spark, folder))


@check("u04_common_products", "SELECT product FROM prepared INTERSECT SELECT product FROM best50")
def common(spark, folder):
    return rep.common_products(prepared_rows(spark, folder), best(spark, folder))


@check(
    "u01_products_lookup",
    "SELECT product, item_id FROM labelled UNION SELECT product, item_id FROM best50",
)
def lookup(spark, folder):
    labels = prep.with_products(sales(spark, folder), retail.products(spark, folder))
    return rep.products_lookup(labels, best(spark, folder))


def _scenario(place: int, label: str, column: str, order: str) -> str:
    return f"""SELECT item_id, {place} AS place, '{label}' AS "case", '$' || format('{{:,.2f}}', arg_min(price, ({order}, price, period_start, event_name))) AS price,
'$' || format('{{:,.0f}}', arg_min({column}, ({order}, price, period_start, event_name))) AS revenue FROM curve GROUP BY item_id"""


@check(
    "r04_scenario_table",
    " UNION ALL ".join(
        _scenario(i, label, column, f"-{column}") for i, (label, column, _) in enumerate(rep.SCENARIOS)
    ),
)
def scenarios(spark, folder):
    return rep.scenario_table(curve(spark, folder))


@check(
    "r05_annual_deltas",
    """SELECT item_id, round(du, 4) AS units_delta_annual, round(dr, 4) AS revenue_delta_annual,
CASE WHEN du >= 0 THEN '+' ELSE '-' END || format('{:,.0f}', abs(du)) AS units_text,
CASE WHEN dr >= 0 THEN '+' ELSE '-' END || '$' || format('{:,.0f}', abs(dr)) AS revenue_text FROM deltas""",
)
def annual_deltas(spark, folder):
    rows = rep.annual_deltas(
        best(spark, folder), rep.current_prices(retail.products(spark, folder)), curve(spark, folder)
    )
    return rounded(rows, units_delta_annual=4, revenue_delta_annual=4)


@check(
    "r06_curve_frame",
    f"""SELECT {', '.join('c.' + k for k in KEY)}, asp, revenue_p025 AS low, revenue_p50 AS expected, revenue_p975 AS high, revenue_actual,
CASE WHEN event_name IS NOT NULL AND event_name <> 'BAU' THEN 'promotion' ELSE 'baseline' END AS kind,
a AS peak_p025, b AS peak_p50, d AS peak_p975
FROM curve c JOIN (SELECT product, arg_max(asp, (revenue_p025, -asp)) AS a, arg_max(asp, (revenue_p50, -asp)) AS b,
arg_max(asp, (revenue_p975, -asp)) AS d FROM curve GROUP BY product) p USING (product)""",
)
def curve_frame(spark, folder):
    return rep.curve_frame(curve(spark, folder))


cte(
    "fit_cards",
    """SELECT item_id, sqrt(avg(pow(p - a, 2))) AS rmse, sum(p - a) / sum(a) AS relative_error
FROM (SELECT item_id, asp, avg(revenue_actual) AS a, avg(revenue_p50) AS p FROM curve GROUP BY item_id, asp) GROUP BY item_id""",
)


@check(
    "r07_overview_cards",
    """SELECT i.item_id, i.product, format('{:,.0f}', (SELECT max(order_date) - min(order_date) + 1 FROM sales)::DOUBLE) AS days,
(SELECT min(order_date) || ' to ' || max(order_date) FROM sales) AS period,
'$' || format('{:,.2f}', c.current_price) AS current_price, coalesce('$' || format('{:,.2f}', b.asp), '—') AS recommended_price,
format('{:,.2f}', e.ratio) AS elasticity,
CASE WHEN magnitude >= 1.05 THEN 'ELASTIC' WHEN magnitude <= 0.95 THEN 'INELASTIC' ELSE 'BALANCED DEMAND' END || ' • ' ||
CASE WHEN elasticity_score > 50 THEN 'Top ' || format('{:,.0f}', 100 - elasticity_score) || '% most Sensitive'
     ELSE 'Bottom ' || format('{:,.0f}', elasticity_score) || '% Sensitivity' END AS elasticity_note,
coalesce(CASE WHEN du >= 0 THEN '+' ELSE '-' END || format('{:,.0f}', abs(du)), '—') AS units_delta,
coalesce(CASE WHEN dr >= 0 THEN '+' ELSE '-' END || '$' || format('{:,.0f}', abs(dr)), '—') AS revenue_delta,
'$' || format('{:,.0f}', f.rmse) AS fit, round(f.relative_error, 7) AS relative_error, i.points, round(i.coverage, 9) AS coverage
FROM (SELECT item_id, min(product) AS product, count(*) AS points, avg((revenue_actual BETWEEN revenue_p025 AND revenue_p975)::INT) AS coverage
      FROM curve GROUP BY item_id) i
LEFT JOIN current_prices c USING (item_id)
LEFT JOIN (SELECT item_id, min(asp) AS asp FROM best50 GROUP BY item_id) b USING (item_id)
LEFT JOIN elasticity e ON e.product = i.product LEFT JOIN deltas d ON d.item_id = i.item_id LEFT JOIN fit_cards f ON f.item_id = i.item_id""",
)
def overview(spark, folder):
    table = ela.label_slopes(ela.elasticity_slopes(thick_rows(spark, folder)))
    rows = rep.overview_cards(
        sales(spark, folder), retail.products(spark, folder), curve(spark, folder), best(spark, folder), table
    )
    return rounded(rows, relative_error=7, coverage=9)


@check(
    "r08_price_quantity_slice",
    """SELECT cents / 100.0::DOUBLE AS price, product, sum(shipped_units)::BIGINT AS shipped_units FROM thick
WHERE product = (SELECT max(product) FROM thick) GROUP BY cents, product""",
)
def price_quantity_slice(spark, folder):
    rows = thick_rows(spark, folder)
    last = rows.agg(F.max("product").alias("p")).scalar()
    out = prep.price_quantity(rows).where(F.col("product") == last)
    return out.withColumn("price", F.col("price").cast("double"))


@check(
    "c12_confidence",
    """SELECT product, round((0.4 * exp(-(greatest(l, m, h) - least(l, m, h)) / (0.1 * m)) + 0.6 * CASE WHEN em IS NULL THEN 0
 WHEN emax > emin THEN 1 - (em - emin) / (emax - emin) ELSE 1 END) * (0.6 + 0.4 * (1 - exp(-n / 6.0))), 8) AS score
FROM (SELECT product, arg_max(asp, (revenue_p025, -asp)) AS l, arg_max(asp, (revenue_p50, -asp)) AS m, arg_max(asp, (revenue_p975, -asp)) AS h,
      count(DISTINCT asp) AS n, min(el) AS emin, max(el) AS emax, arg_max(el, (revenue_p50, -asp)) AS em
      FROM (SELECT *, units_p50 / asp AS el FROM price_rows) GROUP BY product)""",
)
def confidence(spark, folder):
    rows = curve(spark, folder).withColumn("elasticity", F.col("units_p50") / F.col("asp"))
    return rounded(rep.confidence(rows).select("product", "score"), score=8)


@check(
    "c13_report_texts",
    """SELECT item_id, '$' || format('{:,.0f}', revenue) AS money, format('{:,.0f}', units) AS units,
CASE WHEN change >= 0 THEN '+' ELSE '-' END || format('{:,.0f}', abs(change)) AS signed_units,
CASE WHEN change >= 0 THEN '+' ELSE '-' END || '$' || format('{:,.0f}', abs(change)) AS signed_money, strftime(day, '%Y-%m-%d') AS day
FROM (SELECT item_id, sum(revenue_cents) / 100.0::DOUBLE AS revenue, sum(shipped_units)::DOUBLE AS units,
             (sum(shipped_units) - 700)::DOUBLE AS change, max(period_start) AS day FROM thick GROUP BY item_id)""",
)
def report_texts(spark, folder):
    rows = thick_rows(spark, folder).groupBy("item_id").agg(
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum("shipped_units").cast("double").alias("units"),
        F.max("period_start").alias("day"),
    )
    change = F.col("units") - 700
    return rows.select(
        "item_id",
        text.money_text(F.col("revenue")).alias("money"),
        text.units_text(F.col("units")).alias("units"),
        text.signed_units_text(change).alias("signed_units"),
        text.signed_money_text(change).alias("signed_money"),
        text.date_text(F.col("day")).alias("day"),
    )


@check(
    "c15_discounted_revenue",
    f"""SELECT item_id, period_start, event_name, round(cents / 100.0::DOUBLE * (1 - deal_discount_percent / 100.0::DOUBLE) * shipped_units, 5) AS scaled FROM thick""",
)
def discounted(spark, folder):
    scaled = rep.discounted_revenue(F.col("price").cast("double"), F.col("shipped_units"), F.col("deal_discount_percent"))
    return rounded(
        thick_rows(spark, folder).select("item_id", "period_start", "event_name", scaled.alias("scaled")), scaled=5
    )


@check(
    "t04_selector_list",
    "SELECT product, item_id, revenue_p50 FROM best50 ORDER BY revenue_p50 DESC, product",
)
def selector(spark, folder):
    return rep.selector_list(best(spark, folder))


@check(
    "t05_curve_in_price_order",
    """SELECT product, asp, CAST(row_number() OVER (PARTITION BY product ORDER BY asp) AS INTEGER) AS place FROM (SELECT DISTINCT product, asp FROM curve)""",
)
def in_price_order(spark, folder):
    points = ch.rows_at_price(curve(spark, folder))
    return rep.curve_in_price_order(points).select("product", "asp", "place")


@check(
    "t07_report_page",
    "SELECT product, item_id, price, revenue_p50 FROM best50 ORDER BY revenue_p50 DESC, product LIMIT 25 OFFSET 25",
)
def report_page(spark, folder):
    rows = rep.page(best(spark, folder), [F.col("revenue_p50").desc(), F.col("product")], number=1)
    return rows.select("product", "item_id", "price", "revenue_p50")


# ---- shape of the curve -------------------------------------------------------------------

cte("value_points", "SELECT product, price, avg(revenue_p50) AS value FROM curve GROUP BY product, price")


def value_points(spark, folder):
    return ch.price_means(curve(spark, folder), "revenue_p50")


@check(
    "w10_rolling_median",
    """SELECT product, price, round(sqrt(CASE WHEN n < 5 THEN value ELSE med END), 6) AS value FROM (
SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY product ORDER BY price ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med,
count(*) OVER (PARTITION BY product) AS n FROM value_points)""",
)
def rolling_median(spark, folder):
    return rooted(shp.rolling_median(value_points(spark, folder), "value", 5))


cte(
    "ranked_top",
    """SELECT *, row_number() OVER (PARTITION BY product ORDER BY price) AS i, sum(value) OVER (PARTITION BY product ORDER BY price) AS cum
FROM (SELECT product, cents / 100.0::DOUBLE AS price, avg(revenue_cents / 100.0::DOUBLE) AS value FROM thick GROUP BY product, cents)""",
)


@check(
    "w13_monotone_curve",
    """SELECT product, price, round(sqrt(min(inner_max)), 6) AS value FROM (
  SELECT p.product, p.price, a.i AS lo, max((b.cum - a.cum + a.value) / (b.i - a.i + 1)) AS inner_max
  FROM ranked_top p JOIN ranked_top a ON a.product = p.product AND a.i <= p.i
  JOIN ranked_top b ON b.product = p.product AND b.i >= p.i GROUP BY ALL) GROUP BY product, price""",
)
def monotone(spark, folder):
    points = ch.price_means(observed_curve(thick_rows(spark, folder)), "revenue_p50")
    return rooted(shp.monotone_curve(points, "value"))




@check(
    "u05_anchor_rows",
    """SELECT product, round((lo - 0.001 * span) / 100, 6) AS price,
 (SELECT quantile_cont(shipped_units::DOUBLE, 0.5) FROM thick t WHERE t.product = e.product AND t.cents <= e.q[1]) AS shipped_units, 0.001::DOUBLE AS weight
FROM (SELECT product, min(cents) AS lo, max(cents) AS hi, CASE WHEN max(cents) > min(cents) THEN max(cents) - min(cents) ELSE 1 END AS span,
      quantile_cont(cents::DOUBLE, [0.1, 0.9]) AS q FROM thick GROUP BY product) e
UNION ALL
SELECT product, round((hi + 0.001 * span) / 100, 6),
 (SELECT quantile_cont(shipped_units::DOUBLE, 0.5) FROM thick t WHERE t.product = e.product AND t.cents >= e.q[2]), 0.001::DOUBLE
FROM (SELECT product, min(cents) AS lo, max(cents) AS hi, CASE WHEN max(cents) > min(cents) THEN max(cents) - min(cents) ELSE 1 END AS span,
      quantile_cont(cents::DOUBLE, [0.1, 0.9]) AS q FROM thick GROUP BY product) e""",
)
def anchors(spark, folder):
    return rounded(shp.anchor_rows(thick_rows(spark, folder)), price=6)


@check(
    "c19_edge_taper",
    f"""SELECT {KEYS}, round(revenue_p50 * exp(-greatest(q[1] - price, price - q[2], 0) / (0.25 * (q[2] - q[1]))), 4) AS revenue_p50
FROM curve JOIN (SELECT product, quantile_cont(price, [0.1, 0.9]) AS q FROM curve GROUP BY product) USING (product)""",
)
def edge_taper(spark, folder):
    rows = shp.taper_edges(curve(spark, folder), ["revenue_p50"])
    return rounded(rows.select(*KEY, "revenue_p50"), revenue_p50=4)


@check(
    "c19_ordered_bands",
    f"""SELECT {KEYS}, s[1] AS low, s[2] AS middle, s[3] AS high
FROM (SELECT *, list_sort([revenue_p975, units_p50 * 900, revenue_p025]) AS s FROM curve)""",
)
def ordered_bands(spark, folder):
    rows = curve(spark, folder).select(
        *KEY,
        F.col("revenue_p975").alias("low"),
        (F.col("units_p50") * 900).alias("middle"),
        F.col("revenue_p025").alias("high"),
    )
    return shp.ordered_bands(rows, "low", "middle", "high")


cte(
    "errors",
    """SELECT product, sqrt(avg(pow(shipped_units - 40, 2))) AS rmse, quantile_cont(shipped_units::DOUBLE, 0.5) AS med, avg(cents) / 100 AS p
FROM thick GROUP BY product""",
)


def unseen_error(spark, folder):
    rows = thick_rows(spark, folder).withColumn("predicted", F.lit(40.0))
    return rep.unseen_error(rows, "shipped_units", "predicted")


@check(
    "c20_unit_error",
    "SELECT product, round(rmse, 6) AS rmse, round(rmse / greatest(med, 1), 6) AS rmse_share, round(rmse * p, 3) AS rmse_money FROM errors",
)
def unit_error(spark, folder):
    return rounded(unseen_error(spark, folder), rmse=6, rmse_share=6, rmse_money=3)


@check(
    "c20_portfolio_error",
    'SELECT round(quantile_cont(rmse, 0.5), 6) AS median_rmse, count(*) AS "groups" FROM errors',
)
def portfolio_error(spark, folder):
    return rounded(rep.portfolio_error(unseen_error(spark, folder)), median_rmse=6)
