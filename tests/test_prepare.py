"""Sources, roll-up rules and exact global ranks."""

from datetime import date
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotecurve.operators import prepare as prep
from quotecurve.operators.ranks import label_codes, percentile_ranks, ranked_values
from quotecurve.sources import files


def sales(spark, rows):
    schema = (
        "item_id string, order_date date, price decimal(18,2), shipped_units long, event_name string, "
        "deal_discount_percent double"
    )
    return spark.createDataFrame([(i, d, Decimal(p), u, e, x) for i, d, p, u, e, x in rows], schema)


def products(spark, rows):
    return spark.createDataFrame(rows, "item_id string, tag string, variation string, current_price decimal(18,2)")


def test_read_csv_with_bad_values(spark, tmp_path):
    (tmp_path / "a_sales.csv").write_text(
        " Item_ID ,ORDER_DATE,price,shipped_units,event_name,deal_discount_percent\n"
        "a,2024-01-02,9.99,3,BAU,\nb,2024-01-03 10:00:00,oops,-4,,5\nc,nonsense,1.00,2,BAU,x\n"
    )
    (tmp_path / "my_products.csv").write_text("item_id,tag,variation,current_price\na,Dog,16lb,9.50\n")
    rows = {r.item_id: r for r in files.read_sales(spark, str(tmp_path)).collect()}
    assert rows["a"].price == Decimal("9.99") and rows["a"].order_date == date(2024, 1, 2)
    assert rows["b"].price == 0 and rows["b"].shipped_units == 0 and rows["b"].order_date == date(2024, 1, 3)
    assert rows["c"].order_date is None and rows["c"].deal_discount_percent is None
    assert files.read_products(spark, str(tmp_path)).first().current_price == Decimal("9.50")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="event_name"):
        files.coerce_sales(spark.createDataFrame([("a",)], "item_id string"))


def test_labels_and_null_keys(spark):
    rows = sales(
        spark,
        [
            ("a", date(2024, 1, 2), "10", 1, "BAU", 1.0),
            ("x", date(2024, 1, 2), "10", 1, "BAU", 1.0),
            ("a", date(2024, 1, 2), "10", 1, None, 1.0),
            ("a", None, "10", 1, "BAU", 1.0),
        ],
    )
    labelled = prep.with_products(rows, products(spark, [("a", "Dog", None, Decimal("9"))]))
    out = {r.item_id: r for r in prep.roll_up(labelled).collect()}
    assert {k: v["product"] for k, v in out.items()} == {"a": "DOG", "x": "x"}
    assert out["a"].shipped_units == 1


def test_average_price_and_first_discount(spark):
    rows = sales(
        spark,
        [
            ("a", date(2024, 1, 3), "10.00", 1, "BAU", 7.0),
            ("a", date(2024, 1, 2), "10.01", 1, "BAU", None),
            ("a", date(2024, 1, 2), "10.01", 0, "BAU", 5.0),
            ("b", date(2024, 1, 2), "10.01", 0, "BAU", 5.0),
        ],
    )
    labelled = prep.with_products(rows, products(spark, []))
    out = {r.item_id: r for r in prep.roll_up(labelled).collect()}
    assert out["a"].price == Decimal("10.01")  # 20.01 / 2, half up
    assert out["a"].deal_discount_percent == 5.0
    assert out["b"].price == 0 and out["b"].revenue == 0


@pytest.mark.parametrize("granularity,n", [("daily", 4), ("weekly", 3), ("monthly", 2)])
def test_granularities_at_year_end(spark, granularity, n):
    days = [date(2024, 12, 30), date(2024, 12, 31), date(2025, 1, 1), date(2025, 1, 6)]
    rows = sales(spark, [("a", d, "10", 1, "BAU", 1.0) for d in days])
    out = prep.roll_up(prep.with_products(rows, products(spark, [])), granularity).collect()
    assert len(out) == n
    if granularity == "weekly":
        got = sorted((r.year, r.week, r.month, r.period_start) for r in out)
        assert got == [
            (2024, 1, 12, date(2024, 12, 30)),
            (2025, 1, 1, date(2025, 1, 1)),
            (2025, 2, 1, date(2025, 1, 6)),
        ]


def test_thin_weeks_are_dropped_after_the_top_list(spark):
    rows = sales(spark, [("a", date(2024, 1, 2), "100", 4, "BAU", 1.0), ("b", date(2024, 1, 2), "1", 9, "BAU", 1.0)])
    out = prep.prepare(rows, products(spark, []), top_n=1)
    assert out.count() == 0


def test_event_codes_pin_the_baseline(spark):
    rows = sales(
        spark, [("a", date(2024, 1, 2), "1", 9, e, 1.0) for e in ("ZED", "BAU", "ALPHA")]
    )
    coded = prep.with_codes(prep.roll_up(prep.with_products(rows, products(spark, []))))
    assert {r.event_name: r.event_code for r in coded.collect()} == {"BAU": 0, "ALPHA": 1, "ZED": 2}


@pytest.mark.parametrize("cuts", [1, 7, 256])
def test_ranks_match_pandas(spark, cuts):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"v": rng.integers(0, 400, 3000)})
    df = spark.createDataFrame(data).repartition(5)
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: (r.code, r.below) for r in ranked_values(counts, "v", "n", cuts).collect()}
    uniq = np.sort(data.v.unique())
    assert got == {v: (i, int((data.v < v).sum())) for i, v in enumerate(uniq)}
    share = {r.v: r.s for r in percentile_ranks(df, "v", "s").collect()}
    want = data.v.rank(pct=True)
    assert all(abs(share[v] - w) < 1e-12 for v, w in zip(data.v, want))


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "l string")
    assert {r.l: r.code for r in label_codes(df, "l").collect()} == {"a": 0, "b": 1, "c": 2}
