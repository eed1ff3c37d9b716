"""Readers, sinks and review options on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from quotecurve.operators import prepare, report, weights
from quotecurve.plans import review
from quotecurve.sources import files

SALES = "item_id string, order_date date, price decimal(18,2), shipped_units bigint, event_name string, deal_discount_percent double"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def sales(spark, rows):
    return spark.createDataFrame([(i, d, None, u, "BAU", 0.0) for i, d, u in rows], SALES)


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_run_replaces_its_own_window_only(spark, tmp_path, kind):
    path = f"{tmp_path}/sink"
    files.write_sales(sales(spark, [("a", day(k), 1) for k in range(0, 120, 10)] + [("n", None, 4)]), path, kind)
    # from 25 January to 4 March: parts of two months and one whole month, in which nothing was sold
    files.write_sales(sales(spark, [("b", day(25), 7), ("b", day(63), 8)]), path, kind, window=("2024-01-25", "2024-03-04"))
    back = spark.read.option("header", True).schema(SALES).format(kind).load(path)
    got = sorted((r["item_id"], str(r["order_date"]), r["shipped_units"]) for r in back.collect())
    want = [("a", str(day(k)), 1) for k in range(0, 120, 10) if not 24 <= k <= 63]
    assert got == sorted([*want, ("b", str(day(25)), 7), ("b", str(day(63)), 8), ("n", "None", 4)])
    files.write_sales(sales(spark, [("b", day(25), 7), ("b", day(63), 8)]), path, kind, window=("2024-01-25", "2024-03-04"))
    assert spark.read.option("header", True).schema(SALES).format(kind).load(path).count() == len(got)


def test_files_are_read_by_their_own_header(spark, tmp_path):
    head = "item_id,order_date,price,shipped_units,event_name,deal_discount_percent"
    (tmp_path / "sales_a.csv").write_text(f"{head}\na1,2024-01-05,3.50,4,BAU,\na2,nonsense,3.50,4,BAU,\nshort,2024-01-01\n\n")
    (tmp_path / "sales_b.csv").write_text('\ufeffPrice , item_id,SHIPPED_UNITS,order_date,event_name,deal_discount_percent,extra\n"9.00",b1,2,2024-02-01,"PRIME, DAY",15,x\nfree,b2,2,2024-02-01,BAU,0,\n1.00,b3,-2,2024-02-01,BAU,0,\n')
    (tmp_path / "sales_c.csv").write_text(f"{head}\n{head}\nc1,,1.00,,BAU,none\nc2,2024-03-01,,5,,\n")
    (tmp_path / "sales_empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("x\n1\n")
    good, bad = files.read_sales_files(spark, str(tmp_path))
    got = sorted((r["item_id"], str(r["order_date"]), float(r["price"]), r["shipped_units"], r["event_name"], r["deal_discount_percent"]) for r in good.collect())
    assert got == [("a1", "2024-01-05", 3.5, 4, "BAU", None), ("b1", "2024-02-01", 9.0, 2, "PRIME, DAY", 15.0), ("c2", "2024-03-01", 0.0, 5, None, None)]
    reasons = sorted((r["source_file"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect())
    assert reasons == [("sales_a.csv", "fields"), ("sales_a.csv", "order_date"), ("sales_b.csv", "price"), ("sales_b.csv", "shipped_units"), ("sales_c.csv", "deal_discount_percent")]
    rows, _ = files.read_loose(spark, str(tmp_path), "sales_[ab].csv")
    assert rows.columns[-1] == "source_file" and "extra" in rows.columns
    with pytest.raises(ValueError, match="missing"):
        files.read_sales_files(spark, str(tmp_path), "other*")


def test_days_of_masks_that_overlap(spark):
    rows = [("a", day(k % 45), 1) for k in range(90)] + [("b", day(30), 1), ("c", None, 1)]
    frame = sales(spark, rows)
    parts = [prepare.day_masks(frame.where(c)) for c in ("dayofmonth(order_date) < 20 or order_date is null", "dayofmonth(order_date) > 10")]
    got = {r["item_id"]: r["days_sold"] for r in prepare.days_of_masks(prepare.merge_day_masks(*parts)).collect()}
    assert got == {"a": 45, "b": 1, "c": 0}


def test_rare_prices_gain_with_their_distance(spark):
    prices = [20.0] * 80 + [20.1] * 80 + [30.0, 40.0] + [10.0] * 2
    rows = spark.createDataFrame([("p", p) for p in prices] + [("one", 5.0)], "product string, price double")
    rare = {(r["product"], r["cents"]): r["rarity"] for r in weights.smoothed_rarity(rows, tail=0.01).collect()}
    assert rare["one", 500] == 1 and rare["p", 2000] == 1
    assert 1 < rare["p", 3000] < rare["p", 4000] == pytest.approx(1.25)


def test_slices_and_price_order(spark):
    rows = spark.createDataFrame([("i1", "p", 3.0), ("i2", "p", 1.0), ("i2", "p", 1.0), ("i3", "q", 2.0), ("i4", "q", None)], "item_id string, product string, asp double")
    assert report.slice_rows(rows).count() == 5
    assert {r["item_id"] for r in report.slice_rows(rows, products=["q"], items=["i1", "i3"]).collect()} == {"i3"}
    got = [(r["product"], r["asp"], r["place"]) for r in report.curve_in_price_order(rows).collect()]
    assert got == [("p", 1.0, 1), ("p", 1.0, 1), ("p", 3.0, 2), ("q", 2.0, 1), ("q", None, None)]


def test_review_options_reach_the_operators(spark):
    rows = [("i1", day(3 * k), str(round(20 + (k * 7) % 13, 2)), 60 - (k * 7) % 13 + k % 3, "BAU" if k % 4 else "PRIME DAY", 0.0) for k in range(60)]
    data = spark.createDataFrame([(i, d, float(p), u, e, x) for i, d, p, u, e, x in rows], SALES.replace("decimal(18,2)", "double"))
    data = data.withColumn("price", F.col("price").cast("decimal(18,2)"))
    products = spark.createDataFrame([("i1", "t", "v", 25.0)], "item_id string, tag string, variation string, current_price double")
    products = products.withColumn("current_price", F.col("current_price").cast("decimal(18,2)"))
    options = review.Options(support="neighbours", rarity=True, robust_rows=True, anchors=True, max_rounds=25, monotone=True, ordered=True, grid_points=7)
    frames = review.price_review(data, products, robust=False, options=options)
    curve = frames["curve"].groupBy("price").agg(F.avg("units_bau_p50").alias("u")).orderBy("price").collect()
    units = [r["u"] for r in curve]
    assert all(a >= b - 1e-9 for a, b in zip(units, units[1:]))
    assert frames["price_grid"].count() in (0, 7)
    # a band whose curve has not settled after so few rounds is 0
    crossed = frames["curve"].where("units_p025 > units_p50 or (units_p975 > 0 and units_p50 > units_p975)").count()
    assert crossed == 0
    with pytest.raises(ValueError, match="support"):
        review.model_rows(data, options=review.Options(support="other"))
