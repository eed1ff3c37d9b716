"""What a step leaves on disk and how often it deals its rows out, and the bandwidth search without pairs of prices and cells."""

import glob
import hashlib
import os
import time
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotecurve import session
from quotecurve.operators import attribution as att
from quotecurve.operators import curve as crv
from quotecurve.operators import joins, prepare
from quotecurve.operators import weights as wt
from quotecurve.plans import extract


def _shuffle_files(spark):
    home = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp")
    return set(glob.glob(f"{home}/**/shuffle_*.data", recursive=True))


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    df = spark.range(50_000).withColumn("k", F.xxhash64("id")).repartition(4, "k").groupBy("k").count()
    before = _shuffle_files(spark)
    df.write.parquet(str(tmp_path / "plain"))
    plain = _shuffle_files(spark)
    assert plain - before
    told = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert session.materialise(df, "cleaned").count() == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == told
    for _ in range(50):  # files are deleted in the background; the count above has left a few bytes of its own
        left = [f for f in _shuffle_files(spark) - plain if os.path.exists(f) and os.path.getsize(f) > 10_000]
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_steps_keep_their_result_only(spark):
    home = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(home))
    with session.steps(spark) as outer:
        with session.steps(spark) as inner:
            one = session.materialise(spark.range(3), "one")
            two = inner(one.select((F.col("id") + 1).alias("id")), "two")
        assert {n.split("-")[0] for n in set(os.listdir(home)) - before} == {"two"}
        three = outer(two.select((F.col("id") * 2).alias("id")), "three")
    assert {n.split("-")[0] for n in set(os.listdir(home)) - before} == {"three"}
    assert sorted(r[0] for r in three.collect()) == [2, 4, 6]


def _retail(spark, folder):
    """Two items, one sold in its promotion; a line without a share, and one whose supplier occurs twice."""
    day = datetime(1997, 3, 1)
    tables = {
        "lineitem": (
            [(k, 1 + k % 2, 7 + (k == 5), 1, 3.0, 30.0, 0.08 if k % 2 else 0.0, 0.0, "R" if k == 2 else "N", "F", day) for k in range(1, 7)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        ),
        "orders": (
            [(k, 1, "F", 1.0, datetime(1997, 3, k), "1") for k in range(1, 7)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        ),
        "part": ([(1, "n1", "Brand#1", "T", 5, 10.0), (2, "n2", "Brand#2", "T", 5, 20.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(7, "a", 1, 0.0), (7, "b", 1, 0.0), (8, "c", 1, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_the_extract_leaves_one_table_and_repeats_what_its_lookups_repeat(spark, tmp_path):
    folder = _retail(spark, tmp_path)
    home = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(home))
    sales = extract.sales_input(spark, folder)
    assert {n.split("-")[0] for n in set(os.listdir(home)) - before} == {"extract"}
    # every item's vendor is the supplier that occurs twice, so its units count twice; from the second day on, three
    # promotions of item 2 are in force
    found = sorted((r.item_id, r.order_date.day, str(r.price), r.shipped_units) for r in sales.collect())
    assert found == [("1", k, "10.00", 6) for k in (2, 4, 6)] + [
        ("2", k, "18.40", 6 if k == 1 else 18) for k in (1, 3, 5)
    ]
    orders = extract.orders_in_scope(extract.retail_inputs(spark, folder), extract.whole_history())
    assert sorted((r.shipment_item_id, r.company_name, str(r.revenue_share_amt)) for r in orders.where("item_id = '1'").collect()) == [
        (f"{k}-1-1", c, "0.00" if k == 2 else "30.00") for k in (2, 4, 6) for c in "ab"
    ]


def test_sales_are_dealt_out_once_for_windows_terms_and_sums(spark, tmp_path, capsys):
    schema = "item_id string, item_name string, order_date date, price decimal(18,2), shipped_units bigint, revenue_share_amt decimal(18,2)"
    spark.createDataFrame([("a", "n", date(2024, 3, 5), Decimal("9"), 2, Decimal("18"))], schema).write.parquet(str(tmp_path / "daily"))
    daily = spark.read.parquet(str(tmp_path / "daily"))
    calendar = spark.createDataFrame([("a", "BF", date(2024, 3, 1), date(2999, 1, 1))], "item_id string, event_name string, promo_start date, promo_end date")
    base = spark.createDataFrame(
        [("a", datetime(2024, 3, 1), datetime(2024, 3, 9), Decimal("9.00"), 10.0)],
        "item_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, promo_price decimal(18,2), discount_percent double",
    )
    out = att.attribute_daily(daily, calendar, base)
    dealt = [line for line in _plan(out, capsys).splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("item_name" in line or "window_event" in line for line in dealt)
    assert [(r.event_name, r.deal_discount_percent, r.shipped_units) for r in out.collect()] == [("BF", 10.0, 2)]


def test_periods_are_summed_where_products_were_looked_up(spark, tmp_path, capsys):
    schema = "order_date date, item_id string, price decimal(18,2), shipped_units bigint, event_name string, deal_discount_percent double"
    rows = [(date(2024, 3, 1 + k), "ab"[k % 2], Decimal("2.50"), 1, "BAU", 0.0) for k in range(20)] + [(None, "a", Decimal("1"), 1, "BAU", 0.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sales"))
    products = spark.createDataFrame([("a", "t", "v", Decimal("3.00"))], "item_id string, tag string, variation string, current_price decimal(18,2)")
    labelled = prepare.with_products(spark.read.parquet(str(tmp_path / "sales")), products)
    assert labelled.columns == ["item_id", "order_date", "price", "shipped_units", "event_name", "deal_discount_percent", "product", "current_price"]
    assert {(r.item_id, r.product) for r in labelled.collect()} == {("a", "T V"), ("b", "b")}
    weekly = prepare.roll_up(labelled)
    assert not [x for x in _plan(weekly, capsys).splitlines() if "Exchange hashpartitioning" in x and "event_name" in x]
    assert weekly.agg(F.sum("shipped_units")).first()[0] == 20


@pytest.mark.parametrize("most", [10_000, 1])
def test_small_lookups_go_to_the_rows(spark, monkeypatch, capsys, most):
    monkeypatch.setattr(joins, "SMALL_LOOKUP", most)
    rows = spark.range(400).select(F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("product"), "id")
    lookup = spark.createDataFrame([("p0", 1), ("p1", 2), ("p1", 3)], "product string, v int")
    for how in ("left", "inner"):
        got = joins.lookup_join(rows, lookup, ["product"], ["id"], how)
        assert ("_salt" in _plan(got, capsys)) == (most == 1)
        assert got.count() == (500 if how == "left" else 300) and got.agg(F.sum("v")).first()[0] == 600


def test_rounds_of_a_fit_leave_the_points_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(crv, "salted_join", None)
    rows = spark.createDataFrame([("p", float(k), 0, 50.0 - k, 1.0) for k in range(1, 30)], "product string, price double, event_code int, shipped_units double, weight double")
    assert {r["status"] for r in crv.fit_curves(rows).collect()} == {"fitted"}


def test_bandwidths_are_scored_without_pairs_of_prices_and_cells(spark, monkeypatch):
    monkeypatch.setattr(wt, "kernel_mass", None)
    rng = np.random.default_rng(4)
    cents = {"a": rng.integers(3000, 14000, 400), "b": np.array([500, 500, 700, 90_000]), "c": np.array([800])}
    rows = [(p, c / 100, f"{p}{k}") for p, x in cents.items() for k, c in enumerate(x.tolist())]
    df = spark.createDataFrame([*rows, (None, 3.0, "none")], "product string, price double, key string")
    got = {(r["product"], r["i"]): (r["h"], r["score"]) for r in wt.bandwidth_scores(df, ["key"]).collect()}
    assert {p for p, _ in got} == {"a", "b"} and len(got) == 2 * wt.BANDWIDTHS  # c has nothing to learn from
    for (p, _), (h, score) in got.items():
        x = cents[p].astype(float)
        fold = np.array([int(hashlib.md5(f"{p}{k}".encode()).hexdigest()[:8], 16) % 5 for k in range(len(x))])
        want = 0.0
        for c, f in zip(x, fold):
            gap = ((c - x[fold != f]) / h) ** 2 / 2
            want += np.log(np.exp(gap.min() - gap).sum()) - gap.min() - np.log(len(gap) * h * np.sqrt(2 * np.pi))
        assert score == pytest.approx(want, rel=1e-8)
