"""Hand-made rows for titles, promotion windows and the paid-price rule."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quotecurve.functions.events import event_class, event_priority, not_clearance
from quotecurve.operators import attribution as att
from quotecurve.operators import promotions as promo
from quotecurve.operators.shipments import Scope, filter_shipments

TITLES = [
    ("UPDATE", datetime(2024, 7, 2), "PRIME DAY"),
    ("UPDATE", datetime(2024, 8, 2), "OTHER_PROMOTION"),
    ("Prime Day", datetime(2024, 6, 24), "OTHER_PROMOTION"),
    ("Prime Day", datetime(2024, 6, 25), "PRIME DAY"),
    ("PBDD", datetime(2024, 10, 1), "PBDD"),
    ("x t11 y", datetime(2024, 11, 1), "T5/11/12"),
    ("CM", datetime(2024, 11, 28), "CYBER MONDAY"),
    ("Pet Month", datetime(2024, 5, 1), "PET MONTH"),
    ("Big Spring Sale BF", datetime(2024, 3, 1), "BSS"),
    ("black-friday", datetime(2024, 11, 25), "BLACK FRIDAY"),
    ("boxing day", datetime(2024, 12, 26), "BOXING WEEK"),
    ("Back to School", datetime(2024, 9, 1), "BACK TO SCHOOL"),
    ("back 2 to university", datetime(2024, 9, 1), "BACK TO UNIVERSITY"),
    ("weekly", datetime(2024, 9, 1), "OTHER_PROMOTION"),
]


def test_event_classes(spark):
    df = spark.createDataFrame(TITLES, "title string, start timestamp_ntz, want string")
    wrong = df.withColumn("got", event_class(F.col("title"), F.col("start"))).where("got <> want").collect()
    assert wrong == []


def test_priorities_and_clearance(spark):
    df = spark.createDataFrame([("PRIME DAY",), ("BOXING WEEK",), ("PET MONTH",)], "e string")
    assert [r[0] for r in df.select(event_priority(F.col("e"))).collect()] == [1, 4, 99]
    titles = spark.createDataFrame([("oih x",), (None,), ("deal",)], "t string")
    assert [r[0] for r in titles.where(not_clearance(F.col("t"))).collect()] == ["deal"]


def _base(spark, rows):
    schema = (
        "region_id int, market_id int, product_group int, item_id string, promotion_key long, title string, "
        "start_ts timestamp_ntz, end_ts timestamp_ntz, promo_price decimal(18,2), discount_percent double"
    )
    return spark.createDataFrame([(1, 1, 199, *r) for r in rows], schema)


def _orders(spark, rows):
    schema = (
        "item_id string, item_name string, order_date date, price decimal(18,2), shipped_units long, "
        "revenue_share_amt decimal(18,2)"
    )
    return spark.createDataFrame([(i, "n", d, Decimal(p), u, Decimal(r)) for i, d, p, u, r in rows], schema)


def _attribute(spark, orders, base, **kw):
    details = promo.promotion_details(promo.raw_events(base))
    calendar = promo.consolidated_promotions(details, promo.event_standards(details))
    out = att.attribute_sales(orders, calendar, base, **kw).collect()
    return sorted((str(r.order_date), str(r.price), r.event_name, r.deal_discount_percent, r.shipped_units) for r in out)


def test_paid_price_and_first_day(spark):
    base = _base(
        spark, [("a", 1, "Weekly", datetime(2024, 3, 1, 9), datetime(2024, 3, 10, 18), Decimal("9.00"), 10.0)]
    )
    orders = _orders(
        spark,
        [
            ("a", date(2024, 3, 1), "9.00", 1, "9"),  # promotion starts at 09:00: price unknown, event stays
            ("a", date(2024, 3, 5), "9.00", 2, "18"),
            ("a", date(2024, 3, 5), "10.00", 4, "40"),
            ("a", date(2024, 3, 10), "9.00", 8, "72"),
            ("a", date(2024, 3, 11), "9.00", 16, "144"),
        ],
    )
    assert _attribute(spark, orders, base) == [
        ("2024-03-01", "9.00", "OTHER_PROMOTION", 0.0, 1),
        ("2024-03-05", "10.00", "BAU", 0.0, 4),
        ("2024-03-05", "9.00", "OTHER_PROMOTION", 10.0, 2),
        ("2024-03-10", "9.00", "OTHER_PROMOTION", 10.0, 8),
        ("2024-03-11", "9.00", "BAU", 0.0, 16),
    ]


def test_missing_promo_price_keeps_event(spark):
    base = _base(spark, [("a", 1, "BF", datetime(2024, 3, 1), datetime(2024, 3, 10), None, None)])
    orders = _orders(spark, [("a", date(2024, 3, 1), "9.00", 3, "9")])
    assert _attribute(spark, orders, base) == [("2024-03-01", "9.00", "BLACK FRIDAY", 0.0, 3)]


def test_overlapping_promotions_repeat_sales_unless_deduped(spark):
    promos = [
        ("a", 1, "BF", datetime(2024, 3, 1), datetime(2024, 3, 10), Decimal("9.00"), 10.0),
        ("a", 2, "weekly", datetime(2024, 3, 2), datetime(2024, 3, 9), Decimal("9.00"), 10.0),
        ("a", 3, "weekly", datetime(2024, 3, 2), datetime(2024, 3, 9), Decimal("8.00"), 20.0),
    ]
    orders = _orders(spark, [("a", date(2024, 3, 5), "9.00", 3, "27")])
    assert _attribute(spark, orders, _base(spark, promos)) == [
        ("2024-03-05", "9.00", "BAU", 0.0, 3),
        ("2024-03-05", "9.00", "BLACK FRIDAY", 10.0, 6),
    ]
    assert _attribute(spark, orders, _base(spark, promos), dedupe=True) == [
        ("2024-03-05", "9.00", "BLACK FRIDAY", 10.0, 3)
    ]


def test_standard_dates_replace_own_dates(spark):
    rows = [(f"i{k}", k, "BF", datetime(2024, 11, 20), datetime(2024, 11, 28), Decimal("1"), 1.0) for k in range(3)]
    rows.append(("late", 9, "BF", datetime(2024, 11, 22), datetime(2024, 11, 24), Decimal("1"), 1.0))
    details = promo.promotion_details(promo.raw_events(_base(spark, rows)))
    standards = promo.event_standards(details)
    assert [(r.event_name, r.frequency) for r in standards.collect()] == [("BLACK FRIDAY", 3)]
    late = promo.consolidated_promotions(details, standards).where("item_id = 'late'").first()
    assert (late.promo_start, late.promo_end) == (date(2024, 11, 20), date(2024, 11, 28))


def test_window_ends_at_run_date_midnight(spark):
    schema = (
        "item_id string, shipment_item_id string, market_id int, region_id int, unit_price decimal(18,2), "
        "order_ts timestamp_ntz, shipped_units long, product_group int, order_condition int, is_retail string"
    )
    times = [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1), datetime(2022, 1, 1), datetime(2021, 12, 31, 23)]
    rows = [("a", str(i), 1, 1, Decimal("1"), t, 1, 199, 1, "Y") for i, t in enumerate(times)]
    kept = filter_shipments(spark.createDataFrame(rows, schema), Scope(run_date="2024-01-01"))
    assert sorted(r.shipment_item_id for r in kept.collect()) == ["0", "2"]
    one = filter_shipments(spark.createDataFrame(rows, schema), Scope(run_date="2024-01-01", items=("b",)))
    assert one.count() == 0


@pytest.mark.parametrize("share", [0.34, 0.95])
def test_hot_item_gives_the_same_sums(spark, share):
    """One item holds a large share of the orders and of the promotions."""
    n = 600
    hot = int(n * share)
    orders = _orders(
        spark,
        [("hot" if i < hot else f"i{i % 7}", date(2024, 3, 1 + i % 28), "9.00", 1, "9.00") for i in range(n)],
    )
    promos = [
        ("hot", k, "weekly", datetime(2024, 3, 1 + k % 20), datetime(2024, 3, 5 + k % 20), Decimal("9.00"), 10.0)
        for k in range(60)
    ]
    got = _attribute(spark, orders, _base(spark, promos))
    # brute force
    lead = min(promos, key=lambda p: (p[3].date(), p[1]))
    window = (lead[3].date(), lead[4].date())
    starts = {}
    for p in promos[:1]:
        starts[(p[3].date(), p[4].date())] = 1
    want = 0
    for r in orders.collect():
        inside = r.item_id == "hot" and window[0] <= r.order_date <= window[1]
        copies = sum(
            p[3] <= datetime.combine(r.order_date, datetime.min.time()) <= p[4] for p in promos
        ) if inside else 0
        want += max(copies, 1)
    assert sum(r[4] for r in got) == want


def test_windows_and_terms_of_items_are_not_broadcast(spark, tmp_path, capsys):
    # a row or more for each item: small as a file, but not as rows in a driver
    stamp, day = F.lit("2024-07-01").cast("timestamp_ntz"), F.lit("2024-07-01").cast("date")
    items = spark.range(20_000).select(F.format_string("item%d", "id").alias("item_id"), F.lit("PRIME DAY").alias("event_name"))
    paths = [str(tmp_path / name) for name in ("windows", "offers")]
    items.withColumns({"promo_start": day, "promo_end": F.date_add(day, 6)}).write.parquet(paths[0])
    offers = {"start_ts": stamp, "end_ts": stamp, "promo_price": F.lit(Decimal("1.50")), "discount_percent": F.lit(8.0)}
    items.drop("event_name").withColumns(offers).write.parquet(paths[1])
    sales = spark.createDataFrame(
        [("item7", "n", date(2024, 7, 1), Decimal("1.50"), 2), ("item8", "n", date(2024, 8, 1), Decimal("1.50"), 3), ("none", "n", date(2024, 7, 1), Decimal("1.50"), 4)],
        "item_id string, item_name string, order_date date, price decimal(18,2), shipped_units bigint",
    )
    windowed = att.in_event_window(sales, spark.read.parquet(paths[0]))
    priced = att.with_promo_price(windowed, spark.read.parquet(paths[1]))
    for joined in (windowed, priced):
        joined.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out
    rows = {(r["item_id"], r["window_event"], r["promo_price"], r["shipped_units"] * r["copies"]) for r in priced.collect()}
    assert rows == {("item7", "PRIME DAY", Decimal("1.50"), 2), ("item8", None, None, 3), ("none", None, None, 4)}
