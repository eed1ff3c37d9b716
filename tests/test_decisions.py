"""Elasticity, support, frontier and reports on small hand-made frames."""

from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotecurve.operators import choose as ch
from quotecurve.operators import elasticity as ela
from quotecurve.operators import report as rep
from quotecurve.operators import shape as shp
from quotecurve.operators import weights as wt


def periods(spark, rows):
    """(product, price, units) as weekly rows."""
    schema = (
        "product string, item_id string, event_name string, month int, period_start date, price decimal(18,2), "
        "shipped_units long"
    )
    day = date(2020, 1, 6)
    data = [
        (p, "i", "BAU", (day + timedelta(7 * k)).month, day + timedelta(7 * k), Decimal(str(x)), int(u))
        for k, (p, x, u) in enumerate(rows)
    ]
    return spark.createDataFrame(data, schema)


def test_slopes_need_five_rows(spark):
    rows = [("four", 10 + i, 100 - i) for i in range(4)] + [("five", 10 + i, 100 - i) for i in range(5)]
    got = {r["product"]: r.slope for r in ela.plain_slopes(periods(spark, rows)).collect()}
    assert got["four"] is None and got["five"] < 0
    table = {r["product"]: r for r in ela.elasticity_table(periods(spark, rows)).collect()}
    assert table["four"].ratio is None and table["four"].elasticity_score is None
    assert table["five"].elasticity_score == 100


def test_robust_slope_ignores_promotion_spikes(spark):
    rng = np.random.default_rng(5)
    price = np.round(rng.uniform(5, 20, 400), 2)
    units = np.round(1e6 * price**-2.0)
    spiked = rng.random(400) < 0.2
    rows = [("p", x, u * 30 if s else u) for x, u, s in zip(price, units, spiked)]
    df = periods(spark, rows)
    robust = ela.robust_slopes(df).first()
    assert robust.robust_slope == pytest.approx(-2.0, abs=0.02)
    again = ela.robust_slopes(df.repartition(7)).first()
    assert again.robust_slope == pytest.approx(robust.robust_slope, abs=1e-9)


def test_points_of_the_robust_slope_are_not_broadcast(spark, capsys):
    df = spark.range(2000).selectExpr(
        "concat('p', id % 2) AS product", "cast(id AS string) AS item_id", "'BAU' AS event_name", "1 AS month",
        "date_add(date'2024-01-01', int(id % 300)) AS period_start", "1 + id % 37 AS price", "1000 - 20 * (id % 37) AS shipped_units",
    )
    slopes = ela.robust_slopes(df)
    slopes.explain()
    plan = capsys.readouterr().out.splitlines()
    # many rows, but a small file: neither join of the points with a salted lookup may send them to the driver
    assert not [x for x in plan if "BroadcastHashJoin" in x and "_salt" in x]
    assert sorted(r["product"] for r in slopes.collect()) == ["p0", "p1"]


def test_tied_magnitudes_share_a_rank(spark):
    slopes = spark.createDataFrame([("a", -2.0), ("b", 2.0), ("c", -0.5)], "product string, ratio double")
    got = {r["product"]: r for r in ela.label_slopes(slopes).collect()}
    assert got["a"].elasticity_score == pytest.approx(got["b"].elasticity_score) == pytest.approx(250 / 3)
    assert got["c"].elasticity_label == "INELASTIC"


def points(spark, rows):
    return spark.createDataFrame(rows, "product string, price double, value double")


def test_frontier_with_ties_and_few_prices(spark):
    df = points(
        spark, [("one", 1.0, 5.0), ("two", 1.0, 5.0), ("two", 2.0, 5.0), ("tri", 1.0, 9.0), ("tri", 2.0, 7.0), ("tri", 3.0, 8.5)]
    )
    got = sorted((r["product"], r.price) for r in ch.frontier(df).collect())
    assert got == [("one", 1.0), ("tri", 1.0), ("tri", 3.0), ("two", 2.0)]
    best = {r["product"]: r.price for r in ch.frontier_price(ch.frontier(df)).collect()}
    assert best == {"one": 1.0, "two": 2.0, "tri": 3.0}


def test_steep_points_are_dropped(spark):
    df = points(spark, [("p", 1.0, 0.0), ("p", 2.0, 4999.0), ("q", 1.0, 0.0), ("q", 2.0, 5000.0), ("r", 1.0, 1e9)])
    assert sorted({r["product"] for r in ch.stable_points(df).collect()}) == ["p", "r"]
    slopes = {(r["product"], r.price): r.slope for r in ch.marginal_revenue(
        points(spark, [("p", 1.0, 1.0), ("p", 2.0, 4.0), ("p", 4.0, 10.0)])).collect()}
    assert slopes == {("p", 1.0): 3.0, ("p", 2.0): 3.0, ("p", 4.0): 3.0}


def curve(spark, rows):
    schema = "product string, item_id string, period_start date, event_name string, price double, revenue_p50 double"
    day = date(2020, 1, 6)
    df = spark.createDataFrame([(p, "i", day + timedelta(7 * k), "BAU", x, r) for k, (p, x, r) in enumerate(rows)], schema)
    return df.withColumns(
        {
            "asp": F.col("price"),
            "revenue_p025": F.col("revenue_p50"),
            "revenue_p975": F.col("revenue_p50"),
            "units_p50": F.col("revenue_p50") / F.col("price"),
        }
    )


def test_choice_falls_back_to_most_supported_row(spark):
    rows = [("low", 10.0, 100.0), ("low", 10.0, 90.0), ("low", 30.0, 500.0)] + [("ok", 10.0, 50.0 + k) for k in range(5)]
    chosen = {r["product"]: r for r in ch.choose_prices(ch.with_support(curve(spark, rows))).collect()}
    assert chosen["ok"].price == 10.0 and chosen["ok"].revenue_p50 == 54.0
    # steps of one gap: the window covers both prices, three observations are too few
    assert chosen["low"].support_count == 3


def test_best_expected_prefers_supported_rows(spark):
    rows = [("p", 10.0, 100.0 + k) for k in range(6)] + [("p", 99.0, 900.0)] + [("q", 5.0, 10.0), ("q", 6.0, 20.0)]
    df = curve(spark, rows).join(
        spark.createDataFrame([(10.0, 6), (99.0, 1), (5.0, 2), (6.0, 2)], "price double, support_count int"), "price"
    )
    for pick in (ch.best_expected, ch.best_expected_by_tiers):
        got = {r["product"]: r.revenue_p50 for r in pick(df).collect()}
        assert got == {"p": 105.0, "q": 20.0}


def test_support_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    price = np.round(rng.uniform(1, 30, 300), 2)
    got = {r.cents: r.support_count for r in ch.support_table(periods(spark, [("p", x, 1) for x in price])).collect()}
    cents = np.round(price * 100).astype(int)
    step = np.median(np.diff(np.unique(cents)))
    assert got == {c: int((np.abs(cents - c) <= 1.25 * step).sum()) for c in set(cents.tolist())}


def test_nearest_row_takes_the_lower_price_on_ties(spark):
    df = curve(spark, [("p", 10.0, 1.0), ("p", 20.0, 2.0)])
    wanted = spark.createDataFrame([("p", 15.0), ("none", 1.0)], "product string, wanted_price double")
    assert [r.asp for r in ch.nearest_rows(df, wanted).collect()] == [10.0]


def test_curve_columns_are_checked(spark):
    with pytest.raises(ValueError, match="revenue_actual"):
        rep.normalise_curve(curve(spark, [("p", 1.0, 1.0)]))


def test_scenarios_with_current_price(spark):
    df = curve(spark, [("p", 10.0, 100.0), ("p", 20.0, 300.0)]).withColumns(
        {"current_price": F.lit(12.5), "weighted_pred": -F.col("price")}
    )
    got = [(r.case, r.price, r.revenue) for r in rep.scenario_table(df).orderBy("place").collect()]
    assert got == [
        ("Current Price", "$12.50", "$100"),
        ("Conservative", "$20.00", "$300"),
        ("Recommended (Weighted)", "$10.00", "$100"),
        ("Expected", "$20.00", "$300"),
        ("Optimistic", "$20.00", "$300"),
    ]


def test_monotone_curve_matches_min_max_formula(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, 25)
    df = points(spark, [("p", float(i), float(v)) for i, v in enumerate(y)] + [("short", 1.0, 1.0), ("short", 2.0, 5.0)])
    got = [r.value for r in shp.monotone_curve(df, "value").where("product = 'p'").orderBy("price").collect()]
    want = [
        min(max(np.mean(y[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))
    ]
    assert np.allclose(got, want)
    rising = [r.value for r in shp.monotone_curve(df, "value", increasing=True).where("product = 'p'").orderBy("price").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(rising, rising[1:]))
    short = shp.monotone_curve(df, "value").where("product = 'short'").orderBy("price").collect()
    assert [r.value for r in short] == [1.0, 5.0]


def test_neighbour_radius_counts_repeated_prices(spark):
    prices = [10.0] * 10 + [11.0] * 4 + [13.0] * 2 + [50.0]
    got = {r.cents: r.radius for r in wt.neighbour_support(periods(spark, [("p", x, 1) for x in prices])).collect()}
    x = np.array(prices)
    assert got == {int(q * 100): pytest.approx(np.sort(np.abs(x - q))[14]) for q in set(prices)}
    few = wt.neighbour_support(periods(spark, [("p", float(i), 1) for i in range(1, 9)])).collect()
    assert {r.support for r in few} == {1.0}


@pytest.mark.parametrize("h", [3.0, 40.0, 2000.0])
def test_kernel_sums_match_brute_force(spark, h):
    rng = np.random.default_rng(8)
    cents = rng.choice(np.arange(500, 4000), 200, replace=False)
    n = rng.integers(1, 9, 200)
    refs = spark.createDataFrame(
        [("p", int(c), int(k), h) for c, k in zip(cents, n)], "product string, cents long, n long, h double"
    )
    got = {r.cents: r.mass for r in wt.kernel_mass(refs.select("product", "cents"), refs, ["product"]).collect()}
    for c in cents[:50]:
        want = float(np.sum(n * np.exp(-0.5 * ((c - cents) / h) ** 2)))
        assert got[int(c)] == pytest.approx(want, rel=1e-9)


def test_unusable_weights_are_repaired(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),), (-1.0,), (0.0,), (2.0,)], "w double")
    from quotecurve.functions.numeric import usable_weight

    assert [r[0] for r in df.select(usable_weight(F.col("w"))).collect()] == [1.0, 3.0, 1.0, 1e-6, 1e-6, 2.0]
