"""Properties of the curve fit and of the search."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotecurve.operators import curve as crv
from quotecurve.operators import resample
from quotecurve.operators import tuning as tun
from quotecurve.operators import weights as wt


def model_rows(spark, n=300, products=2, noise=0.2, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(products):
        price, event = np.round(rng.uniform(5, 20, n), 2), rng.integers(0, 3, n)
        units = np.maximum(1, np.round(50_000 * price**-2.0 * np.exp(0.3 * event + rng.normal(0, noise, n))))
        rows += [(f"p{p}", float(a), int(b), int(c), 1.0) for a, b, c in zip(price, event, units)]
    return spark.createDataFrame(rows, "product string, price double, event_code int, shipped_units long, weight double")


def least_squares(pdf, ns, q, smoothing=0.5, event_penalty=0.6):
    """The same penalised expectile fit written with dense matrices."""
    x, y, e = np.log1p(pdf.price.values), np.log1p(pdf.shipped_units.values), pdf.event_code.values.astype(float)
    basis = np.column_stack([tun._basis(x, x.min(), x.max(), ns), e])
    d = np.diff(np.eye(ns), n=2, axis=0)
    penalty = np.zeros((ns + 1, ns + 1))
    penalty[:ns, :ns] = smoothing * d.T @ d
    penalty[ns, ns] = event_penalty
    penalty += 1e-8 * np.eye(ns + 1)
    side = np.full(len(y), 0.5)
    for _ in range(60):
        w = side * (y if q == 0.5 else 1.0)
        coef = np.linalg.solve(basis.T @ (w[:, None] * basis) + penalty, basis.T @ (w * y))
        side = np.where(y > basis @ coef, q, 1 - q)
    return coef


def test_fit_equals_dense_solution_for_any_partitioning(spark):
    df = model_rows(spark)
    few = spark.createDataFrame([("few", 1.0, 0, 5, 1.0), ("few", 2.0, 0, 4, 1.0)], df.schema)
    pdf = df.where("product = 'p0'").toPandas()
    for parts in (1, 7):
        models = crv.fit_curves(df.unionByName(few).repartition(parts), n_splines=10).collect()
        assert {r.status for r in models if r["product"] == "few"} == {"too_few_prices"}
        for r in models:
            if r["product"] == "p0":
                want = least_squares(pdf, 10, r.q)
                assert np.allclose(r.beta, want[:10], atol=1e-6)
                assert r.event_coef == pytest.approx(want[10], abs=1e-6)


def test_scores_are_nonnegative_ordered_and_recover_the_law(spark):
    df = model_rows(spark, noise=0.05)
    scored = crv.score_curves(df, crv.fit_curves(df, n_splines=10)).collect()
    for r in scored:
        assert 0 <= r.units_p025 <= r.units_p50 <= r.units_p975
        assert r.revenue_p50 == pytest.approx(r.price * r.units_p50)
    middle = [(r.price, r.units_bau_p50) for r in scored if 7 < r.price < 18 and r["product"] == "p0"]
    slope = np.polyfit(np.log([p for p, _ in middle]), np.log([u for _, u in middle]), 1)[0]
    assert slope == pytest.approx(-2.0, abs=0.1)


def test_rows_without_model_pass_through(spark):
    df = model_rows(spark, products=1)
    other = df.limit(3).withColumn("product", F.lit("other"))
    scored = crv.score_curves(df.unionByName(other), crv.fit_curves(df, n_splines=8))
    assert scored.where("product = 'other'").count() == 3
    assert scored.where("product = 'other' and units_p50 is null").count() == 3


def test_one_product_may_own_most_rows(spark):
    small = model_rows(spark, n=50, products=1)
    hot = model_rows(spark, n=1500, products=1, seed=9).withColumn("product", F.lit("hot"))
    models = crv.fit_curves(small.unionByName(hot), n_splines=8).where("q = 0.5").collect()
    pdf = hot.toPandas()
    hot_model = next(r for r in models if r["product"] == "hot")
    assert np.allclose(hot_model.beta, least_squares(pdf, 8, 0.5)[:8], atol=1e-6)


def test_bins_of_few_prices(spark):
    def bins(prices):
        rows = [("p", float(x), 10 + i, 1.0) for i, x in enumerate(prices)]
        df = spark.createDataFrame(rows, "product string, price double, shipped_units long, weight double")
        return [(r.bin, r.price, r.target, r.weight) for r in tun.price_bins(df).orderBy("bin").collect()]

    assert bins([5.0] * 4) == [(0, 5.0, 11.5, 4.0)]
    assert bins([5.0, 6.0, 6.0]) == [(0, 5.0, 10.0, 1.0), (9, 6.0, 11.5, 2.0)]
    # all quantiles but the last are 5: equal-width bins instead
    assert bins([5.0] * 40 + [6.0]) == [(0, 5.0, 29.5, 40.0), (19, 6.0, 50.0, 1.0)]
    assert len(bins(range(1, 101))) == 20


def test_sums_by_price_give_the_row_deviance(spark):
    df = model_rows(spark, products=1).withColumn("m", 100 - F.col("price"))
    direct = tun.row_deviance(df, "shipped_units", "m", "weight").first().loss
    sums = tun.price_sums(df)
    assert sums.agg(tun.gamma_deviance(sums, 100 - F.col("price")).alias("loss")).first().loss == pytest.approx(direct)


def test_search_beats_its_coarse_grid(spark):
    df = model_rows(spark, products=1)
    bins, sums = tun.price_bins(df), tun.price_sums(df)
    coarse = tun.score_candidates(tun.coarse_grid(spark, (8, 12)), bins, sums)
    assert coarse.count() == 18
    best = coarse.agg(F.min("loss")).first()[0]
    found = tun.search(spark, lambda c: tun.score_candidates(c, bins, sums), (8, 12)).first()
    assert found.loss <= best + 1e-9
    assert found.lam == pytest.approx(found.lam_prime / found.n_splines**2)


def test_bootstrap_bands(spark):
    df = model_rows(spark, n=60, products=1).withColumn("k", F.monotonically_increasing_id().cast("string"))
    bands = resample.bootstrap_until(df, ["k"], target=0.5, batch=4, max_replicates=4, expectiles=(0.5,), n_splines=6)
    assert bands.count() == df.select("price").distinct().count()
    assert bands.agg(F.max("replicates")).first()[0] == 4


def test_a_far_price_rules_out_the_narrowest_bandwidth(spark):
    prices = [10 + k % 7 / 100 for k in range(40)] + [500.0]
    rows = spark.createDataFrame([("p", float(p), str(k)) for k, p in enumerate(prices)], "product string, price double, key string")
    scores = {r["i"]: (r["h"], r["score"]) for r in wt.bandwidth_scores(rows, ["key"]).collect()}
    cents = np.round(np.array(prices) * 100)
    fold = np.array([int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 5 for k in range(41)])
    for h, score in scores.values():
        want = 0.0
        for c, f in zip(cents, fold):
            gap = ((c - cents[fold != f]) / h) ** 2 / 2
            want += np.log(np.exp(gap.min() - gap).sum()) - gap.min() - np.log(len(gap) * h * np.sqrt(2 * np.pi))
        assert score == pytest.approx(want, rel=1e-6)
    assert wt.best_bandwidth(rows, ["key"]).first()["h"] > scores[0][0]


def test_a_broken_product_is_told_and_the_others_go_on(spark):
    good = model_rows(spark, n=60, products=1)
    broken = spark.createDataFrame([("bad", float(k), 0, k, 1e308) for k in range(1, 9)], good.schema)
    states = {(r["product"], r["q"]): r["status"] for r in crv.fit_curves(good.union(broken)).collect()}
    assert {s for (p, _), s in states.items() if p == "p0"} == {"fitted"}
    assert {s for (p, _), s in states.items() if p == "bad"} == {"failed"}
    assert "not_converged" in {r["status"] for r in crv.fit_curves(good, max_rounds=1).collect()}
