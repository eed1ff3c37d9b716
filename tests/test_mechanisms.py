"""Resampling, cross-fitting, held-out search, price grids and hulls, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotecurve.operators import curve as crv
from quotecurve.operators import ranks, resample, shape
from quotecurve.operators import tuning as tun
from quotecurve.operators.joins import salted_join

ROWS = "product string, item_id string, period_start date, price double, shipped_units double, event_code int, weight double"


def sold(spark, products=("a", "b"), n=120, seed=3, law=False):
    import datetime

    rng = random.Random(seed)
    rows = []
    for p in products:
        for k in range(n):
            price = rng.randrange(500, 4000) / 100
            units = np.expm1(2 + 0.5 * np.log1p(price)) if law else max(0.0, 60 - price + rng.gauss(0, 9))
            rows.append((p, f"{p}{k}", datetime.date(2024, 1, 1) + datetime.timedelta(days=k), price, float(units), k % 2, 1.0 + k % 3))
    return spark.createDataFrame(rows, ROWS)


def test_curves_leave_the_loop_one_by_one(spark):
    rows = sold(spark, ("a", "b", "c")).unionByName(sold(spark, ("law",), law=True))
    points = crv.training_points(rows)
    ranges = crv.curve_ranges(points, 8)
    placed = crv.place_points(points, ranges, "product", ["x", "y", "e"]).withColumn("ws", F.array("w")).drop("w")
    found = crv.fit_rounds(placed, "product", (0.5, 0.975)).collect()
    rounds = {(r["product"], r["q"]): r["rounds"] for r in found}
    assert len(found) == 8 and all(r["change"] < 1e-6 for r in found)
    assert rounds["a", 0.5] <= 2 < rounds["a", 0.975]
    models = crv.with_states(spark.createDataFrame(found).drop("rep", "rounds"), ranges, "product", (0.5, 0.975))
    gaps = crv.normal_equations(rows, models).collect()
    assert len(gaps) == 4 * 2 * 8 and max(abs(r["gap"]) for r in gaps) < 1e-5


def test_residuals_of_a_fold_do_not_see_its_units(spark):
    rows = sold(spark)
    key = ["item_id"]
    first = {r["item_id"]: r for r in resample.cross_fit_residuals(rows, key, folds=4, n_splines=6).collect()}
    changed = rows.withColumn("shipped_units", F.when(resample.fold_of(key, 4) == 2, F.col("shipped_units") * 3 + 7).otherwise(F.col("shipped_units")))
    second = {r["item_id"]: r for r in resample.cross_fit_residuals(changed, key, folds=4, n_splines=6).collect()}
    for k, r in first.items():
        fit = [np.log1p(x[k]["shipped_units"]) - x[k]["residual"] for x in (first, second)]
        assert (fit[0] == pytest.approx(fit[1], abs=1e-9)) == (r["fold"] == 2)
    rest = rows.where(resample.fold_of(key, 4) != 2)
    ends = rows.groupBy("product").agg(F.min("price").alias("lo"), F.max("price").alias("hi")).collect()
    edges = spark.createDataFrame([(e["product"], "edge", None, p, None, 0, 1.0) for e in ends for p in (e["lo"], e["hi"])], ROWS)
    # the same knots need the outer prices; a light row there moves nothing
    light = edges.withColumn("shipped_units", F.lit(1.0)).withColumn("weight", F.lit(1e-12))
    models = crv.fit_curves(rest.unionByName(light), n_splines=6, expectiles=(0.5,))
    scored = crv.score_curves(rows, models).select("item_id", "units_p50").collect()
    for r in scored:
        if first[r["item_id"]]["fold"] == 2 and r["units_p50"] > 0:
            want = np.log1p(first[r["item_id"]]["shipped_units"]) - first[r["item_id"]]["residual"]
            assert np.log1p(r["units_p50"]) == pytest.approx(want, abs=1e-4)


def test_robust_weights_shrink_spikes_only(spark):
    rows = sold(spark).withColumn("shipped_units", F.when(F.col("item_id") == "a7", 4000.0).otherwise(F.col("shipped_units")))
    before = {r["item_id"]: r["weight"] for r in rows.collect()}
    after = {r["item_id"]: r["weight"] for r in resample.robust_weights(rows, ["item_id"], n_splines=6).collect()}
    assert after["a7"] < 0.5 * before["a7"] and all(after[k] <= before[k] for k in before)
    assert sum(after[k] == before[k] for k in before) > len(before) / 2


def test_bootstrap_stops_product_by_product(spark):
    rows = sold(spark, ("calm",), law=True).unionByName(sold(spark, ("wild",), n=30))
    bands = resample.bootstrap_until(rows, ["item_id"], target=3e-3, batch=4, max_replicates=8, n_splines=6, max_rounds=8).collect()
    for r in bands:
        law = np.expm1(2 + 0.5 * np.log1p(r["price"]))
        if r["product"] == "calm":
            assert r["target_met"] and r["replicates"] == 4
            assert [r["units_p025"], r["units_p50"], r["units_p975"]] == pytest.approx([law] * 3, rel=1e-3)
        else:  # ends of the outer curves that have not settled are left out
            assert not r["target_met"] and r["replicates"] == 8
    assert {r["product"] for r in bands} == {"calm", "wild"}


def test_replicates_are_weighted_fits(spark):
    rows = sold(spark, ("a",))
    models = {r["rep"]: r for r in resample.bootstrap_curves(rows, ["item_id"], 3, first=5, n_splines=6, expectiles=(0.5,)).collect()}
    assert sorted(models) == [5, 6, 7]
    drawn = rows.withColumn("counts", resample.poisson_counts(["item_id"], 5, 3))
    assert abs(drawn.select(F.avg(F.col("counts")[0])).first()[0] - 1) < 0.35
    for rep in (7,):
        once = drawn.withColumn("weight", F.col("weight") * F.col("counts")[rep - 5]).where("weight > 0")
        ends = rows.agg(F.min("price").alias("lo"), F.max("price").alias("hi")).first()
        light = spark.createDataFrame([("a", "edge", None, p, 1.0, 0, 1e-12) for p in (ends["lo"], ends["hi"])], ROWS)
        alone = crv.fit_curves(once.drop("counts").unionByName(light), n_splines=6, expectiles=(0.5,)).first()
        assert alone["beta"] == pytest.approx(models[rep]["beta"], abs=1e-3)


def test_grid_between_the_outer_prices(spark):
    rows = sold(spark, ("a",), law=True)
    grid = crv.score_grid(crv.fit_curves(rows, n_splines=6), points=11).orderBy("price").collect()
    ends = rows.agg(F.min("price"), F.max("price")).first()
    assert len(grid) == 11 and (grid[0]["price"], grid[-1]["price"]) == (pytest.approx(ends[0]), pytest.approx(ends[1]))
    assert all(r["units_p50"] == pytest.approx(np.expm1(2 + 0.5 * np.log1p(r["price"])), rel=1e-3) for r in grid)


def test_held_out_rows_choose_another_smoothing(spark):
    rng = random.Random(5)
    rows = []
    for k in range(600):
        price, train = 5 + (k % 20), k % 3 != 0
        wave = 30 * (-1) ** (k % 20) if train else 0  # training rows swing from price to price, later ones do not
        rows.append(("a", f"i{k}", None, float(price), max(1.0, 80 - 2 * price + wave + rng.gauss(0, 1)), 0, 1.0, "train" if train else "test"))
    frame = spark.createDataFrame(rows, ROWS + ", split string")
    held, seen = tun.tune(frame, split="split", splines=(8, 24)).first(), tun.tune(frame.where("split = 'train'"), splines=(8, 24)).first()
    assert (held["n_splines"], held["lam_prime"]) != (seen["n_splines"], seen["lam_prime"])
    assert held["lam"] > 100 * seen["lam"]
    bins, sums = tun.training_and_validation(frame, split="split")
    test = frame.where("split = 'test'")
    assert sums.agg(F.sum("w")).first()[0] == test.count()
    fits = tun.fit_candidates(tun.coarse_grid(spark, (8,)), bins)
    told = {r["lam_prime"]: r["loss"] for r in tun.score_candidates(tun.coarse_grid(spark, (8,)), bins, sums).collect()}
    met = tun.candidate_mean(test.select("price", "shipped_units", "weight"), fits)
    for r in met.groupBy("lam_prime").agg(F.collect_list(F.struct("shipped_units", "mean")).alias("v")).collect():
        loss = np.mean([2 * ((y - m) / m - np.log(y / m)) for y, m in r["v"]])
        assert told[r["lam_prime"]] == pytest.approx(loss, rel=1e-9)


def _plain_monotone(y):
    means, sizes = [], []
    for v in y:
        means.append(v)
        sizes.append(1)
        while len(means) > 1 and means[-1] > means[-2]:
            m, s = means.pop(), sizes.pop()
            means[-1] = (means[-1] * sizes[-1] + m * s) / (sizes[-1] + s)
            sizes[-1] += s
    return np.repeat(means, sizes)


@pytest.mark.parametrize("parts", [1, 7])
def test_hulls_of_ranges_are_the_hull_of_the_group(spark, parts):
    rng = np.random.default_rng(parts)
    curves = {
        "noise": rng.normal(size=200),
        "falling": -np.arange(150.0),
        "rising": np.arange(150.0),
        "steps": np.repeat([5.0, 9, 2, 2, 8, 1], 20) + rng.normal(size=120) * 0.01,
        "two": np.array([1.0, 2.0]),
        "one": np.array([3.0]),
    }
    rows = [(g, float(k), float(v), "x") for g, vs in curves.items() for k, v in enumerate(vs)]
    rows += [("noise", 1000.0, None, "x"), (None, 1.0, 2.0, "x")]
    frame = spark.createDataFrame(rows, "product string, price double, value double, note string")
    for increasing in (False, True):
        got: dict = {}
        for r in sorted(shape.monotone_curve(frame, "value", increasing=increasing, parts=parts).collect(), key=lambda r: (r["price"])):
            got.setdefault(r["product"], []).append(r["value"])
        sign = -1 if increasing else 1
        for g, vs in curves.items():
            want = sign * _plain_monotone(sign * vs) if len(vs) > 2 else vs
            assert [v for v in got[g] if v is not None] == pytest.approx(list(want), abs=1e-9)
        assert got[None] == [2.0] and None in got["noise"]


def test_quantiles_of_a_group_that_owns_most_rows(spark):
    rng = random.Random(2)
    rows = [("hot", round(1000 + rng.random(), 6), rng.randrange(1, 5)) for _ in range(4000)]
    rows += [(f"g{k % 9}", float(rng.randrange(-50, 50) * 1000), rng.randrange(1, 9)) for k in range(300)]
    rows = list({(g, v): (g, v, n) for g, v, n in rows}.values())
    frame = spark.createDataFrame(rows, "g string, v double, n long")
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    for r in ranks.quantiles(frame, "v", "n", shares, ("g",)).collect():
        values = np.repeat([x[1] for x in rows if x[0] == r["g"]], [x[2] for x in rows if x[0] == r["g"]])
        assert r["cuts"] == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)
    whole = np.repeat([x[1] for x in rows], [x[2] for x in rows])
    assert ranks.quantiles(frame, "v", "n", shares).first()["cuts"] == pytest.approx(list(np.quantile(whole, shares)), rel=1e-12)
    assert ranks.quantiles(frame.limit(0), "v", "n", shares, ("g",)).count() == 0


def test_salted_copies_of_a_large_lookup_are_not_broadcast(spark, tmp_path, capsys):
    def joined(n):
        path = str(tmp_path / f"lookup{n}")
        spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")).write.parquet(path)
        rows = spark.range(40).select((F.col("id") % 5).alias("k"), F.col("id").alias("r"))
        return salted_join(rows, spark.read.parquet(path), on=["k"], spread_by=["r"])

    def broadcasts(df):
        df.explain()
        return "BroadcastHashJoin" in capsys.readouterr().out

    # half a million rows are a few MB as a file; sixteen copies of them would not fit a driver
    large, small = joined(500_000), joined(3)
    assert not broadcasts(large) and broadcasts(small)
    assert sorted((r["r"], r["v"]) for r in large.collect()) == [(r, r % 5 * 3) for r in range(40)]
    assert sorted(r["r"] for r in small.where("v IS NULL").collect()) == [r for r in range(40) if r % 5 > 2]
