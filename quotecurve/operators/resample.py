"""Resampled and cross-fitted curves: bootstrap bands to a target error, out-of-fold residuals.

Both rest on the sums of spline cells, which add up over rows. A replicate is a weight for each row, so the
replicates of a batch are an array of weights and share every scan. A fold's fit uses the total sums less
the fold's own, so all folds need one scan.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import expm1_floor, log1p_floor, usable_weight
from ..session import materialise, scratch_folder, steps
from .curve import (
    BAND,
    EVENT_PENALTY,
    EXPECTILES,
    MAX_ROUNDS,
    MIN_PRICES,
    SMOOTHING,
    _solved,
    cell_sums,
    curve_ranges,
    fit_rounds,
    place_points,
    spline_cell,
    spline_value,
    training_rows,
    with_states,
)
from .joins import lookup_join, salted_join
from .weights import huber_factor

# Relative error at which a product stops, replicates of a batch and at most.
TARGET_ERROR = 0.05
BATCH = 10
MAX_REPLICATES = 50
FOLDS = 5


def _keyed(rows: DataFrame, by: str, weight: str | None, *more: Column) -> DataFrame:
    """Complete rows as (group, x, e, y, w, ...)."""
    w = usable_weight(F.col(weight)) if weight else F.lit(1.0)
    e = F.coalesce(F.col("event_code").cast("double"), F.lit(0.0))
    x, y = log1p_floor(F.col("price").cast("double")), log1p_floor(F.col("shipped_units").cast("double"))
    return rows.select(by, x.alias("x"), e.alias("e"), y.alias("y"), w.alias("w"), *more).dropna(subset=[by, "x", "y"])


def poisson_counts(row_key: list[str], first: int, replicates: int) -> Column:
    """Array of how often a row is drawn in each replicate: Poisson(1) counts from the hash of its key."""

    def count(rep: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(*row_key, rep), 11) * F.lit(2.0**-53)
        total, term, found = 0.0, float(np.exp(-1.0)), F.lit(0)
        for k in range(9):  # inverse of the distribution function
            term = term / max(k, 1)
            total += term
            found = found + F.when(u >= total, 1).otherwise(0)
        return found

    return F.transform(F.sequence(F.lit(first), F.lit(first + replicates - 1)), count)


def bootstrap_curves(
    rows: DataFrame,
    row_key: list[str],
    replicates: int = BATCH,
    first: int = 0,
    n_splines: int | None = None,
    smoothing: float = SMOOTHING,
    event_penalty: float = EVENT_PENALTY,
    weight: str | None = "weight",
    by: str = "product",
    expectiles: tuple[float, ...] = EXPECTILES,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Model table (group, rep, q, ...) of the replicates `first` .. `first + replicates - 1` (at most 60 at once).

    Knots are those of the group's own prices, so replicates differ only in their weights. A replicate that
    draws fewer than three prices has status 'too_few_prices'.
    """
    if not 0 < replicates <= 60:
        raise ValueError("replicates must be 1 to 60")
    ranges = materialise(curve_ranges(training_rows(rows, weight, by), n_splines, by), "ranges")
    counts = poisson_counts(row_key, first, replicates)
    points = _keyed(rows, by, weight, counts.alias("counts")).withColumn("ws", F.transform("counts", lambda c: c * F.col("w")))
    drawn = sum((F.shiftleft(F.when(F.get("counts", F.lit(k)) > 0, 1).otherwise(0).cast("long"), k) for k in range(replicates)), F.lit(0).cast("long"))
    prices = points.groupBy(by, "x").agg(F.bit_or(drawn).alias("drawn"))
    held = F.array(*[F.sum(F.shiftright("drawn", k).bitwiseAND(F.lit(1).cast("long"))) for k in range(replicates)])
    enough = prices.groupBy(by).agg(held.alias("held"))
    placed = place_points(points.drop("w", "counts"), ranges.where(F.col("n_prices") >= MIN_PRICES), by, ["x", "y", "e"])
    with steps(rows.sparkSession):
        fitted = fit_rounds(materialise(placed, "fit_points"), by, expectiles, replicates, smoothing, event_penalty, max_rounds)
    models = with_states(fitted.drop("rounds"), ranges, by, expectiles).where("rep is not null").join(enough, by)
    few = F.get("held", F.col("rep")) < MIN_PRICES
    return models.withColumns({"status": F.when(few, "too_few_prices").otherwise(F.col("status")), "rep": F.col("rep") + first}).drop("held")


def bootstrap_bands(points: DataFrame, models: DataFrame, by: str = "product") -> DataFrame:
    """Medians of the replicates' curves at each price point, and the relative error of the middle one.

    `points` has the group and price; work grows with prices times replicates.
    """
    table = models.where("status = 'fitted'").groupBy(by).agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n_splines").alias("n_splines"), F.collect_list(F.struct("rep", "q", "beta")).alias("models")
    )
    spots = points.select(by, F.col("price").cast("double").alias("price")).distinct()
    met = salted_join(spots, table, on=[by], spread_by=["price"], how="inner")
    cell, t = spline_cell(log1p_floor(F.col("price")), F.col("lo"), F.col("hi"), F.col("n_splines"))
    placed = met.withColumns({"cell": cell, "t": t}).withColumn("m", F.explode("models"))
    units = placed.withColumn("units", expm1_floor(spline_value(F.col("m.beta"), F.col("cell"), F.col("t"))))
    # a group holds one curve value for each replicate
    medians = [F.percentile(F.when(F.col("m.q") == q, F.col("units")), 0.5).alias(f"units_{name}") for q, name in BAND.items()]
    middle = F.when(F.col("m.q") == 0.5, F.col("units"))
    error = F.coalesce(F.try_divide(F.stddev_samp(middle), F.avg(middle) * F.sqrt(F.count(middle))), F.lit(0.0))
    return units.groupBy(by, "price").agg(*medians, error.alias("relative_error"), F.count(middle).cast("int").alias("replicates"))


def bootstrap_until(
    rows: DataFrame,
    row_key: list[str],
    target: float = TARGET_ERROR,
    batch: int = BATCH,
    max_replicates: int = MAX_REPLICATES,
    by: str = "product",
    **fit,
) -> DataFrame:
    """Bands of every product from as many replicates as its own target error needs.

    After each batch, products whose mean relative error over their prices is at most `target` stop; only
    the others' rows are fitted again, and only the new replicates. `target_met` is false where
    `max_replicates` did not suffice. Products without any fitted replicate have no bands.
    """
    spark = rows.sparkSession
    home = scratch_folder(spark, "bootstrap")
    open_rows, done, models, first = rows, None, None, 0
    while True:
        size = min(batch, max_replicates - first)
        path = f"{home}/models-{first}"
        bootstrap_curves(open_rows, row_key, size, first, by=by, **fit).write.parquet(path)
        fresh = spark.read.parquet(path)
        models = fresh if models is None else models.unionByName(fresh)
        first += size
        bands = materialise(bootstrap_bands(open_rows, models, by), "bands")
        errors = bands.groupBy(by).agg(F.avg("relative_error").alias("error"))
        met = materialise(errors.select(by, (F.col("error") <= target).alias("target_met")), "errors")
        last = first >= max_replicates
        over = bands.join(met if last else met.where("target_met"), by)
        done = over if done is None else done.unionByName(over)
        if last or not met.where("not target_met").limit(1).count():
            return done
        open_rows = open_rows.join(met.where("not target_met").select(by), by, "left_semi")


# --- cross-fitting ---------------------------------------------------------------------------------------


def _fold_solver(folds: int, smoothing: float, event_penalty: float):
    """For each group: the coefficients of every fold's fit, from the total sums less the fold's own."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coefs = []
            for ns, cells in zip(pdf["n_splines"], pdf["cells"]):
                total: dict = {}
                for c in cells:
                    sums, rhs = total.setdefault(c["cell"], (np.zeros(len(c["sums"])), np.zeros(len(c["rhs"]))))
                    sums += c["sums"]
                    rhs += c["rhs"]
                own = {(c["fold"], c["cell"]): c for c in cells}
                fits = []
                for fold in range(folds):
                    left = []
                    for cell, (sums, rhs) in total.items():
                        mine = own.get((fold, cell))
                        left.append({"cell": cell, "sums": sums - mine["sums"] if mine else sums, "rhs": rhs - mine["rhs"] if mine else rhs})
                    coef = _solved(ns, left, smoothing, event_penalty)
                    fits.append(None if coef is None else coef.tolist())
                coefs.append(fits)
            yield pdf.drop(columns=["n_splines", "cells"]).assign(coefs=coefs)

    return solve


def fold_of(row_key: list[str], folds: int = FOLDS) -> Column:
    """Fold of a row, from the hash of its key."""
    return F.pmod(F.xxhash64(*row_key), F.lit(folds)).cast("int")


def cross_fit_residuals(
    rows: DataFrame,
    row_key: list[str],
    folds: int = FOLDS,
    n_splines: int | None = None,
    smoothing: float = SMOOTHING,
    event_penalty: float = EVENT_PENALTY,
    weight: str | None = "weight",
    by: str = "product",
) -> DataFrame:
    """`rows` with `fold` and `residual`: ln(1+units) less the middle curve fitted without the row's fold.

    Rows without price or units, and those of groups with fewer than three prices, have a null residual.
    """
    fold = fold_of(row_key, folds)
    ranges = materialise(curve_ranges(training_rows(rows, weight, by), n_splines, by).where(F.col("n_prices") >= MIN_PRICES), "ranges")
    placed = place_points(_keyed(rows, by, weight, fold.alias("fold")), ranges, by, ["x", "y", "e"])
    # the weight of the middle curve, as in the fit
    sums = cell_sums(placed.withColumn("w", F.col("w") * F.col("y") * 0.5), [by, "fold"])
    cells = sums.groupBy(by, "n_splines").agg(F.collect_list(F.struct("fold", "cell", "sums", "rhs")).alias("cells"))
    solved = cells.mapInPandas(_fold_solver(folds, smoothing, event_penalty), f"{by} string, coefs array<array<double>>")
    table = materialise(solved.join(ranges, by).select(by, "lo", "hi", "n_splines", "coefs"), "fold_curves")
    x, y = log1p_floor(F.col("price").cast("double")), log1p_floor(F.col("shipped_units").cast("double"))
    spread = [c for c in row_key if c != by] or [by]
    joined = lookup_join(rows.withColumn("fold", fold), table, on=[by], spread_by=spread)
    cell, t = spline_cell(x, F.col("lo"), F.col("hi"), F.col("n_splines"))
    coef = F.get("coefs", F.col("fold"))
    event = F.coalesce(F.col("event_code").cast("double"), F.lit(0.0))
    told = joined.withColumns({"_cell": cell, "_t": t, "_coef": coef, "_e": event})
    terms = spline_value(F.col("_coef"), F.col("_cell"), F.col("_t")) + F.get("_coef", F.col("n_splines")) * F.col("_e")
    return told.withColumn("residual", y - terms).drop("lo", "hi", "n_splines", "coefs", "_cell", "_t", "_coef", "_e")


def robust_weights(rows: DataFrame, row_key: list[str], by: str = "product", **fit) -> DataFrame:
    """`rows` with `weight` times the Huber factor of their out-of-fold residual."""
    held = huber_factor(materialise(cross_fit_residuals(rows, row_key, by=by, **fit), "residuals"), by=by)
    return held.withColumn("weight", F.coalesce("weight", F.lit(1.0)) * F.coalesce("huber", F.lit(1.0))).drop("fold", "residual", "huber")
