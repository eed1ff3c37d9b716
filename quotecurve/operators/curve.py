"""Demand curves: expectile spline fits for each product, and their scoring.

The fit is least squares on ln(1+units) with a cubic spline of ln(1+price) and a linear
event term. Rows only ever add to sums of their spline cell; the small linear system of a
product is solved from those sums. So a product may own any share of the rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import expm1_floor, log1p_floor, usable_weight
from ..session import discard, materialise, scratch_folder, steps, write_table
from .joins import lookup_join, salted_join

# Fixed values of the fit.
EXPECTILES = (0.025, 0.5, 0.975)
SMOOTHING = 0.5
EVENT_PENALTY = 0.6
MIN_SPLINES = 4
MIN_PRICES = 3
MAX_ROUNDS = 500  # beyond this a curve is reported as not converged
GRID_POINTS = 100  # prices of a grid
FEW_CURVES = 30_000  # so many open curves at most are sent to every task: 40 numbers each, or 10 MB
# names of the expectiles in column names
BAND = {0.025: "p025", 0.5: "p50", 0.975: "p975"}

_TOLERANCE = 1e-6
_RIDGE = 1e-8
_TERMS = 5  # four spline weights and the event term
_PAIRS = [(i, j) for i in range(_TERMS) for j in range(i, _TERMS)]
_UPPER = np.triu_indices(_TERMS)

MODEL_SCHEMA = (
    "product string, q double, lo double, hi double, n_splines int, beta array<double>, event_coef double, status string"
)


def spline_cell(x: Column, lo: Column, hi: Column, n_splines: Column) -> tuple[Column, Column]:
    """(cell, position in the cell) of x, clamped to [lo, hi], for uniform knots."""
    inside = F.least(F.greatest(x, lo), hi)
    place = (inside - lo) / ((hi - lo) / (n_splines - 3))
    cell = F.least(F.floor(place).cast("int"), n_splines - 4)
    return cell, place - cell


def spline_weights(t: Column) -> list[Column]:
    """The four cubic B-spline weights at position t of a cell."""
    u = F.lit(1.0) - t
    return [
        u * u * u / 6,
        (3 * t * t * t - 6 * t * t + 4) / 6,
        (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6,
        t * t * t / 6,
    ]


def spline_value(beta: Column, cell: Column, t: Column) -> Column:
    parts = [F.get(beta, cell + i) * w for i, w in enumerate(spline_weights(t))]
    return parts[0] + parts[1] + parts[2] + parts[3]


def default_splines(n_prices: Column) -> Column:
    """Half the distinct prices, between 3 and 6, and at least the four a cubic needs."""
    return F.greatest(F.least(F.floor(n_prices / 2).cast("int"), F.lit(6)), F.lit(MIN_SPLINES))


def training_rows(rows: DataFrame, weight: str | None = "weight", by: str = "product") -> DataFrame:
    """(group, x, e, y, w) of the rows that a fit can use: logarithms of price and units, event and weight."""
    w = usable_weight(F.col(weight)) if weight else F.lit(1.0)
    keyed = rows.select(
        by,
        log1p_floor(F.col("price").cast("double")).alias("x"),
        F.coalesce(F.col("event_code").cast("double"), F.lit(0.0)).alias("e"),
        log1p_floor(F.col("shipped_units").cast("double")).alias("y"),
        w.alias("w"),
    )
    return keyed.dropna(subset=[by, "x", "y"])


def training_points(rows: DataFrame, weight: str | None = "weight", by: str = "product") -> DataFrame:
    """Distinct (group, price, event, units) with their total weight: the exact fit input."""
    return training_rows(rows, weight, by).groupBy(by, "x", "e", "y").agg(F.sum("w").alias("w"))


def curve_ranges(points: DataFrame, n_splines: int | None = None, by: str = "product") -> DataFrame:
    """(group, lo, hi, n_splines, n_prices) of each group, from its training rows or points."""
    prices = points.groupBy(by, "x").agg(F.count(F.lit(1)).alias("n"))
    ranges = prices.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n_prices"))
    count = F.lit(max(n_splines, MIN_SPLINES)) if n_splines else default_splines(F.col("n_prices"))
    return ranges.withColumn("n_splines", count.cast("int"))


def _solve_one(ns: int, cells, smoothing: float, event_penalty: float) -> np.ndarray:
    """Coefficients of one curve from the sums of its cells (at most ns - 3 of them)."""
    a = np.zeros((ns + 1, ns + 1))
    b = np.zeros(ns + 1)
    for c in cells:
        at = np.array([*range(c["cell"], c["cell"] + 4), ns])
        block = np.zeros((_TERMS, _TERMS))
        block[_UPPER] = c["sums"]
        a[np.ix_(at, at)] += block + np.triu(block, 1).T
        b[at] += c["rhs"]
    second = np.diff(np.eye(ns), n=2, axis=0)
    a[:ns, :ns] += smoothing * second.T @ second
    a[ns, ns] += event_penalty
    a += _RIDGE * np.eye(ns + 1)
    return np.linalg.solve(a, b)


def _solved(ns: int, cells, smoothing: float, event_penalty: float) -> np.ndarray | None:
    try:
        coef = _solve_one(ns, cells, smoothing, event_penalty)
    except np.linalg.LinAlgError:
        return None
    return coef if np.isfinite(coef).all() else None


def _solver(smoothing: float, event_penalty: float):
    """Solves each curve of a round and tells how far its coefficients moved."""

    def moved(coef, before) -> float:
        if coef is None:
            return 0.0
        return np.inf if before is None else float(np.max(np.abs(coef - before)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coefs = [_solved(ns, cells, smoothing, event_penalty) for ns, cells in zip(pdf["n_splines"], pdf["cells"])]
            changes = [moved(c, before) for c, before in zip(coefs, pdf["before"])]
            yield pdf.drop(columns=["n_splines", "cells", "before"]).assign(coef=coefs, change=changes)

    return solve


def place_points(points: DataFrame, ranges: DataFrame, by: str, spread_by: list[str]) -> DataFrame:
    """`points` (group, x, e, ...) of the groups in `ranges`, with n_splines, cell and the five terms z."""
    cell, t = spline_cell(F.col("x"), F.col("lo"), F.col("hi"), F.col("n_splines"))
    met = lookup_join(points, ranges.select(by, "lo", "hi", "n_splines"), on=[by], spread_by=spread_by, how="inner")
    placed = met.withColumns({"cell": cell, "t": t})
    return placed.withColumn("z", F.array(*spline_weights(F.col("t")), F.col("e"))).drop("lo", "hi", "t", "x", "e")


def fitted_value(coef: Column, cell: Column, z: Column, n_splines: Column) -> Column:
    """Value of a curve with its event term at a placed point."""
    at = [F.get(coef, cell + i) * z[i] for i in range(4)]
    return at[0] + at[1] + at[2] + at[3] + F.get(coef, n_splines) * z[4]


def cell_sums(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of a spline cell that determine the least squares fit: rows (keys, n_splines, cell, sums, rhs)."""
    return terms.groupBy(*keys, "n_splines", "cell").agg(
        F.array(*[F.sum(F.col("w") * F.col("z")[i] * F.col("z")[j]) for i, j in _PAIRS]).alias("sums"),
        F.array(*[F.sum(F.col("w") * F.col("z")[i] * F.col("y")) for i in range(_TERMS)]).alias("rhs"),
    )


def _fit_round(placed: DataFrame, models: DataFrame, by: str, first: bool, few: bool, smoothing: float, event_penalty: float) -> DataFrame:
    """Curves `models` (group, rep, q, coef) solved once more; groups without a model here are not read.

    Where they are `few` they go to the points, which then stay where they are.
    """
    keys = [by, "rep", "q"]
    table = models.groupBy(by).agg(F.collect_list(F.struct("rep", "q", "coef")).alias("models"))
    met = placed.join(F.broadcast(table), by) if few else salted_join(placed, table, on=[by], spread_by=["y", "cell"], how="inner")
    each = met.withColumn("m", F.explode("models"))
    each = each.withColumn("w", F.get("ws", F.col("m.rep"))).where("w > 0")
    side = F.lit(0.5)
    if not first:
        fitted = fitted_value(F.col("m.coef"), F.col("cell"), F.col("z"), F.col("n_splines"))
        side = F.when(F.col("y") > fitted, F.col("m.q")).otherwise(F.lit(1.0) - F.col("m.q"))
    w = F.col("w") * F.when(F.col("m.q") == 0.5, F.col("y")).otherwise(1.0) * side
    terms = each.select(by, "n_splines", "cell", "z", "y", F.col("m.rep").alias("rep"), F.col("m.q").alias("q"), w.alias("w"))
    cells = cell_sums(terms, keys).groupBy(*keys, "n_splines").agg(F.collect_list(F.struct("cell", "sums", "rhs")).alias("cells"))
    cells = cells.join(models.select(*keys, F.col("coef").alias("before")), keys)
    return cells.mapInPandas(_solver(smoothing, event_penalty), f"{by} string, rep int, q double, coef array<double>, change double")


def fit_rounds(
    placed: DataFrame,
    by: str,
    expectiles: tuple[float, ...],
    reps: int = 1,
    smoothing: float = SMOOTHING,
    event_penalty: float = EVENT_PENALTY,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Curves (group, rep, q, coef, change, rounds) of the placed points with weights `ws`, one for each replicate.

    Each round reweights the points by the side of the curve they lie on (asymmetric least squares) for
    the curves that still move, all replicates and expectiles of a group in one pass. A curve that has
    settled, or cannot be solved, leaves the loop: its group's points are read again only for others. A
    round's table is deleted when the next one is written.
    """
    spark = placed.sparkSession
    home = scratch_folder(spark, "fit")
    kinds = f"{by} string, rep int, q double, coef array<double>, change double"
    grid = [F.struct(F.lit(r).alias("rep"), F.lit(float(q)).alias("q")) for r in range(reps) for q in expectiles]
    groups = materialise(placed.select(by).distinct(), "groups")
    n_open = groups.count() * len(grid)
    models = groups.withColumn("m", F.explode(F.array(*grid))).select(by, "m.rep", "m.q", F.lit(None).cast("array<double>").alias("coef"))
    written, before = [], None
    for k in range(max_rounds + 1):
        path = f"{home}/round-{k}"
        write_table(_fit_round(placed, models, by, k == 0, n_open <= FEW_CURVES, smoothing, event_penalty), path)
        now = spark.read.schema(kinds).parquet(path)
        settled = F.col("coef").isNull() | (F.col("change") < _TOLERANCE)
        over = F.lit(k == max_rounds) | settled
        counts = now.agg(F.count_if(over).alias("over"), F.count_if(~over).alias("open")).first()
        if counts["over"]:
            written.append(f"{home}/over-{k}")
            now.where(over).withColumn("rounds", F.lit(k)).coalesce(max(1, min(8, counts["over"] // 50_000 + 1))).write.parquet(written[-1])
        if before:
            discard(spark, before)
        before = path
        if not counts["open"]:
            break
        models, n_open = now.where(~over).select(by, "rep", "q", "coef"), counts["open"]
    if before:
        discard(spark, before)
    kinds += ", rounds int"
    return spark.read.schema(kinds).parquet(*written) if written else spark.createDataFrame([], kinds)


def fit_curves(
    rows: DataFrame,
    n_splines: int | None = None,
    smoothing: float = SMOOTHING,
    event_penalty: float = EVENT_PENALTY,
    weight: str | None = "weight",
    by: str = "product",
    expectiles: tuple[float, ...] = EXPECTILES,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Model table: one row for each group and expectile.

    `rows` has the group, price, shipped_units, event_code and a weight. The weight is
    multiplied by ln(1+units) for the middle expectile. Groups with fewer than three
    distinct prices get status 'too_few_prices' and no curve, one that cannot be solved
    'failed', one that still moves after the last round 'not_converged'; the others go on.
    """
    points = training_points(rows, weight, by)
    ranges = materialise(curve_ranges(training_rows(rows, weight, by), n_splines, by), "ranges")
    placed = place_points(points, ranges.where(F.col("n_prices") >= MIN_PRICES), by, ["x", "y", "e"])
    # a table, not a checkpoint: read by every round, which needs only some columns of it, and deleted after the last
    with steps(rows.sparkSession):
        placed = materialise(placed.withColumn("ws", F.array("w")).drop("w"), "fit_points")
        models = fit_rounds(placed, by, expectiles, 1, smoothing, event_penalty, max_rounds)
    return with_states(models.drop("rep", "rounds"), ranges, by, expectiles)


def with_states(models: DataFrame, ranges: DataFrame, by: str, expectiles: tuple[float, ...]) -> DataFrame:
    """Model table of solved curves and of the groups that have too few prices."""
    fitted = models.join(ranges, by).select(
        *[c for c in models.columns if c not in ("coef", "change")],
        "lo",
        "hi",
        "n_splines",
        F.slice("coef", 1, F.col("n_splines")).alias("beta"),
        F.element_at("coef", -1).alias("event_coef"),
        F.when(F.col("coef").isNull(), "failed")
        .when(F.col("change") < _TOLERANCE, "fitted")
        .otherwise("not_converged")
        .alias("status"),
    )
    skipped = ranges.where(F.col("n_prices") < MIN_PRICES).withColumn(
        "q", F.explode(F.array(*[F.lit(float(q)) for q in expectiles]))
    )
    skipped = skipped.select(
        by,
        "q",
        "lo",
        "hi",
        "n_splines",
        F.lit(None).cast("array<double>").alias("beta"),
        F.lit(None).cast("double").alias("event_coef"),
        F.lit("too_few_prices").alias("status"),
    )
    return fitted.unionByName(skipped, allowMissingColumns=True)


def normal_equations(rows: DataFrame, models: DataFrame, weight: str | None = "weight", smoothing: float = SMOOTHING, by: str = "product") -> DataFrame:
    """(group, q, term, gap): what the spline equations of fitted curves leave over, relative to their size.

    Zero for a curve that minimises its loss: for each coefficient, the weighted sum of its term times the
    rest of the points equals the pull of the penalty.
    """
    points = training_points(rows, weight, by)
    one = models.where("status = 'fitted'").select(by, "q", "lo", "hi", "n_splines", "event_coef", "beta")
    table = one.groupBy(by).agg(F.collect_list(F.struct(*one.columns[1:])).alias("models"))
    each = lookup_join(points, table, on=[by], spread_by=["x", "y", "e"], how="inner").withColumn("m", F.explode("models"))
    cell, t = spline_cell(F.col("x"), F.col("m.lo"), F.col("m.hi"), F.col("m.n_splines"))
    placed = each.withColumns({"cell": cell, "t": t})
    value = spline_value(F.col("m.beta"), F.col("cell"), F.col("t")) + F.col("m.event_coef") * F.col("e")
    side = F.when(F.col("y") > value, F.col("m.q")).otherwise(F.lit(1.0) - F.col("m.q"))
    w = F.col("w") * F.when(F.col("m.q") == 0.5, F.col("y")).otherwise(1.0) * side
    terms = F.array(*[F.struct((F.col("cell") + i).alias("term"), z.alias("z")) for i, z in enumerate(spline_weights(F.col("t")))])
    parts = placed.select(by, F.col("m.q").alias("q"), w.alias("w"), (F.col("y") - value).alias("rest"), "y", F.explode(terms).alias("p"))
    sums = parts.groupBy(by, "q", F.col("p.term").alias("term")).agg(
        F.sum(F.col("w") * F.col("p.z") * F.col("rest")).alias("data"), F.sum(F.col("w") * F.col("p.z") * (F.abs("y") + 1)).alias("size")
    )

    def bend(k: Column) -> Column:  # second difference of the coefficients around place k, 0 beyond the ends
        inside = (k >= 0) & (k + 2 < F.col("n_splines"))
        return F.when(inside, F.get("beta", k) - 2 * F.get("beta", k + 1) + F.get("beta", k + 2)).otherwise(0.0)

    term = F.col("term")
    pull = F.lit(smoothing) * (bend(term - 2) - 2 * bend(term - 1) + bend(term)) + F.lit(_RIDGE) * F.get("beta", term)
    wanted = one.withColumn("term", F.explode(F.sequence(F.lit(0), F.col("n_splines") - 1)))
    joined = wanted.join(sums, [by, "q", "term"], "left")
    gap = (F.coalesce("data", F.lit(0.0)) - pull) / (F.coalesce("size", F.lit(0.0)) + F.abs(pull) + 1)
    return joined.select(by, "q", "term", gap.alias("gap"))


def score_curves(
    rows: DataFrame, models: DataFrame, price: str = "price", by: str = "product", spread_by: list[str] | None = None
) -> DataFrame:
    """Predicted units and revenue of each row, with its event and at the baseline event.

    Adds units_*, units_bau_*, revenue_* and revenue_bau_* for each expectile. Rows of a
    group without a model pass through with NULL predictions. All in built-in expressions.
    """
    table = models.where(F.col("status") == "fitted").groupBy(by).agg(
        F.first("lo").alias("_lo"),
        F.first("hi").alias("_hi"),
        F.first("n_splines").alias("_ns"),
        *[
            F.max(F.when(F.col("q") == q, F.struct("event_coef", "beta"))).alias(f"_{name}")
            for q, name in BAND.items()
        ],
    )
    spread = spread_by or [c for c in ("item_id", "period_start", "event_name", price) if c in rows.columns]
    joined = lookup_join(rows, table, on=[by], spread_by=spread)
    p = F.col(price).cast("double")
    cell, t = spline_cell(log1p_floor(p), F.col("_lo"), F.col("_hi"), F.col("_ns"))
    placed = joined.withColumns({"_cell": cell, "_t": t})
    event = F.coalesce(F.col("event_code").cast("double"), F.lit(0.0)) if "event_code" in rows.columns else F.lit(0.0)
    units = {}
    for name in BAND.values():
        base = spline_value(F.col(f"_{name}.beta"), F.col("_cell"), F.col("_t"))
        units[f"units_{name}"] = expm1_floor(base + F.col(f"_{name}.event_coef") * event)
        units[f"units_bau_{name}"] = expm1_floor(base)
    out = placed.withColumns(units)
    revenue = {}
    for name in BAND.values():
        revenue[f"revenue_{name}"] = p * F.col(f"units_{name}")
        revenue[f"revenue_bau_{name}"] = p * F.col(f"units_bau_{name}")
    hidden = ["_lo", "_hi", "_ns", "_cell", "_t", *[f"_{n}" for n in BAND.values()]]
    return out.withColumns(revenue).drop(*hidden)


def price_grid(models: DataFrame, points: int = GRID_POINTS, by: str = "product") -> DataFrame:
    """(group, price): evenly spaced prices, to the cent, over the range each fitted curve was trained on."""
    cents = lambda c: F.round(F.expm1(F.col(c)) * 100).cast("long")
    ends = models.where("status = 'fitted'").groupBy(by).agg(F.min(cents("lo")).alias("low"), F.max(cents("hi")).alias("high"))
    place = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    spots = ends.withColumn("place", place).select(by, (F.col("low") + F.expr(f"(high - low) * place div {points - 1}")).alias("cents"))
    return spots.distinct().select(by, (F.col("cents") / 100.0).alias("price"))


def score_grid(models: DataFrame, points: int = GRID_POINTS, by: str = "product", event_code: int = 0) -> DataFrame:
    """Predictions on the price grid, without observed rows: the curve of each product between its outer prices."""
    grid = price_grid(models, points, by).withColumn("event_code", F.lit(event_code))
    return score_curves(grid, models, by=by, spread_by=["price"]).drop("event_code")
