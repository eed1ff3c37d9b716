"""Observation weights: recency, price support, normalising and robustness."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import to_cents
from ..functions.numeric import WEIGHT_FLOOR, usable_weight
from ..session import materialise, steps
from .joins import lookup_join
from .ranks import quantiles

# Half-life of an observation in days, clip quantiles, neighbours.
HALF_LIFE_DAYS = 90
CLIP_QUANTILES = (0.05, 0.95)
NEIGHBOURS = 15
# Ranges of the rescaled support weights.
SUPPORT_LOW = 0.25
PRIOR_LOW = 0.2
# Fixed value: smallest radius that is divided by.
SMALLEST_RADIUS = 2.220446049250313e-16
# Bandwidth search.
BANDWIDTHS = 15
# Price bins of the smoothed histogram, and how many on each side are averaged.
DENSITY_BINS = 50
DENSITY_REACH = 2
FOLDS = 5

_TERMS = 20  # series terms of the kernel sums
_REACH = 9  # cells on each side; a kernel further away is below 1e-17
_TILE = 64  # neighbouring cells whose sums are gathered at once
_BLOCK = 4096  # prices in cents that meet the cells around them at once
_LEFT_OUT = 28.0  # what lies further out weighs less than exp(-28) of the sum
_SMALL_MASS = 1e-3  # below this the series is too coarse in relation, and the sum is taken in logarithms


def time_weight(rows: DataFrame, day: str = "period_start", half_life: float | None = HALF_LIFE_DAYS) -> DataFrame:
    """Adds `time_weight`: halves every `half_life` days before the last day; 1 without a half-life.

    A row without a date gets the median age.
    """
    if half_life is None:
        return rows.withColumn("time_weight", F.lit(1.0))
    last = rows.agg(F.max(day).alias("last")).scalar()
    ages = rows.withColumn("_age", F.datediff(last, F.col(day)))
    median = (
        ages.where(F.col("_age").isNotNull())
        .groupBy("_age")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.percentile(F.col("_age").cast("double"), 0.5, F.col("n")).alias("median"))
    )
    age = F.greatest(F.coalesce(F.col("_age").cast("double"), median.scalar(), F.lit(0.0)), F.lit(0.0))
    return ages.withColumn("time_weight", F.pow(F.lit(0.5), age / F.lit(max(1.0, float(half_life))))).drop("_age")


def normalise_weight(rows: DataFrame, weight: str, clip: tuple[float, float] = CLIP_QUANTILES) -> DataFrame:
    """Divide by the median, clip to two quantiles, repair unusable values."""
    counts = rows.where(F.col(weight).isNotNull()).groupBy(weight).agg(F.count(F.lit(1)).alias("_n"))
    cuts = quantiles(counts, weight, "_n", [0.5, *clip]).scalar()
    out = rows.withColumn("_cuts", cuts)
    scale = F.when(F.col("_cuts")[0] > 0, F.col("_cuts")[0]).otherwise(1.0)
    low, high = F.col("_cuts")[1] / scale, F.col("_cuts")[2] / scale
    scaled = F.col(weight) / scale
    clipped = F.when(high > low, F.least(F.greatest(scaled, low), high)).otherwise(scaled)
    return out.withColumn(weight, usable_weight(clipped)).drop("_cuts")


def price_counts(rows: DataFrame, by: str = "product", price: str = "price") -> DataFrame:
    """Rows at each price of each group, in cents: bounded by the price range, not by the rows."""
    return rows.groupBy(by, to_cents(F.col(price)).alias("cents")).agg(F.count(F.lit(1)).alias("n"))


def rescale(values: DataFrame, column: str, by: str, low: float) -> Column:
    """Min-max position inside the group, mapped to [low, 1]; a flat group gives 1."""
    group = Window.partitionBy(by)
    span = F.max(column).over(group) - F.min(column).over(group)
    position = (F.col(column) - F.min(column).over(group)) / span
    return F.when(span < 1e-12, 1.0).otherwise(F.lit(low) + F.lit(1.0 - low) * position)


def neighbour_support(rows: DataFrame, k: int = NEIGHBOURS, by: str = "product") -> DataFrame:
    """(group, cents, radius, support): inverse distance to the k-th nearest observation.

    The k nearest observations lie within k distinct prices on each side, so a row frame
    over the price counts is enough.
    """
    counts = price_counts(rows, by)
    group = Window.partitionBy(by)
    around = group.orderBy("cents").rowsBetween(-k, k)
    sized = counts.select(
        by,
        "cents",
        F.sum("n").over(group).alias("size"),
        F.collect_list(F.struct("cents", "n")).over(around).alias("near"),
    )
    wanted = F.least(F.lit(k).cast("bigint"), F.col("size") - 1)
    by_distance = F.array_sort(
        F.transform("near", lambda s: F.struct(F.abs(s["cents"] - F.col("cents")).alias("d"), s["n"].alias("n")))
    )
    reached = F.aggregate(
        by_distance,
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("d")),
        lambda acc, s: F.when(acc["seen"] >= wanted, acc).otherwise(
            F.struct((acc["seen"] + s["n"]).alias("seen"), s["d"].alias("d"))
        ),
    )
    radius = sized.select(by, "cents", "size", (reached["d"] / F.lit(100.0)).alias("radius"))
    dense = radius.withColumn("density", F.lit(1.0) / F.greatest("radius", F.lit(SMALLEST_RADIUS)))
    support = F.when(F.col("size") < max(3, k + 1), 1.0).otherwise(rescale(dense, "density", by, SUPPORT_LOW))
    return dense.select(by, "cents", "radius", support.alias("support"))


def kernel_mass(queries: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of n * exp(-((q - r) / h)^2 / 2) over the references r of the same keys.

    `queries` has keys, cents; `refs` has keys, cents, n, h (one bandwidth in cents for
    each keys). References are summed into cells one bandwidth wide as the moments of a
    Hermite series (fast Gauss transform); a query reads only its neighbouring cells, so
    work grows with prices, not with pairs of prices. Error is below 1e-12.
    """
    place = F.col("cents") / F.col("h")
    cells = refs.withColumn("cell", F.floor(place)).withColumn("s", place - F.col("cell") - 0.5)
    moments, factorial = [], 1.0
    for k in range(_TERMS):
        factorial *= max(k, 1)
        moments.append(F.sum(F.col("n") * F.pow("s", F.lit(k)) / F.lit(factorial)))
    cells = cells.groupBy(*keys, "h", "cell").agg(F.array(*moments).alias("moments"))
    widths = refs.select(*keys, "h").distinct()
    asked = (
        queries.join(widths, keys)
        .withColumn("own", F.floor(place))
        .withColumn("cell", F.explode(F.sequence(F.col("own") - _REACH, F.col("own") + _REACH)))
        .drop("own")
    )
    met = asked.join(cells.drop("h"), [*keys, "cell"])
    u = F.col("cents") / F.col("h") - F.col("cell") - 0.5
    series = F.aggregate(
        "moments",
        F.struct(
            F.lit(0.0).alias("k"), F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("total")
        ),
        lambda acc, m: F.struct(
            (acc["k"] + 1.0).alias("k"),
            acc["he"].alias("before"),
            (u * acc["he"] - acc["k"] * acc["before"]).alias("he"),
            (acc["total"] + m * acc["he"]).alias("total"),
        ),
    )["total"]
    return met.groupBy(*[c for c in queries.columns], "h").agg(F.sum(series * F.exp(-u * u / 2)).alias("mass"))


def _spread(counts: DataFrame, by: str) -> DataFrame:
    """Observations and population standard deviation (in cents) of each group."""
    n, x = F.col("n").cast("double"), F.col("cents").cast("double")
    sums = counts.groupBy(by).agg(F.sum(n).alias("size"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"))
    variance = F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("size")) / F.col("size"), F.lit(0.0))
    return sums.select(by, "size", F.sqrt(variance).alias("sd"))


def support_prior(rows: DataFrame, bandwidth: float | None = None, by: str = "product") -> DataFrame:
    """(group, cents, prior): Gaussian density of prices, rescaled to [0.2, 1].

    Bandwidth in money, or 1.06 * sd * n^(-1/5); groups under five observations get 1.
    """
    counts = price_counts(rows, by)
    spread = _spread(counts, by).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(100.0))
    rule = F.lit(1.06) * F.col("sd") * F.pow("size", F.lit(-0.2))
    h = F.lit(bandwidth * 100.0) if bandwidth else rule
    refs = counts.join(spread.select(by, "size", h.alias("h")), by)
    mass = kernel_mass(counts.select(by, "cents"), refs.drop("size"), [by]).join(spread.select(by, "size"), by)
    dense = mass.withColumn("density", F.col("mass") / F.col("size") / F.lit((2 * 3.141592653589793) ** 0.5))
    prior = F.when(F.col("size") < 5, 1.0).otherwise(rescale(dense, "density", by, PRIOR_LOW))
    return dense.select(by, "cents", prior.alias("prior"))


def _shifts() -> np.ndarray:
    """For each distance in cells: what turns a cell's moments into the Taylor series of their sum around another cell."""
    shifts = np.zeros((2 * _REACH + 1, _TERMS, _TERMS))
    for d in range(-_REACH, _REACH + 1):
        hermite = [1.0, float(d)]
        for k in range(1, 2 * _TERMS):
            hermite.append(d * hermite[k] - k * hermite[k - 1])
        factorial = 1.0
        for j in range(_TERMS):
            factorial *= max(j, 1)
            for k in range(_TERMS):
                shifts[d + _REACH, k, j] = (-1.0) ** k * hermite[k + j] * np.exp(-d * d / 2) / factorial
    return shifts


def _placed(pdf: pd.DataFrame, i: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bandwidth i of the block's group; the cell of each price, one bandwidth wide, and its place around the middle."""
    low, high = np.log(pdf["low"].iloc[0]), np.log(pdf["high"].iloc[0])
    h = float(np.exp(low + (high - low) * i / (BANDWIDTHS - 1)))
    place = pdf["cents"].to_numpy() / h
    cell = np.floor(place)
    return h, cell.astype(np.int64), place - cell - 0.5


def _block_moments(by: str):
    """Moments of a block's prices by bandwidth, cell and fold, for each tile that their cell reaches."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for i in range(BANDWIDTHS):
            _, cell, s = _placed(pdf, i)
            cells, at = np.unique(cell, return_inverse=True)
            spot = at * FOLDS + pdf["fold"].to_numpy()
            weight, moments = pdf["n"].to_numpy().astype(float), []
            for k in range(_TERMS):
                moments.append(np.bincount(spot, weight, len(cells) * FOLDS))
                weight = weight * s / (k + 1)
            held = np.flatnonzero(moments[0])
            told = pd.DataFrame({"i": i, "cell": cells[held // FOLDS], "fold": held % FOLDS, "moments": [*np.stack(moments, axis=1)[held]]})
            told["first"], told["last"] = ((told["cell"] + d) // _TILE for d in (-_REACH, _REACH))
            parts += [told.assign(tile=told["first"]), told.query("last != first").assign(tile=lambda t: t["last"])]
        return pd.concat(parts).drop(columns=["first", "last"]).assign(**{by: pdf[by].iloc[0], "block": pdf["block"].iloc[0]})

    return work


def _held_out_series(by: str):
    """For each cell of a tile and each fold: the series of the kernel sum of all other folds around the cell."""
    shifts = _shifts()
    others = 1.0 - np.eye(FOLDS)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["tile"].iloc[0]) * _TILE
        at = pdf["cell"].to_numpy() - first
        moments = np.zeros((FOLDS, _TILE + 2 * _REACH, _TERMS))
        np.add.at(moments, (pdf["fold"].to_numpy(), at + _REACH), np.stack(pdf["moments"].to_numpy()))
        series = sum(moments[:, k : k + _TILE] @ shift for k, shift in enumerate(shifts))
        held = np.tensordot(others, series, axes=1)  # sums of the others, not differences from all: nothing cancels
        own = pdf.assign(at=at)[(at >= 0) & (at < _TILE)].drop_duplicates(["at", "block"])
        told = pd.Series([*held[:, own["at"]].transpose(1, 0, 2).reshape(len(own), FOLDS * _TERMS)], own.index, object)
        return own.assign(series=told)[[by, "i", "cell", "block", "series"]]

    return work


def _block_scores(by: str):
    """Sum of the log likelihood of a block's prices for each bandwidth (`held` -1), and the prices far from all others."""

    def work(prices: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if prices.empty:
            return pd.DataFrame()
        fold, n = prices["fold"].to_numpy(), prices["n"].to_numpy()
        train = prices["all"].to_numpy() - np.stack(prices["sizes"].to_numpy())[np.arange(len(n)), fold]
        parts = []
        for i, of in cells.groupby("i"):
            h, cell, s = _placed(prices, i)
            of = of.sort_values("cell")
            series = np.stack(of["series"].to_numpy()).reshape(len(of), FOLDS, _TERMS)
            told = series[np.searchsorted(of["cell"].to_numpy(), cell), fold]
            mass = np.zeros(len(n))
            for k in reversed(range(_TERMS)):
                mass = mass * s + told[:, k]
            near, far = (train > 0) & (mass >= _SMALL_MASS), (train > 0) & ~(mass >= _SMALL_MASS)
            score = (n[near] * (np.log(mass[near]) - np.log(train[near] * h * np.sqrt(2 * np.pi)))).sum()
            if near.any():
                parts.append(pd.DataFrame({"i": [i], "h": h, "held": -1, "cents": 0, "n": 0, "train_size": 0, "score": score}))
            left = prices.loc[far, ["cents", "n"]].assign(i=i, h=h, held=fold[far], train_size=train[far], score=0.0)
            parts.append(left)
        return pd.concat(parts).assign(**{by: prices[by].iloc[0]})

    return work


def bandwidth_scores(rows: DataFrame, row_key: list[str], by: str = "product") -> DataFrame:
    """Held-out log likelihood of 15 log-spaced bandwidths, five folds by hash of the row key.

    The sums of `kernel_mass`, but a price meets no cell but its own: the moments of the cells around are
    turned into a power series for each cell and held-out fold first (cells are far fewer than prices), and
    only prices and cells are dealt out, not each price for each bandwidth. A task's share is bounded: a
    block of `_BLOCK` cents, a tile of `_TILE` cells.
    """
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *row_key)), 1, 8), 16, 10).cast("bigint"), F.lit(FOLDS))
    counts = rows.groupBy(by, to_cents(F.col("price")).alias("cents"), fold.cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n")
    )
    with steps(rows.sparkSession) as result:
        counts = materialise(counts, "fold_counts")
        own = F.array(*[F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)) for k in range(FOLDS)])
        sizes = counts.groupBy(by).agg(own.alias("sizes"), F.sum("n").alias("all"))
        low = F.greatest(F.lit(0.1), F.lit(0.05) * F.col("sd"))
        high = F.greatest(low * 1.01, F.lit(2.0) * F.col("sd"))
        spread = _spread(counts, by).select(by, low.alias("low"), high.alias("high")).join(sizes, by)
        known = lookup_join(counts.where("cents is not null"), spread, [by], ["cents"], "inner")
        blocks = known.withColumn("block", F.floor(F.col("cents") / F.lit(_BLOCK)))
        key = f"`{by}` {dict(counts.dtypes)[by]}"
        cells = blocks.drop("sizes", "all").groupBy(by, "block").applyInPandas(
            _block_moments(by), f"{key}, block bigint, i int, tile bigint, cell bigint, fold int, moments array<double>"
        )
        series = cells.groupBy(by, "i", "tile").applyInPandas(
            _held_out_series(by), f"{key}, i int, cell bigint, block bigint, series array<double>"
        )
        series = materialise(series, "cell_series")
        told = blocks.groupBy(by, "block").cogroup(series.groupBy(by, "block")).applyInPandas(
            _block_scores(by), f"{key}, i int, h double, held int, cents bigint, n bigint, train_size bigint, score double"
        )
        told = materialise(told, "block_scores")
        queries = told.where("held >= 0").drop("score")
        scores = told.where("held < 0").select(by, "i", "h", "score")
        if queries.limit(1).count():
            scale = F.ln(F.col("train_size") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))
            far = _far_log_mass(queries, counts, by)
            scores = scores.unionByName(far.select(by, "i", "h", (F.col("n") * (F.col("log_mass") - scale)).alias("score")))
        return result(scores.groupBy(by, "i", "h").agg(F.sum("score").alias("score")), "bandwidths")


def _far_log_mass(queries: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """`queries` (group, i, held, cents, h, n, train_size) with log_mass, the logarithm of the kernel sum.

    For prices far from all others of the training folds, whose `counts` are (group, cents, fold, n). The
    nearest price on each side is found in price order; from there cells one bandwidth wide are read outward
    until all that is left weighs less than 1e-12 of the sum, which is taken relative to the nearest price
    and so never underflows.
    """
    keys = [by, "held", "cents"]
    wanted = queries.select(by, "held").distinct()
    train = counts.where("cents is not null").join(wanted, by).where("held != fold")
    refs = train.select(*keys, F.col("cents").alias("ref")).distinct()
    asked = queries.select(*keys, F.lit(None).cast("bigint").alias("ref")).distinct()
    order = Window.partitionBy(by, "held").orderBy("cents")
    before, after = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    sides = refs.unionByName(asked).select(
        *keys, "ref", F.max("ref").over(before).alias("left"), F.min("ref").over(after).alias("right")
    )
    near = sides.where("ref is null").select(*keys, "left", "right")
    cents, h = F.col("cents"), F.col("h")
    least = F.least(cents - F.col("left"), F.col("right") - cents).cast("double")
    met = queries.join(near, keys).withColumn("least", least)
    spread = F.sqrt(F.col("least") * F.col("least") + 2 * h * h * (F.ln("train_size") + _LEFT_OUT))
    none = F.array().cast("array<bigint>")

    def cells(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(F.floor(low / h), F.floor(high / h))).otherwise(none)

    left = F.coalesce(cells(cents - spread, F.col("left").cast("double")), none)
    right = F.coalesce(cells(F.col("right").cast("double"), cents + spread), none)
    reached = met.withColumn("cell", F.explode(F.array_distinct(F.concat(left, right))))
    widths = queries.select(by, "i", "h", "held").distinct()
    placed = counts.where("cents is not null").join(widths, by).where("held != fold")
    placed = placed.select(by, "i", "held", F.col("cents").alias("ref"), F.col("n").alias("ref_n"), F.floor(cents / h).alias("cell"))
    placed = placed.groupBy(by, "i", "held", "cell", "ref").agg(F.sum("ref_n").alias("ref_n"))
    gap = (F.pow(cents - F.col("ref"), F.lit(2.0)) - F.col("least") * F.col("least")) / (2 * h * h)
    total = F.sum(F.col("ref_n") * F.exp(-gap))
    sums = reached.join(placed, [by, "i", "held", "cell"]).groupBy(*queries.columns, "least").agg(total.alias("total"))
    return sums.withColumn("log_mass", F.ln("total") - F.col("least") * F.col("least") / (2 * h * h)).drop("total", "least")


def best_bandwidth(rows: DataFrame, row_key: list[str], by: str = "product") -> DataFrame:
    """(group, h): the bandwidth in cents with the best held-out score, the smaller on ties."""
    scores = bandwidth_scores(rows, row_key, by)
    return scores.groupBy(by).agg(F.max_by("h", F.struct("score", -F.col("i"))).alias("h"))


def density_support(
    rows: DataFrame, bandwidth: float | DataFrame = 1.0, by: str = "product"
) -> DataFrame:
    """(group, cents, support): Gaussian density rescaled to [0.25, 1].

    `bandwidth` is a width in money, or a frame (group, h) in cents; fewer than two
    observations give 1.
    """
    counts = price_counts(rows, by)
    sizes = counts.groupBy(by).agg(F.sum("n").alias("size"))
    if isinstance(bandwidth, DataFrame):
        refs = counts.join(bandwidth, by)
    else:
        refs = counts.withColumn("h", F.lit(bandwidth * 100.0))
    mass = kernel_mass(counts.select(by, "cents"), refs, [by]).join(sizes, by)
    scale = F.col("size") * F.col("h") / F.lit(100.0) * F.lit((2 * 3.141592653589793) ** 0.5)
    dense = mass.withColumn("density", F.col("mass") / scale)
    support = F.when(F.col("size") < 2, 1.0).otherwise(rescale(dense, "density", by, SUPPORT_LOW))
    return dense.select(by, "cents", support.alias("support"))


def with_weights(
    rows: DataFrame,
    half_life: float | None = HALF_LIFE_DAYS,
    support: DataFrame | None = None,
    by: str = "product",
) -> DataFrame:
    """Adds `weight`: recency times support (if a support table is given), normalised."""
    out = time_weight(rows, half_life=half_life)
    if support is not None:
        table = support.select(by, "cents", "support")
        out = out.withColumn("cents", to_cents(F.col("price")))
        out = out.join(table, [by, "cents"], "left").drop("cents")
        raw = F.col("time_weight") * F.coalesce("support", F.lit(1.0))
    else:
        raw = F.col("time_weight")
    return normalise_weight(out.withColumn("weight", raw), "weight").drop("time_weight", "support")


def price_share(rows: DataFrame, by: str = "product") -> DataFrame:
    """(group, cents, share): part of the group's rows at each price."""
    counts = price_counts(rows, by)
    return counts.select(by, "cents", (F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("share"))


def rarity_factor(rows: DataFrame, beta: float = 0.5, cap: float = 1.25, tail: float = 0.10, by: str = "product") -> DataFrame:
    """(group, cents, rarity): boost for rarely seen prices in the tails, at most `cap`.

    (mean share / share)^beta where it exceeds 1, only outside the [tail, 1 - tail]
    quantiles of the group's prices; 1 elsewhere.
    """
    counts = price_counts(rows, by)
    cents = F.col("cents").cast("double")
    limits = counts.groupBy(by).agg(F.avg("n").alias("mean_n"))
    limits = limits.join(quantiles(counts, "cents", "n", [tail, 1 - tail], (by,)).withColumnRenamed("cuts", "q"), by)
    boost = F.least(F.greatest(F.pow(F.col("mean_n") / F.col("n"), F.lit(beta)), F.lit(1.0)), F.lit(cap))
    outside = (cents < F.col("q")[0]) | (cents > F.col("q")[1])
    return counts.join(limits, by).select(by, "cents", F.when(outside, boost).otherwise(1.0).alias("rarity"))


def smoothed_density(counts: DataFrame, bins: int = DENSITY_BINS, reach: int = DENSITY_REACH, by: str = "product") -> DataFrame:
    """(group, bin, density): rows in equal price bins, averaged over `reach` bins on each side, over their mean.

    `counts` has the group, cents and n. A density of one is that of evenly spread rows; a frame over at most
    `bins` rows of a group.
    """
    ends = counts.groupBy(by).agg(F.min("cents").alias("low"), F.max("cents").alias("high"), F.sum("n").alias("size"))
    held = counts.join(ends, by).groupBy(by, "size", price_bin(bins).alias("bin")).agg(F.sum("n").alias("n"))
    near = Window.partitionBy(by).orderBy("bin").rangeBetween(-reach, reach)
    width = F.least(F.col("bin") + reach, F.lit(bins - 1)) - F.greatest(F.col("bin") - reach, F.lit(0)) + 1
    return held.select(by, "bin", (F.sum("n").over(near) / width / (F.col("size") / F.lit(float(bins)))).alias("density"))


def price_bin(bins: int) -> Column:
    """Number of the equal bin that `cents` lies in, between `low` and `high`."""
    place = F.floor((F.col("cents") - F.col("low")) * F.lit(bins) / (F.col("high") - F.col("low")))
    return F.when(F.col("high") > F.col("low"), F.least(place, F.lit(bins - 1))).otherwise(0).cast("int")


def smoothed_rarity(
    rows: DataFrame,
    beta: float = 0.5,
    cap: float = 1.25,
    tail: float = 0.10,
    bins: int = DENSITY_BINS,
    reach: int = DENSITY_REACH,
    by: str = "product",
) -> DataFrame:
    """(group, cents, rarity): boost for thinly sold prices in the tails, by a smoothed price histogram.

    density^-beta between 1 and `cap`, only outside the [tail, 1 - tail] quantiles of the group's prices, and
    in proportion to the distance from the median price (all of it at the furthest price); 1 elsewhere.
    """
    counts = price_counts(rows, by)
    cuts = quantiles(counts, "cents", "n", [tail, 0.5, 1 - tail], (by,)).withColumnRenamed("cuts", "q")
    ends = counts.groupBy(by).agg(F.min("cents").alias("low"), F.max("cents").alias("high"))
    placed = counts.join(ends, by).join(cuts, by).withColumn("bin", price_bin(bins))
    dense = placed.join(smoothed_density(counts, bins, reach, by), [by, "bin"])
    median, cents = F.col("q")[1], F.col("cents").cast("double")
    furthest = F.greatest(median - F.col("low"), F.col("high") - median)
    boost = F.least(F.greatest(F.pow("density", F.lit(-beta)), F.lit(1.0)), F.lit(cap)) - 1
    outside = (cents < F.col("q")[0]) | (cents > F.col("q")[2])
    factor = F.when(outside, F.lit(1.0) + boost * F.abs(cents - median) / furthest).otherwise(1.0)
    return dense.select(by, "cents", factor.alias("rarity"))


def leverage_cap(weights: DataFrame, cap: float = 2.0, reach: int = 5, by: str = "product") -> DataFrame:
    """Weights by price point, none above `cap` times the local mean in price order.

    `weights` has one row for each group and price: `n` observations of mean `weight`.
    """
    near = Window.partitionBy(by).orderBy("cents").rowsBetween(-reach, reach)
    local = F.sum(F.col("weight") * F.col("n")).over(near) / F.sum("n").over(near)
    return weights.withColumn("weight", F.least(F.col("weight"), F.lit(cap) * local))


def huber_factor(residuals: DataFrame, k: float = 1.345, by: str = "product") -> DataFrame:
    """Adds `huber`: min(1, k / |r / s|), with s the scaled median absolute residual of the group."""
    counts = residuals.groupBy(by, F.abs("residual").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.where(F.col("size").isNotNull())
    scales = quantiles(known, "size", "n", [0.5], (by,)).select(by, (F.col("cuts")[0] * 1.4826).alias("scale"))
    joined = lookup_join(residuals, scales, on=[by], spread_by=["item_id", "period_start", "residual"])
    ratio = F.abs("residual") / F.col("scale")
    factor = F.when((F.col("scale") > 0) & (ratio > k), F.lit(k) / ratio).otherwise(1.0)
    return joined.withColumn("huber", factor).drop("scale")


def floor_weight(w: Column) -> Column:
    return F.greatest(w, F.lit(WEIGHT_FLOOR))


def split_by_time(rows: DataFrame, share: float = 0.8, min_rows: int = 5, by: str = "product") -> DataFrame:
    """Adds `split`: rows after the group's `share` quantile of dates are 'test'.

    Where that leaves fewer than `min_rows` test rows, rows are split by hash at the same share.
    """
    day = F.unix_date("period_start").cast("double")
    days = rows.groupBy(by, day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    cuts = days.groupBy(by).agg(F.percentile("day", share, F.col("n")).alias("cut"))
    enough = (
        days.join(cuts, by)
        .groupBy(by, "cut")
        .agg(F.sum(F.when(F.col("day") > F.col("cut"), F.col("n")).otherwise(0)).alias("late"))
    )
    joined = lookup_join(rows, enough, on=[by], spread_by=["item_id", "period_start"])
    key = F.md5(F.concat_ws("|", "item_id", "event_name", F.col("period_start").cast("string"), "month"))
    draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    test = F.when(F.col("late") >= min_rows, day > F.col("cut")).otherwise(draw >= share)
    return joined.withColumn("split", F.when(test, "test").otherwise("train")).drop("cut", "late")
