"""Shape of a curve: smoothing, monotone projection, anchors, tapers, ordered bands."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import to_cents
from ..session import materialise

# Share of prices at each end that sets an anchor, anchor weight and offset.
ANCHOR_SHARE = 0.10
ANCHOR_WEIGHT = 1e-3
ANCHOR_OFFSET = 1e-3


def rolling_median(points: DataFrame, value: str, window: int | None, by: str = "product", x: str = "price") -> DataFrame:
    """Centred rolling median in price order, partial at the ends.

    Only odd windows of three or more smooth; a group shorter than the window is left as it is.
    """
    if window is None or window < 3 or window % 2 == 0:
        return points
    reach = window // 2
    near = Window.partitionBy(by).orderBy(x).rowsBetween(-reach, reach)
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    smooth = F.coalesce(F.percentile(value, 0.5).over(near), F.col(value))
    return points.withColumn(value, F.when(size < window, F.col(value)).otherwise(smooth))


def _pooled(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Block number of each entry after pooling neighbours until no block's mean is above the one before.

    The blocks are the edges of the concave hull of the cumulative sums, kept as a stack.
    """
    total, size, first = [], [], []
    for k, (s, n) in enumerate(zip(sums.tolist(), sizes.tolist(), strict=True)):
        at = k
        while total and s * size[-1] > total[-1] * n:
            s, n, at = s + total.pop(), n + size.pop(), first.pop()
        total.append(s)
        size.append(n)
        first.append(at)
    return np.searchsorted(np.array(first), np.arange(len(sums)), "right") - 1


def _hull_of_ranges(by: str):
    """Blocks of each group inside one range of prices: its rows with their block number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a range of bounded size
        if not held:
            return
        table = pa.Table.from_batches(held)
        group = table.column(by).to_pandas()
        starts = np.flatnonzero(np.append(True, (group != group.shift()).to_numpy()[1:]))
        value = table.column("_value").to_numpy()
        block = np.empty(len(table), np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(table)), strict=True):
            block[a:b] = _pooled(value[a:b], np.ones(b - a))
        yield from table.append_column("_block", pa.array(block)).to_batches()

    return work


def _merge_hulls(table: pa.Table) -> pa.Table:
    """Blocks of one group that others reach, pooled over all its ranges."""
    table = table.sort_by([("_part", "ascending"), ("_block", "ascending")])
    total, size = table.column("total").to_numpy(), table.column("size").to_numpy().astype(float)
    block = _pooled(total, size)
    mean = (np.bincount(block, total) / np.bincount(block, size))[block]
    return table.select([0, 1, 2]).append_column("level", pa.array(mean, pa.float64()))


def monotone_curve(
    points: DataFrame, value: str, by: str = "product", x: str = "price", nonneg: bool = False, increasing: bool = False, parts: int | None = None
) -> DataFrame:
    """Closest curve that never rises (or never falls) with price; groups under three points stay.

    `points` has one row for each group and price; rows without a value stay as they are. Points are cut
    into ranges of (group, price), and each range pools its own neighbours. A block then only meets blocks
    of other ranges when one after it is above it or one before it below: those few are pooled again over
    the whole group, the others are final.
    """
    sign = -1.0 if increasing else 1.0
    number = F.col(value).cast("double")
    clean = F.greatest(number, F.lit(0.0)) if nonneg else number
    kind = points.schema[value].dataType
    known = F.col(by).isNotNull() & number.isNotNull() & ~F.isnan(number)
    counts = points.where(known).groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    used = points.where(known).select(by, x, (clean * sign).alias("_value"))
    ranges = used.repartitionByRange(parts, by, x) if parts else used.repartitionByRange(by, x)
    sorted_ = ranges.sortWithinPartitions(by, x).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{n}` {t}" for n, t in sorted_.dtypes) + ", _block long"
    placed = materialise(sorted_.mapInArrow(_hull_of_ranges(by), schema), "ranges")
    blocks = placed.groupBy(by, "_part", "_block").agg(F.sum("_value").alias("total"), F.count(F.lit(1)).alias("size"))
    blocks = materialise(blocks.withColumn("mean", F.col("total") / F.col("size")), "blocks")
    # one row for each group and range
    ends = blocks.groupBy(by, "_part").agg(F.max("mean").alias("top"), F.min("mean").alias("low"))
    order = Window.partitionBy(by).orderBy("_part")
    reach = ends.select(
        by,
        "_part",
        F.max("top").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"),
        F.min("low").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
    )
    met = blocks.join(reach, [by, "_part"])
    open_ = F.coalesce(F.col("mean") < F.col("above"), F.lit(False)) | F.coalesce(F.col("mean") > F.col("below"), F.lit(False))
    key_type = dict(points.dtypes)[by]
    merged = met.where(open_).select(by, "_part", "_block", "total", "size").groupBy(by).applyInArrow(
        _merge_hulls, f"`{by}` {key_type}, _part int, _block long, level double"
    )
    levels = met.where(~open_).select(by, "_part", "_block", F.col("mean").alias("level")).unionByName(merged)
    fitted = placed.join(levels, [by, "_part", "_block"]).select(by, x, (F.col("level") * sign).alias("_level"))
    out = points.join(counts, by, "left").join(fitted, [by, x], "left")
    shown = F.when(F.col("_n") >= 3, F.coalesce("_level", clean)).otherwise(clean)
    return out.withColumn(value, F.when(known, shown).otherwise(number).cast(kind)).select(*points.columns)


def anchor_rows(rows: DataFrame, value: str = "shipped_units", by: str = "product") -> DataFrame:
    """Two light rows for each group, just outside its price range.

    Their value is the median of the lowest and highest tenth of prices.
    """
    spots = rows.groupBy(by, to_cents(F.col("price")).alias("cents"), F.col(value).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cents = F.col("cents").cast("double")
    ends = spots.groupBy(by).agg(
        F.percentile(cents, [ANCHOR_SHARE, 1 - ANCHOR_SHARE], F.col("n")).alias("q"),
        F.min(cents).alias("low"),
        F.max(cents).alias("high"),
    )
    met = spots.join(ends, by)
    low_value = F.percentile(F.when(cents <= F.col("q")[0], F.col("value")), 0.5, F.col("n"))
    high_value = F.percentile(F.when(cents >= F.col("q")[1], F.col("value")), 0.5, F.col("n"))
    medians = met.groupBy(by, "low", "high").agg(low_value.alias("low_value"), high_value.alias("high_value"))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    margin = F.lit(ANCHOR_OFFSET) * span
    ends_array = F.array(
        F.struct(((F.col("low") - margin) / 100.0).alias("price"), F.col("low_value").alias("value")),
        F.struct(((F.col("high") + margin) / 100.0).alias("price"), F.col("high_value").alias("value")),
    )
    anchored = medians.select(by, F.explode(ends_array).alias("a"))
    return anchored.select(by, "a.price", F.col("a.value").alias(value), F.lit(ANCHOR_WEIGHT).alias("weight"))


def with_anchors(rows: DataFrame, value: str = "shipped_units", by: str = "product") -> DataFrame:
    """Model rows (group, price, value, weight 1) followed by the anchor rows."""
    plain = rows.select(
        by, F.col("price").cast("double").alias("price"), F.col(value).cast("double").alias(value), F.lit(1.0).alias("weight")
    )
    return plain.unionByName(anchor_rows(rows, value, by))


def edge_taper(price: Column, low: Column, high: Column, stretch: float = 0.25) -> Column:
    """Factor that falls off beyond [low, high]: exp(-distance / (stretch * (high - low)))."""
    width = F.lit(stretch) * F.when(high > low, high - low).otherwise(1.0)
    beyond = F.greatest(low - price, price - high, F.lit(0.0))
    return F.exp(-beyond / width)


def taper_edges(
    curve: DataFrame, columns: list[str], tail: float = 0.10, stretch: float = 0.25, by: str = "product"
) -> DataFrame:
    """Shrink predictions beyond the outer price quantiles of the group."""
    spots = curve.groupBy(by, "price").agg(F.count(F.lit(1)).alias("n"))
    anchors = spots.groupBy(by).agg(F.percentile("price", [tail, 1 - tail], F.col("n")).alias("q"))
    met = curve.join(anchors, by)
    factor = edge_taper(F.col("price"), F.col("q")[0], F.col("q")[1], stretch)
    return met.withColumns({c: F.col(c) * factor for c in columns}).drop("q")


def ordered_bands(curve: DataFrame, low: str, middle: str, high: str) -> DataFrame:
    """Bands that never cross: the three values in ascending order; a row that lacks one stays as it is."""
    known = F.col(low).isNotNull() & F.col(middle).isNotNull() & F.col(high).isNotNull()
    out = curve.withColumn("_o", F.when(known, F.array_sort(F.array(low, middle, high))).otherwise(F.array(low, middle, high)))
    return out.withColumns({low: F.col("_o")[0], middle: F.col("_o")[1], high: F.col("_o")[2]}).drop("_o")
