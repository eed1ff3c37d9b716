"""Joins that hold up when one key owns a large share of the rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

SALTS = 16
SALT = "_salt"
# Lookups of at most so many rows are sent to every task.
SMALL_LOOKUP = 10_000


def _salts(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(SALT))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    salts: int = SALTS,
    parts: int | None = None,
) -> DataFrame:
    """Join many rows to a lookup so that a hot key is split over `salts` tasks.

    Each row takes a salt from the hash of `spread_by` (columns that tell rows of one key
    apart); the lookup is copied once for each salt. Every row still meets every lookup
    row of its key exactly once. The copies come from a cross join, which Spark's size estimate
    counts (an exploded array it does not): only a lookup whose copies are small is broadcast.

    For dimension-like lookups, and for joins whose result is grouped by the join key
    (adaptive skew splitting leaves those alone). A lookup about as large as the rows is
    joined plainly instead: copying it would cost more than adaptive splitting does.

    With `parts` both sides are spread over that many tasks and merged: for rows that are
    multiplied after the join, where task counts picked by input bytes would be too low.
    """
    left, right = salted(rows, spread_by, salts), salted_copies(lookup, salts)
    keys = [*on, SALT]
    if parts is not None:
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys).hint("merge")
    return left.join(right, keys, how).drop(SALT)


def salted(rows: DataFrame, spread_by: list[str], salts: int = SALTS) -> DataFrame:
    """Adds the salt. Lookups that join on the same keys and this column, one after the other, and a grouping
    by columns that contain these and `spread_by`, then need the rows dealt out only once."""
    return rows.withColumn(SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))


def salted_copies(lookup: DataFrame, salts: int = SALTS) -> DataFrame:
    """The lookup once for each salt."""
    return lookup.crossJoin(F.broadcast(_salts(lookup.sparkSession, salts)))


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], spread_by: list[str], how: str = "left") -> DataFrame:
    """`salted_join` to a lookup with a row for each product or fewer, which is counted first.

    A small one goes to every task and the rows stay where they are. Spark finds that out only when it has
    dealt out both sides, and a shuffle of all rows takes more disk than any other step over them.
    """
    table = materialise(lookup, "lookup")
    if table.count() <= SMALL_LOOKUP:
        return rows.join(F.broadcast(table), on, how)
    return salted_join(rows, table, on, spread_by, how)
