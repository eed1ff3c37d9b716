"""Helpers shared by the training-data operators."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.session import ensure_checkpoint_dir, materialise

__all__ = ["components", "ensure_checkpoint_dir", "load", "materialise", "text_bytes", "total_text_bytes"]


def load(spark, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def total_text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column over the whole table, one number."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def _stamp(edges: DataFrame) -> tuple:
    """Two sums that change when the edge set changes."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")
    ).first()
    return row["n"], row["x"], row["y"]


def components(edges: DataFrame) -> DataFrame:
    """Root of every linked node: rows (node, root), root the smallest node reachable.

    `edges` has columns a, b of one orderable type; direction, repeats and loops do not matter, rows
    with a null end are ignored. Nodes without a link to another node are not returned, an empty input
    gives an empty result. Alternating large-star and small-star rounds, O(log^2 n) of them; every
    round is written to the shared folder, only its fingerprint reaches the driver. Minima are combined
    before the shuffle; the joins on a hub node are plain ones that adaptive execution can split.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    now = materialise(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    stamp = _stamp(now)
    while stamp[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        now = materialise(small.distinct(), "links")
        last, stamp = stamp, _stamp(now)
        if stamp == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
