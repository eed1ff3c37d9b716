"""Sharding by jump consistent hashing: the key and the shard count decide, no ring table is kept."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotecurve.llm.common import materialise

SHARDS = 24
RANGE_ROWS = 1_000_000  # rows that a task puts in order, about
_STEP = np.uint64(2862933555777941757)  # multiplier of the published generator (fixed)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. With one shard more, a key stays or moves to the new one."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    open_rows = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    while len(open_rows):
        shard[open_rows] = at
        key[open_rows] = key[open_rows] * _STEP + np.uint64(1)
        draw = (key[open_rows] >> np.uint64(33)).astype(np.float64) + 1.0
        at = ((at + 1) * (float(1 << 31) / draw)).astype(np.int64)
        on = at < shards
        open_rows, at = open_rows[on], at[on]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column (long); a null key counts as 0."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.fillna(0).to_numpy(), shards).astype(np.int32))

    return shard(F.coalesce(key, F.lit(0).cast("long")))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SHARDS) -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard), one per input row.

    Ids are integers; a null id is keyed as 0. A null text is empty. Slots count from 0 without gaps in each
    shard, in the order of id (null first), checksum and size; rows equal in all three share out their
    slots in any order. Repeated rows each get a slot. An empty table gives an empty result; other columns
    are ignored. Rows are dealt by range for the order, equal ones among several tasks, so neither a large
    shard nor a repeated key makes a large task; only (shard, range) counts are summed up in one place each.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    placed = materialise(
        docs.select(
            key.alias("id"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            shard_of(key, count).alias("shard"),
            shard_of(key, count + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "placed",
    )
    order = [F.col("id").asc_nulls_first(), "text_crc32", "size", "row"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // RANGE_ROWS))
    dealt = placed.repartitionByRange(ranges, "shard", *order).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sizes = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(starts, ["shard", "part"])
        .select(
            "id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("inside")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
