"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards alone, with no
table of the ring. When shards are appended, a row stays or moves into a new
shard, and only the needed fraction moves.

Keys of whole numbers are taken as they are, others by a hash of 64 bits.
Null keys count as the key 0. Rows with equal keys share a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm import staging

SHARDS = 8
#: Rows of a shard are ranked in this many runs of their hash, each in a task of its own.
RUNS = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def each(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return each(F.coalesce(key.cast("long"), F.lit(0)))


def key_of(rows: DataFrame, column: str) -> Column:
    """A 64-bit key of a column of any type."""
    if dict(rows.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("long")
    return F.when(F.col(column).isNotNull(), F.xxhash64(column))


def with_slots(rows: DataFrame, shard: str, order: list[str], runs: int = RUNS) -> DataFrame:
    """rows with `slot`, 0 and up in each shard without gaps.

    Two passes: rows are counted by shard and run of their hash, running totals
    of those counts give each run its first slot, and rows are ranked inside
    their run. No task holds a whole shard. The order follows from the rows
    alone; equal rows are interchangeable.
    """
    run = F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int")
    rows = staging.stage(rows.withColumn("__run", run), "shards")
    counts = rows.groupBy(shard, "__run").count()
    before = Window.partitionBy(shard).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "__run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(shard, "__run").orderBy(*order)))
    # At most shards x runs rows, so the bound of what is broadcast is known beforehand.
    return ranked.join(F.broadcast(first), [shard, "__run"]).withColumn("slot", F.col("__first") + F.col("__rank") - 1).drop("__run", "__rank", "__first")


def op10_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staging.documents(spark, sf_dir)
    text = staging.text_column()
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = key_of(sized, "doc_id")
    placed = sized.withColumn("shard", shard_of(key, SHARDS)).withColumn("grown_shard", shard_of(key, SHARDS + 1))
    out = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
