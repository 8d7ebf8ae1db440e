"""Sharding by jump consistent hashing.

A key's shard depends on the key and the number of shards alone: no ring table is
kept, and one more shard takes rows only into itself (Lamping & Veach, 2014).

Defined results: a null key hashes like any other value; a null text has no bytes and
the checksum of the empty string; repeated rows each get a slot of their own; an empty
table gives no rows.  Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys into ``shards`` buckets."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64)
    bucket = np.zeros(len(key), dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket.astype(np.int32)


def jump_column(key: Column, shards: int) -> Column:
    """The shard of a long key column, as an Arrow-batched function."""

    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return of(key)


def shard(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", buckets: int = 256
) -> DataFrame:
    """Place every row in a shard and give it a gapless slot there.

    Returns key, size, text_crc32, law ('key'), shard, slot, grown_shard (the shard with
    one more shard).  Slots are numbered in ``buckets`` hashed parts of each shard, so a
    shard is never one task: equal rows are first summed to one row with a count, parts
    are numbered apart, and the parts' offsets (at most shards x buckets rows) are
    broadcast.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (
        docs.select(
            F.col(key).alias("k"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("crc"),
        )
        .groupBy("k", "size", "crc")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("hashed", F.xxhash64("k"))
        .withColumn("part", F.pmod(F.xxhash64("k", "size", "crc"), F.lit(buckets)).cast("int"))
    )
    placed = rows.select(
        "k", "size", "crc", "copies", "part",
        jump_column(F.col("hashed"), shards).alias("shard"),
        jump_column(F.col("hashed"), shards + 1).alias("grown"),
    )
    offsets = (
        placed.groupBy("shard", "part")
        .agg(F.sum("copies").alias("rows"))
        .withColumn(
            "base",
            F.sum("rows").over(
                Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            - F.col("rows"),
        )
        .drop("rows")
    )
    within = (
        Window.partitionBy("shard", "part")
        .orderBy(F.col("k").asc_nulls_last(), "size", "crc")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("before", F.sum("copies").over(within) - F.col("copies"))
        .join(F.broadcast(offsets), ["shard", "part"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            F.col("k").alias(key),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("key").alias("law"),
            "shard",
            (F.col("base") + F.col("before") + F.col("copy")).alias("slot"),
            F.col("grown").alias("grown_shard"),
        )
    )
