"""Deterministic sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .bytescan import mix
from .scratch import materialize

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: follows the key's jumps through growing shard counts to the last below ``shards``."""
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = ahead[moving]
        state[moving] = state[moving] * _STEP + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column form: ``key`` is a long whose bits are mixed first; null counts as 0."""

    @F.pandas_udf(IntegerType())
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix(key.to_numpy(np.int64).view(np.uint64)), shards))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard(docs: DataFrame, key: str = "doc_id", shards: int = 8, payload: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``payload`` columns, shard, slot (gapless from 0 in each shard) and grown_shard.

    The shard depends on the key and the number of shards only. ``grown_shard`` is the shard with
    one more: either the same or the new one. Slots follow the key's order. They are given without
    bringing a shard together: rows are dealt in ranges of (shard, key) and numbered within (range,
    shard), and the ranges' counts, of which there are ranges x shards, are summed up per shard.

    Defined cases: a null key is placed like key 0 and stays null; rows repeated under one key lie
    in one shard under different slots, in no defined order; an empty table gives no rows.
    """
    placed = docs.select(key, *payload, shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"))
    # numbered before they are dealt, so that rows of one key may lie in several ranges
    dealt = placed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("shard", key, "_row").sortWithinPartitions("shard", key)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "sharded")
    numbered = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_at")))
    counts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = numbered.join(base, ["shard", "_part"])
    return out.select(key, *payload, "shard", (F.col("_base") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
