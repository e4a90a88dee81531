"""Prefix scans over shards.

``carry_in`` gives each shard the last state left by an earlier shard, and
``offset`` the sum of all earlier shards. Both work in two levels (within
blocks of ``BLOCK`` shards, then over the block summaries), so no window sorts
more than BLOCK shards or all block summaries of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def carry_in(shards: DataFrame, key: list[str], order: str, state: str, out: str) -> DataFrame:
    """Column ``out``: the last non-null ``state`` of the key's shards before this one.

    ``_block`` stays: a later window partitioned by key, ``_block`` and shard
    needs no further shuffle.
    """
    blocked = shards.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inner = Window.partitionBy(*key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(state).isNotNull(), F.struct(F.col(order).alias("at"), F.col(state).alias("state"))))
    blocks = blocked.groupBy(*key, "_block").agg(last.alias("_last"))
    blocks = blocks.select(*key, "_block", F.last("_last.state", ignorenulls=True).over(outer).alias("_before"))
    within = blocked.withColumn("_within", F.last(state, ignorenulls=True).over(inner))
    joined = within.join(blocks, [*key, "_block"], "left")
    return joined.withColumn(out, F.coalesce("_within", "_before")).drop("_within", "_before")


def offset(shards: DataFrame, key: list[str], order: str, size: str, out: str) -> DataFrame:
    """Column ``out``: the sum of ``size`` over the key's shards before this one."""
    blocked = shards.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inner = Window.partitionBy(*key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*key, "_block").agg(F.sum(size).alias("_sum"))
    blocks = blocks.select(*key, "_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    within = blocked.withColumn("_within", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    joined = within.join(blocks, [*key, "_block"], "left")
    return joined.withColumn(out, F.col("_within") + F.col("_before")).drop("_block", "_within", "_before")
