"""Row-count windows over keys of unbounded size.

A key's rows are cut into shards (days, say). Each shard gets copies of the last
``n`` rows before it, marked as context; a window over (key, shard) with a frame
of at most n preceding rows then gives what a window over the whole key would,
and no task sorts more than a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_context(df: DataFrame, key: Sequence[str], shard: str, order: Sequence[str], n: int, keep: Sequence[str]) -> DataFrame:
    """``df`` and its context rows; column ``_context`` tells them apart.

    ``order`` must be unique within a key and must not contradict ``shard``.
    Context rows carry the order and the columns in ``keep``; the others are null.
    """
    back = Window.partitionBy(*key, shard).orderBy(*(F.col(c).desc() for c in order))
    tails = df.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= n)
    tails = tails.groupBy(*key, shard).agg(F.array_sort(F.collect_list(F.struct(*order, *keep))).alias("_tail"))
    # every shard holds a row at least, so the last n rows lie in the last n shards
    before = Window.partitionBy(*key).orderBy(shard).rowsBetween(-n, -1)
    carried = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(before)))
    carried = carried.select(*key, shard, F.explode(F.slice("_carry", F.greatest(F.lit(1), F.size("_carry") - n + 1), n)).alias("_c"))
    context = carried.select(*key, shard, "_c.*").withColumn("_context", F.lit(True))
    return df.withColumn("_context", F.lit(False)).unionByName(context, allowMissingColumns=True)
