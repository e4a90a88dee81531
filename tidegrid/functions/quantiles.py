"""Exact quantiles of groups of any size.

An approximate sketch brackets the quantile's rank; exact counts below the bracket
and the values inside it (a few thousandths of the group) then give the exact
order statistics. Nothing collects a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import bounded_broadcast, stage

ACCURACY = 10_000


def exact_quantile(df: DataFrame, key: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """(key, n, out): the q-quantile of the non-null values, linearly interpolated between order statistics."""
    slack = 3 / ACCURACY
    edges = F.percentile_approx(value, [max(0.0, q - slack), min(1.0, q + slack)], ACCURACY)
    rows = df.where(F.col(value).isNotNull())
    bounds = rows.groupBy(*key).agg(F.count("*").alias("n"), edges.alias("_e")).select(*key, "n", F.get("_e", F.lit(0)).alias("_lo"), F.get("_e", F.lit(1)).alias("_hi"))
    bounds = stage(bounds, "quantile-bounds")  # measured and joined: made once
    # side -1 and 1: only counted, with the value next to the bracket; 0: kept by value
    low = F.lit(q > slack) & (F.col(value) < F.col("_lo"))
    side = F.when(low, -1).when(F.lit(q < 1 - slack) & (F.col(value) > F.col("_hi")), 1).otherwise(0)
    near = rows.join(bounded_broadcast(bounds), list(key)).withColumn("_side", side)
    counted = near.groupBy(*key, "n", "_side", F.when(F.col("_side") == 0, F.col(value)).alias("_v")).agg(F.count("*").alias("_k"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    line = Window.partitionBy(*key).orderBy("_side", "_v")
    placed = counted.withColumn("_end", F.sum("_k").over(line)).withColumn("_start", F.col("_end") - F.col("_k"))
    placed = placed.withColumn("_from", F.when(F.col("_side") < 0, F.col("_end") - 1).otherwise(F.col("_start"))).withColumn("_to", F.when(F.col("_side") > 0, F.col("_start") + 1).otherwise(F.col("_end")))
    rank = F.lit(q) * (F.col("n") - 1)
    of = F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least"))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), of))
    found = placed.groupBy(*key, "n").agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_b"))
    part = rank - F.floor(rank)
    return found.select(*key, "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias(out))
