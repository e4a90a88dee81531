"""Mixing sources to target weights.

The documents of each source, shuffled anew for every pass over it, lie one
after another on the source's token line. The line is cut into blocks of
``BLOCK_TOKENS`` tokens; a document belongs to the block in which it begins. The
schedule of the mix is a sequence of slots: slot i takes the point frac((i + 1) /
golden ratio), which the cumulative weights of the sources map to a source; the
slots of a source are ranked, and its n-th slot takes its n-th block. As the
points spread evenly over every stretch of the sequence, so do the sources.

The size of the mix is the largest at which no source needs more passes than its
max_repeats: the least of max_repeats * tokens / weight. Token lines and ranks are
prefix sums over shards (by hash, or by runs of slots), so no task sorts a whole
source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scan import offset
from tidegrid.functions.text import id_key
from tidegrid.session import bounded_broadcast, stage

BLOCK_TOKENS = 512
#: 1 / golden ratio
STEP = 0.6180339887498949
#: Documents per shard of a token line, about; slots per shard of the schedule.
SHARD_ROWS = 4096


def sized(documents: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, source, tokens) of the documents."""
    return documents.select(key, id_key(F.col("source")).alias("source")).join(tokens, key)


def plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: (source, target_share, max_repeats, documents, available, weight, quota, passes).

    Sources without tokens cannot contribute: their weight is null and the others'
    weights are their target shares scaled to 1. quota is the number of tokens to
    take; passes how often the source is run through, at most max_repeats.
    """
    have = documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    wanted = targets.select(id_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(have, "source", "left")
    every = Window.partitionBy(F.lit(0))  # one row per target
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    weighed = rows.withColumn("weight", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(every)))
    total = F.min(F.col("max_repeats") * F.col("available") / F.col("weight")).over(every)
    quota = weighed.withColumn("quota", F.floor(F.col("weight") * total))
    return quota.withColumn("passes", F.ceil(F.col("quota") / F.nullif(F.col("available"), F.lit(0))).cast("int")).withColumn("passes", F.least("passes", "max_repeats"))


def _lines(documents: DataFrame, planned: DataFrame, block_tokens: int) -> DataFrame:
    """(source, block, doc_id, pass_no, at, tokens): where documents begin on the token line of their source."""
    shards = F.greatest(F.lit(1), F.ceil(F.col("documents") / SHARD_ROWS)).alias("_shards")
    runs = documents.join(bounded_broadcast(planned.where("weight is not null").select("source", "passes", "quota", shards)), "source")
    runs = runs.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    runs = runs.withColumn("_order", F.xxhash64("doc_id", "pass_no")).withColumn("_shard", (F.col("pass_no") - 1) * F.col("_shards") + F.pmod(F.shiftright("_order", 20), F.col("_shards")))
    runs = stage(runs, "mix-runs")
    starts = offset(runs.groupBy("source", "_shard").agg(F.sum("tokens").alias("_size")), ["source"], "_shard", "_size", "_start").select("source", "_shard", "_start")
    within = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_into", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(bounded_broadcast(starts), ["source", "_shard"])
    placed = placed.withColumn("at", F.col("_start") + F.col("_into")).where(F.col("at") < F.col("quota"))
    return placed.select("source", F.floor(F.col("at") / block_tokens).alias("block"), "doc_id", "pass_no", "at", "tokens")


def schedule(planned: DataFrame, block_tokens: int) -> DataFrame:
    """(slot, source, block): the sequence of slots; a source's slots are ranked in the order of the sequence."""
    weights = planned.where("weight is not null").orderBy("source").select("source", "weight", "quota").collect()  # one row per target
    # a source's blocks may end before its slots, by the unevenness of a block; slots beyond find no block
    slots = int(sum(w.quota for w in weights) // block_tokens) + 2 * len(weights) + 2 if weights else 0
    point = (F.col("slot") + 1) * F.lit(STEP)
    point = point - F.floor(point)
    named = F.lit(weights[-1].source if weights else None).cast("string")
    for i in reversed(range(len(weights) - 1)):
        named = F.when(point < sum(w.weight for w in weights[: i + 1]), weights[i].source).otherwise(named)
    spark = planned.sparkSession
    # a source may draw fewer slots than it has blocks: more are drawn until none lacks any
    while weights:
        got = {r.source: r["count"] for r in spark.range(slots).select(F.col("id").alias("slot")).select(named.alias("source")).groupBy("source").count().collect()}  # one row per target
        lacking = [(math.ceil(w.quota / block_tokens) - got.get(w.source, 0)) / w.weight for w in weights if w.quota > 0]
        if max(lacking, default=0) <= 0:
            break
        slots += math.ceil(max(lacking)) + 1
    drawn = spark.range(slots).select(F.col("id").alias("slot")).withColumn("source", named).withColumn("_shard", F.floor(F.col("slot") / SHARD_ROWS))
    starts = offset(drawn.groupBy("source", "_shard").agg(F.count("*").alias("_size")), ["source"], "_shard", "_size", "_start").select("source", "_shard", "_start")
    within = Window.partitionBy("source", "_shard").orderBy("slot")
    return drawn.withColumn("_into", F.row_number().over(within) - 1).join(starts, ["source", "_shard"]).select("slot", "source", (F.col("_start") + F.col("_into")).alias("block"))


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, doc_id, pass_no, at, tokens): the mix in the order (slot, at).

    ``documents``: (doc_id, source, tokens), doc_id unique. Only the documents of
    sources in ``targets`` are combined, sources compared trimmed and in lower
    case. A document without tokens takes part at its place on the line. No
    document is used more than max_repeats times; each occurrence has its own
    pass_no. No targets, or no tokens: no rows.
    """
    documents = stage(documents.where("source is not null"), "mix-documents")
    planned = stage(plan(documents, targets), "mix-plan")
    lines = _lines(documents, planned, block_tokens)
    return schedule(planned, block_tokens).join(lines, ["source", "block"]).select("slot", "source", "doc_id", "pass_no", "at", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: target and actual share of the tokens, documents, uses and the most uses of one document."""
    used = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens")).groupBy("source")
    used = used.agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    wanted = targets.select(id_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    every = Window.partitionBy(F.lit(0))  # one row per target
    out = wanted.join(used, "source", "left").na.fill(0, ["documents", "uses", "most_uses", "tokens"])
    return out.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)))
