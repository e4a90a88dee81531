"""Versions of records: latest by grain, upserts, effective intervals, point-in-time look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import bounded_broadcast


def latest_by(df: DataFrame, grain: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the greatest ``order`` of each grain; nulls are least.

    Spark limits each group to its first row before the shuffle already.
    """
    rank = Window.partitionBy(*grain).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def first_by(df: DataFrame, grain: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first arrival of each grain in the order of an explicit ordinal; nulls last."""
    rank = Window.partitionBy(*grain).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def one_per(df: DataFrame, key: Sequence[str], order: Sequence[str] = ("ts_ingest",)) -> DataFrame:
    """One row per key: the first by those of ``order`` that the frame has, ties by the text of the whole row."""
    first = Window.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_last() for c in order if c in df.columns), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return df.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")


def newest(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest n rows of each key with their rank from newest (1) to oldest."""
    rank = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("recency", F.row_number().over(rank)).where(F.col("recency") <= n)


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows replace stored rows of the same key unconditionally."""
    return stored.join(incoming.select(*key), list(key), "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_newer(stored: DataFrame, incoming: DataFrame, key: Sequence[str], stamp: str = "ts_ingest") -> DataFrame:
    """Incoming rows replace stored ones unless those are newer by ``stamp``; a tie goes to the incoming row."""
    both = stored.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, key, [stamp, "_incoming"]).drop("_incoming")


def insert_new(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The incoming rows whose key is not stored yet, one per key: the earliest by ts_ingest, then by content."""
    return one_per(incoming, key).join(stored.select(*key), list(key), "left_anti")


def conflicts(incoming: DataFrame, stored: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Keys whose content differs between incoming and stored rows, compared by a digest of the content."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    a = incoming.select(key, digest.alias("_in")).distinct()
    b = stored.select(key, digest.alias("_st")).distinct()
    return a.join(b, key).where("_in <> _st").select(key).distinct()


def content_conflicts(df: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Keys that occur with more than one content within ``df``."""
    digest = F.xxhash64(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))
    return df.groupBy(key).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b"), F.count("*").alias("copies")).where("_a <> _b").select(key, "copies")


def effective_intervals(df: DataFrame, key: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Half-open validity [start, next start) of each version; the last is open and current."""
    line = Window.partitionBy(*key).orderBy(start)
    return df.withColumn(end, F.lead(start).over(line)).withColumn("is_current", F.col(end).isNull())


def upsert_dimension(history: DataFrame, incoming: DataFrame, key: Sequence[str], attributes: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """A type-2 history with new versions: each opens where its attributes differ from the version before it.

    ``incoming``: key, attributes and start. Of versions that start together the
    incoming one counts; a version equal to the one before it opens nothing.
    """
    columns = [*key, start, *attributes]
    both = history.select(*columns, F.lit(0).alias("_new")).unionByName(incoming.select(*columns, F.lit(1).alias("_new")))
    one = latest_by(both, [*key, start], ["_new", *attributes]).drop("_new")
    line = Window.partitionBy(*key).orderBy(start)
    state = F.struct(*attributes)
    changed = one.withColumn("_same", state.eqNullSafe(F.lag(state).over(line)) & (F.row_number().over(line) > 1)).where("not _same").drop("_same")
    return effective_intervals(changed, key, start, end)


def dimension_problems(history: DataFrame, key: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """(problem, keys): keys without exactly one current version, and keys whose versions overlap or end before they start."""
    line = Window.partitionBy(*key).orderBy(start)
    seen = history.withColumn("_overlap", F.coalesce(F.lag(end).over(line) > F.col(start), F.lag(start).over(line).isNotNull() & F.lag(end).over(line).isNull()))
    per_key = seen.groupBy(*key).agg(F.count_if("is_current").alias("_current"), F.max("_overlap").alias("_overlap"), F.max(F.coalesce(F.col(end) <= F.col(start), F.lit(False))).alias("_reversed"))
    tests = {"not_one_current": F.col("_current") != 1, "overlap": F.col("_overlap"), "reversed": F.col("_reversed")}
    out = per_key.agg(*(F.count_if(test).alias(name) for name, test in tests.items()))
    return out.select(F.explode(F.array(*(F.struct(F.lit(name).alias("problem"), F.col(name).alias("keys")) for name in tests))).alias("p")).select("p.*").where("keys > 0")


def as_of(facts: DataFrame, versions: DataFrame, key: Sequence[str], at: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Each fact with the version valid at its time, or nulls: an equi-join with a range residual."""
    v = versions.withColumnsRenamed({k: f"_v_{k}" for k in key})
    on: Column = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"_v_{k}"))
    on = on & (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return facts.join(bounded_broadcast(v), on, "left").drop(*(f"_v_{k}" for k in key))


def overlaps(a: DataFrame, b: DataFrame, key: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Intersections of the closed intervals of two sets of versions of the same key; a null end is open.

    Columns of ``a`` and ``b`` besides the interval must not clash; the result has
    the intersection as (segment_start, segment_end).
    """
    right = b.withColumnsRenamed({start: "_b_start", end: "_b_end"})
    far = F.lit("9999-12-31").cast("date")
    joined = a.withColumnsRenamed({start: "_a_start", end: "_a_end"}).join(right, list(key))
    cut = joined.withColumn("segment_start", F.greatest("_a_start", "_b_start")).withColumn("segment_end", F.least(F.coalesce("_a_end", far), F.coalesce("_b_end", far)))
    return cut.where("segment_start <= segment_end").drop("_a_start", "_a_end", "_b_start", "_b_end")


def coverage_gaps(segments: DataFrame, key: Sequence[str], start: str = "segment_start", end: str = "segment_end") -> DataFrame:
    """Places where a key's closed segments leave days out or overlap: (key, previous_end, next_start, problem)."""
    line = Window.partitionBy(*key).orderBy(start, end)
    seen = segments.withColumn("previous_end", F.lag(end).over(line))
    problem = F.when(F.col(start) > F.date_add("previous_end", 1), "gap").when(F.col(start) <= F.col("previous_end"), "overlap")
    return seen.withColumn("problem", problem).where("problem is not null").select(*key, "previous_end", F.col(start).alias("next_start"), "problem")
