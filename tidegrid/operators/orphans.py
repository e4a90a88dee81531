"""References to records that do not exist.

A Bloom filter over the parents' keys is sent to the references (only if its
size is within the bound of ``functions.bloom``; else it is joined by segment).
A reference the filter never saw is a definite orphan and skips the parent
table; only filter-positive references are joined exactly. Parents and deletions
are reduced to one row per key before any join. References are screened where
they are read, before any shuffle of theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import bloom
from tidegrid.functions.text import id_key, json_object
from tidegrid.session import bounded_broadcast, stage, stage_counted


@dataclass(frozen=True)
class Reference:
    """References of one child table: where they are and what they point into."""

    name: str
    child: DataFrame
    record: str
    values: Column  # an array of references of the record
    target: str
    parent: DataFrame


def one(column: str) -> Column:
    return F.array(F.col(column))


def json_object_values(column: str) -> Column:
    """The values of a JSON object; null for null text and for text that is no JSON object.

    Numbers and booleans come as their text, nested values as JSON text; null
    values are nulls.
    """
    return F.map_values(json_object(F.col(column), "string"))


def _cases(refs: Sequence[Reference]) -> DataFrame:
    parts = None
    for r in refs:
        rows = r.child.select(
            F.lit(r.name).alias("table_name"),
            F.lit(r.target).alias("target"),
            F.date_format("ts_event", "yyyy-MM").alias("period"),
            F.col(r.record).alias("record_id"),
            F.col("ts_ingest").alias("known_at"),
            F.explode(r.values).alias("raw"),
        )
        rows = rows.withColumn("missing_id", id_key(F.col("raw"))).where("missing_id is not null").drop("raw")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _parents(refs: Sequence[Reference]) -> DataFrame:
    """(target, id, first_seen, undated) of all parent rows, one per key."""
    parts = None
    for target, parent in {r.target: r.parent for r in refs}.items():
        rows = parent.select(F.lit(target).alias("target"), id_key(F.col("calculation_id")).alias("id"), "ts_ingest").where("id is not null")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("target", "id").agg(F.min("ts_ingest").alias("first_seen"), F.count_if(F.col("ts_ingest").isNull()).alias("undated"))


def orphan_references(refs: Sequence[Reference], deletions: DataFrame) -> DataFrame:
    """(table_name, period, record_id, missing_id, state), every case once.

    state is ``deleted`` if the target's deletion is known at the record's
    ts_ingest, else ``missing`` if the target table has no such row, else
    ``late`` if all such rows came after the record. A null ts_ingest of the
    record precedes and follows nothing; a parent row without ts_ingest is never
    late. Null and blank references are none; empty tables give no rows.
    """
    parents, rows = stage_counted(_parents(refs), "parents")
    words = bloom.words_for(rows)
    keys = stage(bloom.build(parents, words, "target", "id"), "parent-filter")
    gone = deletions.select(F.lower(F.btrim("table_name")).alias("target"), id_key(F.col("calculation_id")).alias("missing_id"), "deleted_at")
    gone = gone.groupBy("target", "missing_id").agg(F.min("deleted_at").alias("deleted_at"))
    screened = bloom.probe(_cases(refs), keys, words, F.col("target"), F.col("missing_id"))
    screened = stage(screened.join(bounded_broadcast(gone), ["target", "missing_id"], "left"), "references")
    deleted = F.coalesce(F.col("deleted_at") <= F.col("known_at"), F.lit(False))
    definite = screened.where(~F.col("maybe")).withColumn("state", F.when(deleted, "deleted").otherwise("missing"))
    exact = screened.where("maybe").join(parents.withColumnRenamed("id", "missing_id"), ["target", "missing_id"], "left")
    late = F.coalesce((F.col("undated") == 0) & (F.col("first_seen") > F.col("known_at")), F.lit(False))
    exact = exact.withColumn("state", F.when(deleted, "deleted").when(F.col("undated").isNull(), "missing").when(late, "late")).where("state is not null")
    columns = ["table_name", "period", "record_id", "missing_id", "state"]
    return definite.select(columns).unionByName(exact.select(columns)).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references, and the records that hold them, per table, month and state."""
    return orphans.groupBy("table_name", "period", "state").agg(F.count("*").alias("orphan_references"), F.count_distinct("record_id").alias("records"))
