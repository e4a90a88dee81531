"""Row quality: presence, nulls and ranges of fields, rates with thresholds, constraints, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A batch fails a gate; nothing of it may be written."""


def json_field_metrics(df: DataFrame, text: str, fields: Sequence[str]) -> DataFrame:
    """One row: rows, and per field how many JSON objects lack it and how many hold null there.

    Keys are read from the raw text, as typed columns cannot tell absent from null.
    Text that is no JSON object lacks every field.
    """
    keys, value = F.json_object_keys(text), F.try_parse_json(text)
    aggs = [F.count("*").alias("rows")]
    for f in fields:
        has = F.coalesce(F.array_contains(keys, f), F.lit(False))
        aggs.append(F.count_if(~has).alias(f"missing_{f}"))
        aggs.append(F.count_if(has & F.coalesce(F.is_variant_null(F.try_variant_get(value, f"$.{f}", "variant")), F.lit(False))).alias(f"null_{f}"))
    return df.agg(*aggs)


def null_metrics(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, rows, nulls, null_rate) of typed columns, in one pass."""
    wide = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f).isNull()).alias(f) for f in fields))
    long = wide.select("rows", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("nulls")) for f in fields))).alias("m")).select("m.field", "rows", "m.nulls")
    return long.withColumn("null_rate", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0))


def range_metrics(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None, bool]]) -> DataFrame:
    """(field, checked, invalid): values outside (low, high, low included); NaN is invalid, nulls are skipped."""
    aggs = []
    for f, (low, high, closed) in ranges.items():
        v = F.col(f).cast("double")
        bad = F.isnan(v)
        if low is not None:
            bad = bad | (v < low if closed else v <= low)
        if high is not None:
            bad = bad | (v > high)
        aggs += [F.count(f).alias(f"checked_{f}"), F.count_if(v.isNotNull() & bad).alias(f"invalid_{f}")]
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(f).alias("field"), F.col(f"checked_{f}").alias("checked"), F.col(f"invalid_{f}").alias("invalid")) for f in ranges]
    return wide.select(F.explode(F.array(*entries)).alias("m")).select("m.*")


def batch_rates(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: total, deduplicated, duplicate and late counts and rates (late of the deduplicated; 0 if empty)."""
    per_key = events.groupBy(key).agg(F.count("*").alias("n"), F.min_by("is_late", "delivery_id").alias("late"))
    out = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), F.count("*").alias("deduped_events"), F.count_if("late").alias("late_events"))
    out = out.withColumn("duplicate_events", F.col("total_events") - F.col("deduped_events"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("late_rate", rate("late_events", "deduped_events")).withColumn("duplicate_rate", rate("duplicate_events", "total_events"))


def maximum_status(value: Column, maximum: float) -> Column:
    """critical if strictly above the maximum, else ok."""
    return F.when(value > maximum, "critical").otherwise("ok")


def violations(df: DataFrame, constraints: Mapping[str, Column]) -> DataFrame:
    """(constraint_name, checked, violations): rows for which a constraint is false; null passes, as in SQL CHECK."""
    wide = df.agg(F.count("*").alias("checked"), *(F.count_if(~c).alias(name) for name, c in constraints.items()))
    entries = [F.struct(F.lit(name).alias("constraint_name"), F.col(name).alias("violations")) for name in constraints]
    return wide.select("checked", F.explode(F.array(*entries)).alias("v")).select("v.constraint_name", "checked", "v.violations")


def gate(df: DataFrame, constraints: Mapping[str, Column]) -> DataFrame:
    """``df`` itself if no row violates a constraint; else QualityError for the whole batch. One action."""
    failed = [r.constraint_name for r in violations(df, constraints).collect() if r.violations]
    if failed:
        raise QualityError("constraints violated: " + ", ".join(failed))
    return df


def duplicates(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Grains that occur more than once, with their number of rows."""
    return df.groupBy(*grain).agg(F.count("*").alias("copies")).where("copies > 1")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
