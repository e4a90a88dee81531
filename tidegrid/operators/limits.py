"""Observations against thresholds, and what follows from their order in time.

``evaluate`` classifies values; ``transitions`` compares each classification with
the one before it in its series; ``episodes`` groups consecutive breaches (gaps
and islands) and sums each up in one aggregate; ``candidates`` turns transitions
into messages with content-derived identifiers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.ids import content_id
from tidegrid.operators.versions import latest_by

#: Versions, names of metrics, transitions and messages.
EVALUATION_VERSION = "portfolio-risk-limits-v1"
OUTBOX_VERSION = "portfolio-risk-notification-outbox-v1"
ACKNOWLEDGEMENT_VERSION = "portfolio-risk-limit-ack-v1"
VOLATILITY = "portfolio_volatility_annualized"
CONCENTRATION = "largest_absolute_component_contribution_share"
ACTIONABLE = ("opened", "escalated", "deescalated", "resolved")
PENDING = ("opened", "escalated", "resolved")

#: What makes up one series of evaluations.
SERIES = ("policy_id", "policy_fingerprint", "portfolio_id", "definition_fingerprint", "model_version", "attribution_model_version", "weighting_method", "covariance_method", "correlation_method", "covariance_window", "annualization_days", "metric_name")
ORDER = ("ts_event", "ts_ingest", "calculation_id")


def status(value: Column, warning: Column, critical: Column) -> Column:
    """ok, warning or critical; thresholds included."""
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("ok")


def classified(df: DataFrame, value: str = "observed_value") -> DataFrame:
    """Adds status, is_breach, breach_threshold and breach_excess from warning_threshold and critical_threshold."""
    out = df.withColumn("status", status(F.col(value), F.col("warning_threshold"), F.col("critical_threshold"))).withColumn("is_breach", F.col("status") != "ok")
    out = out.withColumn("breach_threshold", F.when(F.col("status") == "critical", F.col("critical_threshold")).when(F.col("status") == "warning", F.col("warning_threshold")))
    return out.withColumn("breach_excess", F.coalesce(F.col(value) - F.col("breach_threshold"), F.lit(0.0)))


def evaluate(snapshots: DataFrame, volatility: tuple[float, float], share: tuple[float, float], policy_fingerprint: str) -> DataFrame:
    """Two rows per snapshot: its volatility and its largest absolute share (ties: least key)."""
    top = F.get(F.array_sort(F.map_entries("shares"), lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), F.lit(0))
    row = lambda name, kind, key, value, signed, limits: F.struct(F.lit(name).alias("metric_name"), F.lit(kind).alias("subject_type"), key.alias("subject_key"), value.alias("observed_value"), signed.alias("observed_signed_value"), F.lit(limits[0]).alias("warning_threshold"), F.lit(limits[1]).alias("critical_threshold"))
    vol = F.col("portfolio_volatility")
    both = F.array(row(VOLATILITY, "portfolio", F.col("portfolio_id"), vol, vol, volatility), row(CONCENTRATION, "constituent", F.col("_top.key"), F.abs("_top.value"), F.col("_top.value"), share))
    rows = snapshots.withColumn("_top", top).select("portfolio_id", "definition_fingerprint", "day", F.col("calculation_id").alias("attribution_calculation_id"), F.explode(both).alias("m")).select("portfolio_id", "definition_fingerprint", "day", "attribution_calculation_id", "m.*")
    identity = content_id(f"{EVALUATION_VERSION}-evaluation-", attribution_calculation_id=F.col("attribution_calculation_id"), metric_name=F.col("metric_name"), model_version=F.lit(EVALUATION_VERSION), policy_fingerprint=F.lit(policy_fingerprint))
    return classified(rows).withColumn("calculation_id", identity)


def latest_evaluations(evaluations: DataFrame) -> DataFrame:
    """The latest version of each series and day."""
    return latest_by(evaluations, [*SERIES, "ts_event"], ["ts_ingest", "calculation_id"])


def snapshot_status(evaluations: DataFrame, grain: Sequence[str] = ("policy_id", "portfolio_id", "ts_event")) -> DataFrame:
    """Per snapshot: number of evaluations and breaches and the worst status."""
    rank = F.max(F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0))
    out = evaluations.groupBy(*grain).agg(F.count("*").alias("evaluations"), F.count_if("is_breach").alias("breaches"), F.count_if(F.col("status") == "critical").alias("criticals"), rank.alias("_rank"))
    return out.withColumn("status", F.when(F.col("_rank") == 2, "critical").when(F.col("_rank") == 1, "warning").otherwise("ok")).drop("_rank")


def transitions(evaluations: DataFrame, series: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """Each evaluation with the one before it in its series and the kind of change."""
    line = Window.partitionBy(*series).orderBy(*order)
    out = evaluations.withColumn("previous_status", F.lag("status").over(line)).withColumn("previous_calculation_id", F.lag("calculation_id").over(line)).withColumn("previous_subject_key", F.lag("subject_key").over(line))
    now, was = F.col("status"), F.col("previous_status")
    breach = lambda s: s.isin("warning", "critical")
    kind = (
        F.when(breach(now) & F.coalesce(was == "ok", F.lit(True)), "opened")
        .when(was.isNull() & (now == "ok"), "initial_ok")
        .when((was == "warning") & (now == "critical"), "escalated")
        .when((was == "critical") & (now == "warning"), "deescalated")
        .when(breach(was) & (now == "ok"), "resolved")
        .otherwise("unchanged")
    )
    out = out.withColumn("transition_type", kind).withColumn("severity_rank", F.when(now == "critical", 2).when(now == "warning", 1).otherwise(0))
    return out.withColumn("subject_changed", F.coalesce(F.col("previous_subject_key") != F.col("subject_key"), F.lit(False)))


def actionable(moves: DataFrame) -> DataFrame:
    return moves.where(F.col("transition_type").isin(*ACTIONABLE))


def episodes(moves: DataFrame, series: Sequence[str] = SERIES, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per breach episode: its span, counts, opening, latest and worst observation, and resolution.

    An episode starts where a transition opened; its number is the running count
    of those. All parts come of one aggregate (no self-joins): the opening, the
    latest, the peak (severity, excess, value, then earliest) and the first ok row
    after it are minima and maxima of structs.
    """
    line = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = moves.withColumn("episode_sequence", F.sum(F.when(F.col("transition_type") == "opened", 1).otherwise(0)).over(line)).where("episode_sequence > 0")
    when = [F.col(c) for c in order]
    info = F.struct("status", "subject_key", "observed_value", "observed_signed_value", "breach_excess", "calculation_id", "ts_event", "ts_ingest")
    breach, ok = F.col("is_breach"), F.col("status") == "ok"
    at = F.struct(*when)
    worst = F.struct((-F.col("severity_rank")).alias("r"), (-F.col("breach_excess")).alias("e"), (-F.col("observed_value")).alias("v"), *when)
    out = numbered.groupBy(*series, "episode_sequence").agg(
        F.min(F.when(breach, F.col("ts_event"))).alias("episode_start"),
        F.max(F.when(breach, F.col("ts_event"))).alias("last_breach"),
        F.count_if(breach).alias("breach_observations"),
        F.count_if(breach & (F.col("status") == "warning")).alias("warning_observations"),
        F.count_if(breach & (F.col("status") == "critical")).alias("critical_observations"),
        F.count_if(breach & F.col("subject_changed")).alias("subject_changes"),
        F.min_by(info, F.when(breach, at)).alias("opening"),
        F.max_by(info, F.when(breach, at)).alias("latest"),
        F.min_by(info, F.when(breach, worst)).alias("peak"),
        F.min_by(info, F.when(ok, at)).alias("resolution"),
    )
    return out.withColumn("episode_status", F.when(F.col("resolution").isNull(), "open").otherwise("resolved"))


def candidates(moves: DataFrame) -> DataFrame:
    """Messages for actionable transitions: pending, or suppressed for deescalations; unchanged and initial rows give none."""
    rows = actionable(moves)
    identity = content_id(
        f"{OUTBOX_VERSION}-event-",
        metric_name=F.col("metric_name"),
        model_version=F.lit(OUTBOX_VERSION),
        policy_fingerprint=F.col("policy_fingerprint"),
        source_evaluation_calculation_id=F.col("calculation_id"),
        source_previous_evaluation_calculation_id=F.col("previous_calculation_id"),
        transition_type=F.col("transition_type"),
    )
    pending = F.col("transition_type").isin(*PENDING)
    payload = F.to_json(F.struct(F.struct("metric_name", "observed_value", "previous_status", "status", "subject_key").alias("metric"), F.struct("policy_fingerprint", "policy_id").alias("policy"), F.struct("definition_fingerprint", "portfolio_id").alias("portfolio"), "transition_type"), {"ignoreNullFields": "false"})
    return (
        rows.withColumn("event_id", identity)
        .withColumn("event_type", F.concat(F.lit("breach_"), "transition_type"))
        .withColumn("delivery_disposition", F.when(pending, "pending").otherwise("suppressed"))
        .withColumn("suppression_reason", F.when(~pending, "deescalation_not_routed"))
        .withColumn("payload_json", payload)
    )


#: Columns of one line of the outbox summary.
SUMMARY_KEYS = ("policy_id", "policy_fingerprint", "portfolio_id", "definition_fingerprint", "metric_name", "event_type", "transition_type", "delivery_disposition")


def current_outbox(outbox: DataFrame, moves: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Stored messages that still match an actionable transition, by a null-safe key.

    Columns of the transition named in ``carry`` are added to the message.
    """
    live = actionable(moves).select(F.col("calculation_id").alias("_id"), F.col("previous_calculation_id").alias("_previous"), F.col("transition_type").alias("_kind"), F.col("metric_name").alias("_metric"), *carry)
    on = (outbox["source_evaluation_calculation_id"] == F.col("_id")) & outbox["source_previous_evaluation_calculation_id"].eqNullSafe(F.col("_previous")) & (outbox["transition_type"] == F.col("_kind")) & (outbox["metric_name"] == F.col("_metric"))
    if not carry:
        return outbox.join(live, on, "left_semi")
    once = live.groupBy("_id", "_previous", "_kind", "_metric").agg(*(F.min(c).alias(c) for c in carry))
    return outbox.join(once, on).drop("_id", "_previous", "_kind", "_metric")


def outbox_summary(outbox: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    """Messages per policy, portfolio definition, metric, kind and disposition, or per the given keys."""
    return outbox.groupBy(*keys).agg(F.count("*").alias("events"), F.min("ts_event").alias("first_event"), F.max("ts_event").alias("last_event"))


def acknowledge(breaches: DataFrame, requests: DataFrame) -> DataFrame:
    """New acknowledgements: (acknowledgement_id, calculation_id, request_id, acknowledged_at, acknowledged_by).

    A request must name a current breach and be made at or after its time; requests
    repeated under one id count once, the earliest.
    """
    once = latest_by(requests.withColumn("_age", -F.unix_micros("acknowledged_at")), ["calculation_id", "request_id"], ["_age"]).drop("_age")
    valid = once.join(breaches.where("is_breach").select("calculation_id", "ts_event"), "calculation_id").where("acknowledged_at >= ts_event").drop("ts_event")
    identity = content_id(f"{ACKNOWLEDGEMENT_VERSION}-", evaluation_calculation_id=F.col("calculation_id"), model_version=F.lit(ACKNOWLEDGEMENT_VERSION), request_id=F.col("request_id"))
    return valid.withColumn("acknowledgement_id", identity)


def breach_status(breaches: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Breaches with their latest acknowledgement and the number of them."""
    latest = acknowledgements.groupBy("calculation_id").agg(F.count("*").alias("acknowledgements"), F.max(F.struct("acknowledged_at", "acknowledgement_id", "acknowledged_by")).alias("_a"))
    out = breaches.where("is_breach").join(latest, "calculation_id", "left")
    return out.withColumn("acknowledgements", F.coalesce("acknowledgements", F.lit(0))).withColumn("acknowledged_at", F.col("_a.acknowledged_at")).withColumn("acknowledged_by", F.col("_a.acknowledged_by")).withColumn("acknowledgement_status", F.when(F.col("acknowledgements") > 0, "acknowledged").otherwise("open")).drop("_a")


def diagnostics(stored: DataFrame) -> DataFrame:
    """Per policy: stored records, current evaluations, snapshots, evaluations by status, first and last day."""
    keys = ["policy_id", "policy_fingerprint"]
    matched = stored.groupBy(*keys).agg(F.count("*").alias("matched_records"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "critical")]
    now = latest_evaluations(stored).groupBy(*keys).agg(F.count("*").alias("current_evaluations"), F.count_distinct("attribution_calculation_id").alias("snapshots"), *counts, F.min(F.to_date("ts_event")).alias("first_date"), F.max(F.to_date("ts_event")).alias("last_date"))
    return matched.join(now, keys)
