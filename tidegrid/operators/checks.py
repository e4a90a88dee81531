"""Reconciliation checks: rows (check_name, expected, actual, status) of independent counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.text import json_object
from tidegrid.operators import limits
from tidegrid.operators.limits import SERIES
from tidegrid.operators.portfolio import json_numbers
from tidegrid.operators.versions import latest_by


def check(name: str, actual: DataFrame, expected: int = 0) -> DataFrame:
    """A check of the number of rows of ``actual``."""
    return actual.agg(F.count("*").alias("actual")).select(F.lit(name).alias("check_name"), F.lit(expected).cast("bigint").alias("expected"), "actual")


def measure(name: str, source: DataFrame, actual: Column, expected: Column | int = 0) -> DataFrame:
    """A check of one aggregate of ``source`` against another or a constant."""
    want = expected if isinstance(expected, Column) else F.lit(expected)
    return source.agg(F.coalesce(want, F.lit(0)).cast("bigint").alias("expected"), F.coalesce(actual, F.lit(0)).cast("bigint").alias("actual")).select(F.lit(name).alias("check_name"), "expected", "actual")


def suite(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks with pass or fail, ordered by name."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    return rows.withColumn("status", F.when(F.col("expected") == F.col("actual"), "pass").otherwise("fail")).orderBy("check_name")


def require(results: DataFrame) -> None:
    """Raise if a suite is empty or a check failed."""
    rows = results.collect()  # one row per check
    failed = [r.check_name for r in rows if r.status != "pass"]
    if failed or not rows:
        raise AssertionError("checks failed: " + (", ".join(failed) or "none ran"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "calculation_id") -> DataFrame:
    """Child rows whose non-null reference is not a key of the parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def surplus_ids(df: DataFrame, key: str = "calculation_id") -> Column:
    return F.count("*") - F.count_distinct(key)


def stale(latest: DataFrame, every: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Latest rows for which a later version exists: an equi-join on the grain with a row-value residual."""
    newer = every.select(*grain, F.col("ts_ingest").alias("_i"), F.col("calculation_id").alias("_c"))
    return latest.join(newer, list(grain), "inner").where(F.struct("_i", "_c") > F.struct("ts_ingest", "calculation_id"))


def core_checks(raw: DataFrame, events: DataFrame, deduped: DataFrame, rates: DataFrame) -> DataFrame:
    return suite(
        [
            measure("core_deduped_ids_unique", deduped, surplus_ids(deduped, "event_id")),
            check("core_deduped_events_are_events", orphans(deduped, "event_id", events, "event_id")),
            measure("core_late_not_above_deduped", rates, F.sum(F.when(F.col("late_events") > F.col("deduped_events"), 1).otherwise(0))),
            measure("core_total_splits", rates, F.sum(F.col("deduped_events") + F.col("duplicate_events")), F.sum("total_events")),
            check("core_events_came_from_raw", events.join(raw.select("delivery_id"), "delivery_id", "left_anti")),
        ]
    )


def daily_checks(stored: DataFrame, latest: DataFrame) -> DataFrame:
    grain = ["source", "symbol", "ts_event"]
    return suite(
        [
            measure("daily_rows_present", stored, F.when(F.count("*") > 0, 1).otherwise(0), 1),
            measure("daily_ids_surplus", stored, surplus_ids(stored)),
            check("daily_latest_grain_repeated", latest.groupBy(*grain).count().where("count > 1")),
            check("daily_latest_is_stale", stale(latest, stored, grain)),
            check("daily_return_not_above_minus_one", stored.where("return_1d <= -1")),
        ]
    )


def portfolio_checks(stored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    maps = stored.select("portfolio_id", "calculation_id", "constituent_count", "portfolio_return_1d", json_numbers(F.col("weights_json")).alias("w"), json_numbers(F.col("component_returns_json")).alias("r"), json_numbers(F.col("contributions_json")).alias("c"))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    keys = lambda m: F.array_sort(F.map_keys(m))
    parts = maps.where("c is not null and w is not null and r is not null").select("calculation_id", "w", "r", F.explode("c").alias("k", "v"))
    return suite(
        [
            measure("portfolio_ids_surplus", stored, surplus_ids(stored)),
            check("portfolio_weights_do_not_sum_to_one", maps.where(F.abs(total("w") - 1) > 1e-5)),
            check("portfolio_key_sets_differ", maps.where((keys("w") != keys("r")) | (keys("w") != keys("c")))),
            check("portfolio_constituent_count_wrong", maps.where(F.size("w") != F.col("constituent_count")).where("w is not null")),
            check("portfolio_contributions_do_not_sum", maps.where(F.abs(total("c") - F.col("portfolio_return_1d")) > tolerance)),
            check("portfolio_contribution_is_not_product", parts.where(F.abs(F.try_element_at("w", F.col("k")) * F.try_element_at("r", F.col("k")) - F.col("v")) > tolerance)),
        ]
    )


def attribution_checks(matrix: DataFrame, euler: DataFrame) -> DataFrame:
    """Symmetry by a transposed self-join, bounds, the Euler sum and n * n cells per window."""
    grain = ["portfolio_id", "definition_fingerprint", "day"]
    flipped = matrix.select(*grain, F.col("row_key").alias("column_key"), F.col("column_key").alias("row_key"), F.col("covariance_annualized").alias("_other"))
    pairs = matrix.join(flipped, [*grain, "row_key", "column_key"], "left")
    sums = euler.groupBy(*grain, "portfolio_volatility").agg(F.sum("component_contribution").alias("_c"), F.sum("contribution_share").alias("_s"), F.count("*").alias("_n"))
    cells = matrix.groupBy(*grain).agg(F.count("*").alias("_cells"))
    return suite(
        [
            check("attribution_matrix_asymmetric", pairs.where(F.col("_other").isNull() | (F.abs(F.col("covariance_annualized") - F.col("_other")) > 1e-12))),
            check("attribution_correlation_out_of_bounds", matrix.where(F.abs("correlation") > 1)),
            check("attribution_diagonal_negative", matrix.where((F.col("row_key") == F.col("column_key")) & (F.col("covariance_annualized") < 0))),
            check("attribution_contributions_do_not_sum", sums.where(F.abs(F.col("_c") - F.col("portfolio_volatility")) > 1e-9)),
            check("attribution_shares_do_not_sum_to_one", sums.where((F.abs(F.col("_s") - 1) > 1e-9) & (F.col("portfolio_volatility") > 1e-12))),
            check("attribution_cells_missing", sums.join(cells, grain).where(F.col("_cells") != F.col("_n") * F.col("_n"))),
        ]
    )


def limit_checks(stored: DataFrame, latest: DataFrame, attribution: DataFrame) -> DataFrame:
    grain = [*SERIES, "ts_event"]
    per = latest.groupBy(*[c for c in grain if c != "metric_name"]).agg(F.count_distinct("metric_name").alias("n"))
    wrong = (F.col("is_breach") != (F.col("status") != "ok")) | (F.col("warning_threshold") > F.col("critical_threshold"))
    return suite(
        [
            measure("limits_ids_surplus", stored, surplus_ids(stored)),
            check("limits_latest_is_stale", stale(latest, stored, grain)),
            check("limits_more_than_two_metrics", per.where("n > 2")),
            check("limits_breach_flag_wrong", stored.where(wrong)),
            check("limits_excess_negative", stored.where("breach_excess < 0")),
            check("limits_attribution_orphans", orphans(stored, "attribution_calculation_id", attribution)),
        ]
    )


def lifecycle_checks(latest: DataFrame, moves: DataFrame, episodes: DataFrame) -> DataFrame:
    opened = moves.where("transition_type = 'opened'")
    still = episodes.where("episode_status = 'open'")
    later = moves.select(*SERIES, F.col("ts_event").alias("_t"), F.col("status").alias("_s")).where("_s = 'ok'")
    both = [*SERIES]
    return suite(
        [
            measure("lifecycle_transition_per_evaluation", moves.select(F.lit(1).alias("m"), F.lit(0).alias("l")).unionByName(latest.select(F.lit(0).alias("m"), F.lit(1).alias("l"))), F.sum("m"), F.sum("l")),
            measure("lifecycle_episode_per_opening", opened.select(F.lit(1).alias("o"), F.lit(0).alias("e")).unionByName(episodes.select(F.lit(0).alias("o"), F.lit(1).alias("e"))), F.sum("e"), F.sum("o")),
            check("lifecycle_open_episode_has_later_ok", still.join(later, both).where(F.col("_t") > F.col("last_breach")).select(*SERIES, "episode_sequence").distinct()),
            check("lifecycle_peak_below_opening", episodes.where("peak.observed_value < opening.observed_value and peak.status = opening.status")),
            check("lifecycle_counts_do_not_split", episodes.where("breach_observations <> warning_observations + critical_observations")),
        ]
    )


def outbox_checks(outbox: DataFrame, current: DataFrame, evaluations: DataFrame) -> DataFrame:
    wrong = (F.col("delivery_disposition") == "suppressed") != (F.col("transition_type") == "deescalated")
    return suite(
        [
            measure("outbox_ids_surplus", outbox, surplus_ids(outbox, "event_id")),
            check("outbox_disposition_wrong", outbox.where(wrong)),
            check("outbox_suppression_without_reason", outbox.where((F.col("delivery_disposition") == "suppressed") & F.col("suppression_reason").isNull())),
            check("outbox_evaluation_orphans", orphans(outbox, "source_evaluation_calculation_id", evaluations)),
            check("outbox_current_not_stored", orphans(current, "event_id", outbox, "event_id")),
        ]
    )


#: One snapshot of limit evaluations.
SNAPSHOT = ("policy_id", "policy_fingerprint", "portfolio_id", "definition_fingerprint", "attribution_calculation_id", "ts_event")
#: One version grain of stored attributions.
ATTRIBUTION = ("portfolio_id", "definition_fingerprint", "ts_event", "model_version", "weighting_method", "covariance_method", "correlation_method", "covariance_window", "annualization_days")
NEAR = 1e-10


def same_count(name: str, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """A check of the number of rows of one frame against that of another."""
    ones = lambda df, a: df.select(F.lit(a).alias("a"), F.lit(1 - a).alias("e"))
    return measure(name, ones(actual, 1).unionByName(ones(expected, 0)), F.sum("a"), F.sum("e"))


def prefixed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_{c}") for c in columns))


def any_true(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def repeated(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    return df.groupBy(*grain).count().where("count > 1")


def limit_reconciliation(stored: DataFrame, latest: DataFrame, attribution: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Evaluations against the attribution they cite, their snapshots and the acknowledgements of breaches."""
    same = ["portfolio_id", "base_currency", "definition_fingerprint", "weighting_method", "covariance_method", "correlation_method", "covariance_window", "annualization_days", "ts_event"]
    shares = json_numbers(F.col("component_contribution_share_json")).alias("_shares")
    cited = attribution.select(F.col("calculation_id").alias("attribution_calculation_id"), F.col("model_version").alias("_model"), F.col("ts_ingest").alias("_ts_ingest"), *(F.col(c).alias(f"_{c}") for c in same), F.col("portfolio_volatility_annualized").alias("_volatility"), shares)
    pairs = stored.join(cited, "attribution_calculation_id")
    volatility, share = F.col("metric_name") == limits.VOLATILITY, F.col("metric_name") == limits.CONCENTRATION
    largest = F.array_max(F.transform(F.map_values("_shares"), lambda v: F.abs(v)))
    unlike = any_true(
        volatility & (F.abs(F.col("observed_value") - F.col("_volatility")) > NEAR),
        share & (F.abs(F.col("observed_value") - largest) > NEAR),
        share & (F.abs(F.col("observed_signed_value") - F.try_element_at("_shares", F.col("subject_key"))) > NEAR),
    )
    current = latest_by(attribution, ATTRIBUTION, ["ts_ingest", "calculation_id"]).select(F.col("calculation_id").alias("attribution_calculation_id"))
    status = limits.snapshot_status(latest, SNAPSHOT)
    rank = F.max(F.array_position(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), F.col("status")))
    again = latest.groupBy(*(F.col(c).alias(f"_{c}") for c in SNAPSHOT)).agg(F.count("*").alias("_n"), F.sum(F.col("is_breach").cast("int")).alias("_b"), rank.alias("_r"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SNAPSHOT]
    wrong_status = F.col("_n").isNull() | (F.col("evaluations") != F.col("_n")) | (F.col("breaches") != F.coalesce("_b", F.lit(0))) | (F.col("status") != F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), F.col("_r").cast("int")))
    ids = ["calculation_id"]
    breaches = latest.dropDuplicates(ids).where("is_breach")
    state = limits.breach_status(latest.dropDuplicates(ids), acknowledgements)
    newest = latest_by(acknowledgements, ids, ["acknowledged_at", "acknowledgement_id"]).select("calculation_id", F.col("acknowledged_at").alias("_at"))
    newest = newest.join(acknowledgements.groupBy("calculation_id").agg(F.count("*").alias("_n")), "calculation_id")
    wrong_state = any_true(F.col("acknowledgements") != F.coalesce("_n", F.lit(0)), ~F.col("acknowledged_at").eqNullSafe(F.col("_at")), F.col("acknowledgement_status") != F.when(F.col("_n") > 0, "acknowledged").otherwise("open"))
    targets = acknowledgements.join(stored.select("calculation_id", "is_breach", "ts_event"), "calculation_id")
    return suite(
        [
            check("limits_attribution_missing", stored.join(attribution.select(F.col("calculation_id").alias("attribution_calculation_id")), "attribution_calculation_id", "left_anti")),
            check("limits_attribution_metadata_differs", pairs.where(any_true(F.col("attribution_model_version") != F.col("_model"), *(F.col(c) != F.col(f"_{c}") for c in same)))),
            check("limits_attribution_ingest_differs", pairs.where(F.col("ts_ingest") != F.col("_ts_ingest"))),
            check("limits_attribution_not_current", latest.join(current, "attribution_calculation_id", "left_anti")),
            check("limits_observed_value_differs", pairs.where(unlike)),
            check("limits_latest_grain_repeated", repeated(latest, [*SERIES, "ts_event"])),
            same_count("limits_snapshot_status_rows", status, latest.select(*SNAPSHOT).distinct()),
            check("limits_snapshot_status_wrong", status.join(again, on, "left").where(wrong_status)),
            check("limits_acknowledgement_orphans", acknowledgements.join(stored.select("calculation_id"), "calculation_id", "left_anti")),
            check("limits_acknowledgement_target_invalid", targets.where(~F.col("is_breach") | (F.col("acknowledged_at") < F.col("ts_event")))),
            check("limits_acknowledgement_request_repeated", repeated(acknowledgements, ["calculation_id", "request_id"])),
            same_count("limits_acknowledgement_history_rows", acknowledgements.join(stored.select("calculation_id").distinct(), "calculation_id"), acknowledgements),
            same_count("limits_breach_status_rows", state, breaches),
            same_count("limits_open_and_acknowledged_rows", state.where("acknowledgement_status in ('open', 'acknowledged')"), breaches),
            check("limits_breach_status_not_latest", state.join(newest, "calculation_id", "left").where(wrong_state)),
        ]
    )


def snapshot_checks(latest: DataFrame) -> DataFrame:
    """Snapshots of one attribution that have not exactly the two metrics, each once."""
    per = latest.groupBy(*SNAPSHOT).agg(F.count("*").alias("n"), F.count_distinct("metric_name").alias("m"))
    return suite([check("limits_snapshot_has_not_two_metrics", per.where("n <> 2 or m <> 2"))])


def lifecycle_reconciliation(moves: DataFrame, episodes: DataFrame) -> DataFrame:
    """Transitions and episodes: kinds, counts, boundaries, resolutions, keys, overlap."""
    kind, status, breach = F.col("transition_type"), F.col("status"), F.col("is_breach")
    contract = any_true(
        ~kind.isin("initial_ok", "unchanged", *limits.ACTIONABLE),
        F.col("severity_rank") != F.when(status == "critical", 2).when(status == "warning", 1).when(status == "ok", 0),
        (kind == "opened") & ~breach,
        (kind == "resolved") & ((status != "ok") | breach),
    )
    parts = [F.col(p) for p in ("opening", "latest", "peak")]
    counts = any_true(
        F.col("breach_observations") <= 0,
        F.col("breach_observations") != F.col("warning_observations") + F.col("critical_observations"),
        F.col("subject_changes") < 0,
        *(~p["status"].isin("warning", "critical") for p in parts),
        F.col("episode_start") > F.col("last_breach"),
        F.col("peak.breach_excess") < 0,
        F.col("latest.breach_excess") < 0,
    )
    is_open, end = F.col("episode_status") == "open", F.col("resolution.ts_event")
    unresolved = any_true(is_open & F.col("resolution").isNotNull(), ~is_open & (end.isNull() | F.col("resolution.calculation_id").isNull() | F.col("resolution.ts_ingest").isNull() | (end <= F.col("last_breach"))))
    edges = episodes
    for name in ("opening", "latest", "peak", "resolution"):
        at = moves.select(F.col("calculation_id").alias(f"_{name}_id"), F.col("transition_type").alias(f"_{name}_kind"), F.col("status").alias(f"_{name}_status"), F.col("is_breach").alias(f"_{name}_breach"))
        edges = edges.join(at, F.col(f"{name}.calculation_id") == F.col(f"_{name}_id"), "left")
    boundary = any_true(
        *(F.col(f"_{n}_id").isNull() | ~F.col(f"_{n}_breach") for n in ("opening", "latest", "peak")),
        F.col("_opening_kind") != "opened",
        ~is_open & (F.col("_resolution_id").isNull() | (F.col("_resolution_kind") != "resolved") | (F.col("_resolution_status") != "ok") | F.col("_resolution_breach")),
    )
    line = Window.partitionBy(*SERIES).orderBy("episode_start", "episode_sequence")
    before = episodes.withColumn("_was", F.lag("episode_status").over(line)).withColumn("_until", F.lag(F.coalesce(end, F.col("last_breach"))).over(line))
    later = moves.select(*SERIES, F.col("ts_event").alias("_t"))
    return suite(
        [
            check("lifecycle_transition_contract_broken", moves.where(contract)),
            same_count("lifecycle_resolution_per_resolved_episode", episodes.where("episode_status = 'resolved'"), moves.where("transition_type = 'resolved'")),
            check("lifecycle_episode_figures_wrong", episodes.where(counts)),
            check("lifecycle_episode_resolution_wrong", episodes.where(unresolved)),
            check("lifecycle_episode_boundary_wrong", edges.where(boundary)),
            measure("lifecycle_episode_keys_surplus", episodes, F.count("*") - F.count_distinct(F.struct(*SERIES, "episode_start"))),
            check("lifecycle_episodes_overlap", before.where((F.col("_was") == "open") | (F.col("episode_start") <= F.col("_until")))),
            check("lifecycle_open_episode_is_stale", episodes.where(is_open).join(later, list(SERIES)).where(F.col("_t") > F.col("last_breach")).select(*SERIES, "episode_sequence").distinct()),
        ]
    )


def outbox_reconciliation(outbox: DataFrame, current: DataFrame, moves: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Messages against the transitions they tell: completeness, staleness, metadata, dispositions, payload."""
    acts = limits.actionable(moves)
    same = ["policy_id", "portfolio_id", "ts_event", "ts_ingest", "metric_name", "subject_type", "subject_key", "previous_status", "status", "severity_rank", "observed_value", "warning_threshold", "critical_threshold"]
    told = acts.select(F.col("calculation_id").alias("_id"), F.col("previous_calculation_id").alias("_previous"), F.col("transition_type").alias("_kind"), *(F.col(c).alias(f"_{c}") for c in same))
    own, kind = F.col("source_evaluation_calculation_id") == F.col("_id"), F.col("transition_type") == F.col("_kind")
    whole = own & kind & F.col("source_previous_evaluation_calculation_id").eqNullSafe(F.col("_previous"))
    pairs = current.join(told, own & kind)
    exact = [F.col(c) != F.col(f"_{c}") for c in ("policy_id", "portfolio_id", "ts_event", "metric_name", "subject_type", "subject_key", "severity_rank")]
    close = [F.abs(F.col(c) - F.col(f"_{c}")) > NEAR for c in ("observed_value", "warning_threshold", "critical_threshold")]
    unlike = any_true(*exact, *close, ~F.col("previous_status").eqNullSafe(F.col("_previous_status")), F.col("current_status") != F.col("_status"))
    routed = F.col("transition_type").isin(*limits.PENDING)
    disposition = any_true(
        routed & ((F.col("delivery_disposition") != "pending") | F.col("suppression_reason").isNotNull()),
        (F.col("transition_type") == "deescalated") & ((F.col("delivery_disposition") != "suppressed") | (F.col("suppression_reason") != "deescalation_not_routed")),
    )
    said = outbox.withColumn("_p", json_object(F.col("payload_json"), "string"))
    p = lambda k: F.try_element_at("_p", F.lit(k))
    payload = any_true(F.col("_p").isNull(), p("metric") != F.col("metric_name"), p("status") != F.col("current_status"), p("portfolio") != F.col("portfolio_id"), F.abs(p("value").try_cast("double") - F.col("observed_value")) > NEAR)
    return suite(
        [
            same_count("outbox_current_per_actionable_transition", current, acts),
            measure("outbox_summary_reconciles", limits.outbox_summary(current, ["policy_id", "portfolio_id", "metric_name", "event_type", "delivery_disposition"]).select(F.col("events").alias("a"), F.lit(0).alias("e")).unionByName(current.select(F.lit(0).alias("a"), F.lit(1).alias("e"))), F.sum("a"), F.sum("e")),
            check("outbox_previous_evaluation_orphans", orphans(outbox, "source_previous_evaluation_calculation_id", evaluations)),
            check("outbox_transition_metadata_differs", pairs.where(unlike)),
            check("outbox_transition_ingest_differs", pairs.where(F.col("ts_ingest") != F.col("_ts_ingest"))),
            check("outbox_disposition_or_reason_wrong", outbox.where(disposition)),
            check("outbox_payload_identity_differs", said.where(payload)),
            check("outbox_candidate_missing", told.join(current.select("source_evaluation_calculation_id", "source_previous_evaluation_calculation_id", "transition_type"), whole, "left_anti")),
            check("outbox_current_is_stale", current.join(told, whole, "left_anti")),
        ]
    )


def daily_reconciliation(stored: DataFrame, raw: DataFrame, events: DataFrame, computed: DataFrame, semantic: DataFrame, latest: DataFrame, finance: DataFrame, needed: int) -> DataFrame:
    """Stored returns and the computed summary against their raw events; the ready rule; the rows with their dimension.

    ``stored`` and ``raw`` have normalised source and symbol; ``needed`` is the longer of the two windows.
    """
    seen = raw.select(F.col("event_id").alias("source_event_id"), "source", "symbol", "ts_event")
    told = events.select("event_id", "source", "symbol", F.to_date("ts_event").alias("day"))
    short = any_true(F.col("return_observations") < needed, F.col("var_observations") < needed, F.col("volatility_annualized").isNull())
    return suite(
        [
            check("daily_return_event_orphans", stored.join(seen, seen.columns, "left_anti")),
            check("daily_summary_event_orphans", computed.join(told, told.columns, "left_anti")),
            check("daily_summary_grain_repeated", repeated(computed, ["source", "symbol", "day"])),
            check("daily_ready_history_too_short", computed.where(F.col("history_status") == "ready").where(short)),
            same_count("daily_semantic_rows", semantic, computed),
            same_count("core_finance_rows", finance, latest),
        ]
    )


def portfolio_reconciliation(stored: DataFrame, returns: DataFrame, computed: DataFrame, needed: int) -> DataFrame:
    """Stored portfolio returns with the reference's tolerances, versions and evidence; the ready rule of the computed summary."""
    grain = ["portfolio_id", "definition_fingerprint", "ts_event", "model_version", "weighting_method"]
    latest = latest_by(stored, grain, ["ts_ingest", "calculation_id"])
    maps = {"w": "weights_json", "i": "component_calculation_ids_json", "r": "component_returns_json", "c": "contributions_json"}
    read = stored.withColumns({k: json_object(F.col(c), "string" if k == "i" else "double") for k, c in maps.items()})
    keys = lambda m: F.array_sort(F.map_keys(m))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    unlike = any_true(*(F.col(k).isNull() | (F.size(k) != F.col("constituent_count")) for k in maps), *(keys("w") != keys(k) for k in "irc"))
    parts = read.where("w is not null and r is not null and c is not null").select("w", "r", F.explode("c").alias("k", "v"))
    cited = read.where("i is not null").select(F.explode("i").alias("k", "calculation_id"))
    short = any_true(F.col("aligned_observations") < needed, F.col("var_observations") < needed, F.col("volatility_annualized").isNull())
    rows = json_numbers(F.col("contributions_json"))
    return suite(
        [
            check("portfolio_component_return_orphans", cited.join(returns.select("calculation_id"), "calculation_id", "left_anti")),
            check("portfolio_component_keys_wrong", read.where(unlike)),
            check("portfolio_weights_off_one", read.where(F.abs(total("w") - 1) > 1e-9)),
            check("portfolio_contributions_off_return", read.where(F.abs(total("c") - F.col("portfolio_return_1d")) > 1e-12)),
            check("portfolio_contributions_off_product", parts.where(F.abs(F.col("v") - F.try_element_at("w", F.col("k")) * F.try_element_at("r", F.col("k"))) > 1e-12)),
            check("portfolio_latest_grain_repeated", repeated(latest, grain)),
            check("portfolio_latest_is_stale", stale(latest, stored, grain)),
            measure("portfolio_contribution_rows", latest.select(F.coalesce(F.size(rows), F.lit(0)).alias("n"), "constituent_count"), F.sum("n"), F.sum("constituent_count")),
            check("portfolio_summary_grain_repeated", repeated(computed, ["portfolio_id", "definition_fingerprint", "day"])),
            check("portfolio_ready_history_too_short", computed.where(F.col("history_status") == "ready").where(short)),
        ]
    )


def attribution_reconciliation(stored: DataFrame, snapshots: DataFrame, matrix: DataFrame) -> DataFrame:
    """Stored attributions: versions, shares, constituents; computed snapshots: variance and the null cells of the matrix."""
    latest = latest_by(stored, ATTRIBUTION, ["ts_ingest", "calculation_id"])
    shares = latest.withColumn("s", json_numbers(F.col("component_contribution_share_json")))
    total = F.aggregate(F.map_values("s"), F.lit(0.0), lambda a, x: a + x)
    off = any_true(F.col("s").isNull(), F.size("s") != F.col("constituent_count"), (F.col("volatility_status") == "positive") & (F.abs(total - 1) > 1e-9), (F.col("volatility_status") == "zero") & (F.abs(total) > 1e-9))
    grain = ["portfolio_id", "definition_fingerprint", "day"]
    nulls = matrix.groupBy(*grain).agg(F.sum(F.col("correlation").isNull().cast("int")).alias("_nulls"))
    counted = snapshots.join(nulls, grain, "left")
    mirror = matrix.select(*grain, F.col("row_key").alias("column_key"), F.col("column_key").alias("row_key"), F.col("correlation").alias("_other"), F.lit(True).alias("_there"))
    cells = matrix.join(mirror, [*grain, "row_key", "column_key"], "left")
    lopsided = any_true(F.col("_there").isNull(), F.col("correlation").isNull() != F.col("_other").isNull(), F.abs(F.col("correlation") - F.col("_other")) > NEAR, F.abs("correlation") > 1 + NEAR, (F.col("row_key") == F.col("column_key")) & (F.abs(F.col("correlation") - 1) > NEAR))
    return suite(
        [
            measure("attribution_ids_surplus", stored, surplus_ids(stored)),
            check("attribution_latest_grain_repeated", repeated(latest, ATTRIBUTION)),
            check("attribution_latest_is_stale", stale(latest, stored, ATTRIBUTION)),
            check("attribution_stored_shares_wrong", shares.where(off)),
            measure("attribution_contribution_rows", shares.select(F.coalesce(F.size("s"), F.lit(0)).alias("n"), "constituent_count"), F.sum("n"), F.sum("constituent_count")),
            check("attribution_variance_is_not_squared_volatility", snapshots.where(F.abs(F.col("portfolio_variance") - F.col("portfolio_volatility") * F.col("portfolio_volatility")) > NEAR)),
            check("attribution_null_count_wrong", counted.where(~F.col("undefined_correlation_cells").eqNullSafe(F.col("_nulls")) | ((F.col("correlation_status") == "complete") != (F.col("_nulls") == 0)))),
            check("attribution_correlation_wrong", cells.where(lopsided)),
        ]
    )
