"""Constraints of the stored datasets, as named conditions that every row must meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.text import is_number, json_object


def _c(name: str) -> Column:
    return F.col(name)


def _total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)


def market_events() -> dict[str, Column]:
    return {
        "event_id_present": F.length(F.trim("event_id")) > 0,
        "symbol_is_upper": _c("symbol") == F.upper(F.trim("symbol")),
        "price_positive": is_number(_c("price")) & (_c("price") > 0),
        "volume_not_negative": _c("volume") >= 0,
        "not_ingested_before_event": _c("ts_ingest") >= _c("ts_event"),
    }


def daily_returns() -> dict[str, Column]:
    return {
        "id_has_form": _c("calculation_id").rlike("^daily-risk-v2-return-[0-9a-f]{24}$"),
        "return_above_minus_one": is_number(_c("return_1d")) & (_c("return_1d") > -1),
        "event_at_midnight": F.unix_micros("ts_event") % 86_400_000_000 == 0,
        "inputs_differ": _c("source_event_id") != _c("previous_source_event_id"),
    }


def portfolio_returns(tolerance: float = 1e-12, weight_tolerance: float = 1e-9) -> dict[str, Column]:
    w, r, c = (json_object(_c(n), "double") for n in ("weights_json", "component_returns_json", "contributions_json"))
    keys = lambda m: F.array_sort(F.map_keys(m))
    return {
        "id_has_form": _c("calculation_id").rlike("^portfolio-risk-v1-return-[0-9a-f]{24}$"),
        "evidence_readable": w.isNotNull() & r.isNotNull() & c.isNotNull(),
        "two_to_fifty_constituents": _c("constituent_count").between(2, 50),
        "constituents_counted": F.size(w) == _c("constituent_count"),
        "same_keys": (keys(w) == keys(r)) & (keys(w) == keys(c)),
        "weights_add_to_one": F.abs(_total(w) - 1) <= weight_tolerance,
        "contributions_add_up": F.abs(_total(c) - _c("portfolio_return_1d")) <= tolerance,
        "event_at_midnight": F.unix_micros("ts_event") % 86_400_000_000 == 0,
    }


def attribution(share_tolerance: float = 1e-9) -> dict[str, Column]:
    shares = json_object(_c("component_contribution_share_json"), "double")
    zero = _c("portfolio_volatility_annualized") <= 1e-12
    return {
        "window_at_least_two": _c("covariance_window") >= 2,
        "window_full": _c("window_observations") == _c("covariance_window"),
        "window_ordered": _c("window_start") < _c("window_end"),
        "window_ends_at_event": _c("window_end") == _c("ts_event"),
        "volatility_not_negative": _c("portfolio_volatility_annualized") >= 0,
        "status_matches": F.when(_c("volatility_status") == "zero", zero).otherwise(~zero),
        "two_shares_or_more": F.size(shares) >= 2,
        "shares_add_to_one": zero | (F.abs(_total(shares) - 1) <= share_tolerance),
    }


def limit_evaluations() -> dict[str, Column]:
    breach = _c("is_breach")
    return {
        "status_known": _c("status").isin("ok", "warning", "critical"),
        "thresholds_ordered": (_c("warning_threshold") >= 0) & (_c("warning_threshold") < _c("critical_threshold")),
        "observed_not_negative": _c("observed_value") >= 0,
        "observed_is_magnitude": F.abs(_c("observed_value") - F.abs("observed_signed_value")) <= 1e-9,
        "breach_is_not_ok": breach == (_c("status") != "ok"),
        "threshold_only_in_breach": breach == _c("breach_threshold").isNotNull(),
        "excess_matches": F.abs(_c("breach_excess") - F.when(breach, _c("observed_value") - _c("breach_threshold")).otherwise(0.0)) <= 1e-6,
    }


def outbox() -> dict[str, Column]:
    pending = _c("delivery_disposition") == "pending"
    return {
        "disposition_known": _c("delivery_disposition").isin("pending", "suppressed"),
        "transition_is_actionable": _c("transition_type").isin("opened", "escalated", "deescalated", "resolved"),
        "type_names_transition": _c("event_type") == F.concat(F.lit("breach_"), "transition_type"),
        "only_deescalations_suppressed": pending == (_c("transition_type") != "deescalated"),
        "reason_only_if_suppressed": pending == _c("suppression_reason").isNull(),
        "severity_matches": _c("severity_rank") == F.when(_c("current_status") == "critical", 2).when(_c("current_status") == "warning", 1).otherwise(0),
        "payload_readable": json_object(_c("payload_json"), "string").isNotNull(),
    }


#: Stored tables: texts that must be there, JSON objects, figures that must be finite, and whether a currency is stored.
COMMON: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], bool]] = {
    "daily_returns": (("calculation_id", "model_version", "source", "symbol", "source_event_id", "previous_source_event_id"), (), ("return_1d",), False),
    "portfolio_daily_returns": (
        ("calculation_id", "model_version", "portfolio_id", "definition_fingerprint", "weighting_method"),
        ("weights_json", "component_calculation_ids_json", "component_returns_json", "contributions_json"),
        ("portfolio_return_1d",),
        True,
    ),
    "portfolio_risk_attribution": (
        ("calculation_id", "model_version", "portfolio_id", "definition_fingerprint", "weighting_method", "covariance_method", "correlation_method", "volatility_status"),
        ("component_contribution_share_json",),
        ("portfolio_volatility_annualized",),
        True,
    ),
    "portfolio_risk_limit_evaluations": (
        ("calculation_id", "model_version", "policy_id", "policy_fingerprint", "portfolio_id", "definition_fingerprint", "attribution_calculation_id", "attribution_model_version", "weighting_method", "covariance_method", "correlation_method", "metric_name", "subject_type", "subject_key", "unit", "status"),
        (),
        ("observed_value", "observed_signed_value", "warning_threshold", "critical_threshold", "breach_excess"),
        True,
    ),
    "portfolio_risk_notification_outbox": (
        ("event_id", "model_version", "event_type", "transition_type", "delivery_disposition", "source_evaluation_calculation_id", "policy_id", "portfolio_id", "metric_name", "subject_type", "subject_key", "current_status"),
        ("payload_json",),
        ("observed_value", "warning_threshold", "critical_threshold"),
        False,
    ),
}


def common(table: str) -> dict[str, Column]:
    """The constraints of a stored table that come of its row in COMMON; a null figure or time meets them."""
    texts, objects, numbers, currency = COMMON[table]
    rules = {f"{t}_present": F.coalesce(_c(t) != "", F.lit(False)) for t in texts}
    rules |= {f"{o}_is_object": json_object(_c(o), "string").isNotNull() for o in objects}
    rules |= {f"{n}_finite": ~F.isnan(n) & (F.abs(n) < float("inf")) | _c(n).isNull() for n in numbers}
    rules["ingested_after_event"] = _c("ts_ingest") >= _c("ts_event")
    if currency:
        rules["currency_upper"] = _c("base_currency") == F.upper("base_currency")
    return rules
