"""Whole pipelines: landed events to minute figures, closes to notification candidates.

Each pipeline returns its tables by name, lazily; ``write`` appends them to a
store, where a repeated run adds nothing. A batch that fails a gate raises before
anything is written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import daily, governance, limits, market, portfolio, quality
from tidegrid.session import stage
from tidegrid.sources import landed, provider, stores

#: The default thresholds (warning, critical) of volatility, and the maxima of the rates.
VOLATILITY = (0.03, 0.07)
MAX_LATE_RATE, MAX_DUPLICATE_RATE = 0.02, 0.01
#: The key of each table in a store.
KEYS = {
    "market_events": ["event_id"],
    "returns_1m": ["symbol", "ts_event", "event_id"],
    "data_quality_metrics": ["ts_ingest"],
    "risk_summary": ["symbol", "ts_ingest"],
    "external_signal_summary": ["name", "source", "signal_id"],
    "daily_risk_summary": ["summary_id"],
    "daily_returns": ["calculation_id"],
    "portfolio_daily_returns": ["calculation_id"],
    "portfolio_risk_attribution": ["calculation_id"],
    "portfolio_risk_limit_evaluations": ["calculation_id"],
    "portfolio_risk_notification_outbox": ["event_id"],
}


def event_gate() -> dict[str, Column]:
    """What every event of a batch must meet, in the order of required, null and range."""
    need = {f"{c}_present": F.col(c).isNotNull() for c in ("event_id", "symbol", "price", "volume", "ts_event", "ts_ingest", "source")}
    return need | {"price_above_zero": F.col("price") > 0, "volume_not_negative": F.col("volume") >= 0}


def minute(events: DataFrame, signals: DataFrame | None = None, late_seconds: int = market.LATE_SECONDS, window: int = market.VOLATILITY_WINDOW, volatility: tuple[float, float] = VOLATILITY) -> dict[str, DataFrame]:
    """Events in order of arrival (delivery_id) to deduplicated events, returns, quality and risk by symbol."""
    normal = stage(market.normalise(quality.gate(events, event_gate()), late_seconds), "minute-events")
    first = market.first_arrivals(normal)
    moves = stage(market.returns_and_volatility(first, window), "minute-moves")
    latest = normal.agg(F.max("ts_ingest").alias("ts_ingest"))
    rates = quality.batch_rates(normal).join(F.broadcast(latest), F.lit(True))  # one row each
    rates = rates.withColumn("late_status", quality.maximum_status(F.col("late_rate"), MAX_LATE_RATE)).withColumn("duplicate_status", quality.maximum_status(F.col("duplicate_rate"), MAX_DUPLICATE_RATE))
    tables = {"market_events": first.drop("delivery_id", "is_late", "window_start"), "returns_1m": moves, "data_quality_metrics": rates, "risk_summary": market.risk_summary(moves, *volatility)}
    if signals is not None:
        tables["external_signal_summary"] = market.latest_signals(signals)
    return tables


def daily_tables(events: DataFrame, volatility_window: int = 20, var_window: int = 252, confidence: float = 0.95, start: date | None = None, end: date | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """Events to daily returns and the daily risk summary.

    ``end`` limits what is known, ``start`` only what comes out. ``strict`` takes
    events that are daily closes and raises QualityError at others; else the last
    event of a day is its close.
    """
    known = daily.validated(events, end) if strict else events.where(F.to_date("ts_event") <= F.lit(end)) if end else events
    risk = stage(daily.daily_risk(daily.daily_closes(known), volatility_window=volatility_window, var_window=var_window, confidence=confidence), "daily-risk")
    risk = risk.where(F.col("day") >= F.lit(start)) if start else risk
    returns = risk.select("source", "symbol", F.to_timestamp("day").alias("ts_event"), F.col("return_ingest").alias("ts_ingest"), "return_1d", F.col("return_id").alias("calculation_id"))
    return {"daily_returns": returns, "daily_risk_summary": risk}


def portfolio_tables(daily_returns: DataFrame, parts: DataFrame, rule: governance.Version, volatility_window: int = 20, var_window: int = 60, start: date | None = None, end: date | None = None, most: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """Daily returns and constituents to portfolio risk, attribution, limit evaluations and candidates.

    ``end`` limits what is known, ``start`` only what comes out: windows use all
    history before it. Components are matched without regard to case. A table with
    more rows than ``most`` allows it raises CapExceeded; nothing is cut off.
    """
    known = daily_returns.where(F.to_date("ts_event") <= F.lit(end)) if end else daily_returns
    aligned = stage(portfolio.aligned_components(parts, portfolio.current_returns(known)), "aligned")
    returns = portfolio.portfolio_returns(aligned)
    window = rule.content["covariance_window"]
    snapshots = stage(portfolio.attribution_snapshots(aligned, portfolio.rolling_matrix(aligned, window), window), "snapshots")
    out = lambda df: df.where(F.col("day") >= F.lit(start)) if start else df
    bounds = rule.content["limits"]
    pair = lambda m: (bounds[m]["warning"], bounds[m]["critical"])
    evaluations = limits.evaluate(snapshots, pair(limits.VOLATILITY), pair(limits.CONCENTRATION), rule.content["limit_fingerprint"])
    evaluations = evaluations.withColumn("ts_event", F.to_timestamp("day")).withColumn("policy_id", F.lit(rule.owner)).withColumn("policy_fingerprint", F.lit(rule.content["limit_fingerprint"]))
    evaluations = evaluations.join(snapshots.select(F.col("calculation_id").alias("attribution_calculation_id"), "ts_ingest"), "attribution_calculation_id")
    moves = limits.transitions(evaluations, ["policy_fingerprint", "portfolio_id", "definition_fingerprint", "metric_name"])
    tables = {
        "portfolio_daily_returns": out(returns),
        "portfolio_daily_risk_summary": out(portfolio.portfolio_risk(returns, volatility_window, var_window)),
        "portfolio_risk_attribution": out(snapshots),
        "portfolio_risk_limit_evaluations": out(evaluations),
        "portfolio_risk_notification_outbox": out(limits.candidates(moves)),
    }
    return {name: stores.capped(df, most[name]) if most and name in most else df for name, df in tables.items()}


def governed(spark: SparkSession, daily_returns: DataFrame, mandates: Sequence[governance.Version], policies: Sequence[governance.Version], start: date, end: date) -> list[tuple[governance.Segment, dict[str, DataFrame]]]:
    """The portfolio pipeline for each segment of a plan, on the returns within the segment's mandate."""
    segments, _ = governance.plan(mandates, policies, start, end)
    runs = []
    for s in segments:
        day = F.to_date("ts_event")
        within = daily_returns.where(day >= F.lit(s.mandate.start))
        within = within.where(day < F.lit(s.mandate.end)) if s.mandate.end else within
        runs.append((s, portfolio_tables(within, governance.constituent_frame(spark, [s.mandate]), s.policy, start=s.start, end=s.end)))
    return runs


def write(tables: Mapping[str, DataFrame], folder: str, run: str, parameters: Mapping[str, Any]) -> dict[str, Any]:
    """Append each table to ``folder``/name by its key; the manifest with the rows written."""
    # the stores' partitions are named year, month, day and hour
    counts = {name: stores.append_curated(df.withColumnRenamed("day", "event_date"), f"{folder}/{name}", KEYS[name]) for name, df in tables.items() if name in KEYS}
    return stores.manifest(run, {}, counts, parameters)


def run_minute(spark: SparkSession, path: str, folder: str, source: str = "landed", signals_path: str | None = None, dry_run: bool = False, **options: Any) -> dict[str, Any]:
    """A landed file through the minute pipeline into a store. Rows that cannot be typed fail the batch; a dry run only counts rows."""
    events, rejected = landed.market_events(landed.read_landed(spark, path), source)
    if problems := [r.problems for r in rejected.select("problems").limit(5).collect()]:
        raise quality.QualityError(f"rows cannot be used: {problems}")
    signals = landed.signals(landed.read_landed(spark, signals_path), source)[0] if signals_path else None
    ordered = events.withColumn("delivery_id", F.monotonically_increasing_id())  # the order of the file
    tables = minute(stage(ordered, "landed"), signals, **options)
    if dry_run:
        return {"run": "minute", "rows": {name: df.count() for name, df in tables.items()}}
    return write(tables, folder, "minute", {"path": path} | options)


def ingest_provider(spark: SparkSession, body: bytes, symbol: str, source: str, path: str) -> int:
    """A provider's answer into the immutable raw store; the contract is checked first, the number of new bars returned."""
    bars = stage(provider.parse_daily(spark, body, symbol, source), "bars")
    told = bars.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.count_distinct("ts_event").alias("days"), F.count_distinct("ts_ingest").alias("stamps")).first()
    if not told.n or {told.ids, told.days} != {told.n} or told.stamps != 1:
        raise provider.ProviderError("the bars do not meet their contract")
    return stores.append_raw(bars, path, landed.EVENT_SCHEMA)
