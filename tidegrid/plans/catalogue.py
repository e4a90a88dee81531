"""The queries of the engine's analytics operators over the domain tables.

Instants come out as epoch seconds or microseconds and days as text, so that
results do not depend on a session's time zone; figures are rounded to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.text import id_key, symbol_key
from tidegrid.operators import checks, contracts, daily, limits, market, portfolio, quality, versions
from tidegrid.operators.serving import Warehouse
from tidegrid.sources import stores
from tidegrid.sources.tables import table
from tidegrid.session import stage

QUERIES = {}
VOL_WINDOW, VAR_WINDOW, COV_WINDOW = 5, 10, 10
#: Weights and shares of the given tables are written with 6 digits, so they add to 1 only to this tolerance.
GIVEN_DIGITS = 1e-5
POLICY = {"volatility": (0.25, 0.40), "share": (0.65, 0.80), "fingerprint": "catalogue-policy"}


def query(f):
    QUERIES[f.__name__] = f
    return f


def us(c: str) -> Column:
    return F.unix_micros(c)


def day(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def r6(*cols: str) -> list[Column]:
    return [F.round(c, 6).alias(c.split(".")[-1]) for c in cols]


def raw(*cols: str) -> list[Column]:
    """Stored figures as they are."""
    return [F.col(c) for c in cols]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return market.normalise(table(spark, folder, "market_events_raw"))


def _deduped(spark: SparkSession, folder: str) -> DataFrame:
    return market.first_arrivals(_events(spark, folder))


@query
def market_events_normalised(spark, folder):
    return _events(spark, folder).select("delivery_id", "event_id", "symbol", "price", "volume", "source", "is_late", us("ts_event").alias("event_us"), F.unix_seconds("window_start").alias("window_start"))


@query
def dedupe_first_seen(spark, folder):
    return _deduped(spark, folder).select("event_id", "delivery_id", "symbol", "price")


@query
def raw_dedupe_earliest_ingest(spark, folder):
    return market.earliest_ingested(_events(spark, folder)).select("event_id", "delivery_id")


@query
def raw_conflicts(spark, folder):
    return versions.content_conflicts(_events(spark, folder), "event_id", ["symbol", "price", "volume", "ts_event", "source"])


@query
def dq_json_fields(spark, folder):
    return quality.json_field_metrics(table(spark, folder, "portfolio_daily_returns"), "component_calculation_ids_json", ["feed_north:QELAW", "feed_north:VEXEX"]).toDF("rows", "missing_a", "null_a", "missing_b", "null_b")


@query
def dq_null_metrics(spark, folder):
    return quality.null_metrics(table(spark, folder, "market_events_raw"), ["event_id", "symbol", "price", "volume", "ts_event", "ts_ingest", "source"]).select("field", "rows", "nulls", *r6("null_rate"))


@query
def dq_range_metrics(spark, folder):
    return quality.range_metrics(table(spark, folder, "market_events_raw"), {"price": (0.0, None, False), "volume": (0.0, 1e9, True)})


@query
def dq_batch_rates(spark, folder):
    rates = quality.batch_rates(_events(spark, folder))
    return rates.select("total_events", "deduped_events", "duplicate_events", "late_events", *r6("late_rate", "duplicate_rate"), quality.maximum_status(F.col("late_rate"), 0.02).alias("late_status"), quality.maximum_status(F.col("duplicate_rate"), 0.01).alias("duplicate_status"))


@query
def dq_incidents(spark, folder):
    """Recorded profiles with any status but ok."""
    bad = quality.any_of([F.col(c) != "ok" for c in ("required_fields_status", "null_rate_status", "value_validity_status", "late_status", "duplicate_status")])
    return table(spark, folder, "data_quality_metrics").where(bad).select("metric_id", "batch_id", "late_status", "duplicate_status").distinct()


@query
def constraint_violations(spark, folder):
    c = F.col
    return quality.violations(
        table(spark, folder, "portfolio_risk_limit_evaluations"),
        {
            "thresholds_ordered": c("warning_threshold") <= c("critical_threshold"),
            "observed_not_negative": c("observed_value") >= 0,
            "excess_only_in_breach": c("is_breach") | (c("breach_excess") == 0),
            "currency_has_three_letters": F.length("base_currency") == 3,
            "portfolio_id_is_slug": c("portfolio_id").rlike("^[a-z0-9-]+$"),
        },
    )


@query
def late_rate_by_symbol(spark, folder):
    return market.lateness(_deduped(spark, folder)).select("symbol", "events", "late_events", *r6("late_rate"))


def _moves(spark, folder):
    return market.returns_and_volatility(_deduped(spark, folder), VOL_WINDOW)


@query
def minute_returns(spark, folder):
    return _moves(spark, folder).select("symbol", "event_id", us("ts_event").alias("event_us"), F.unix_seconds("window_start").alias("window_start"), *r6("return_1m", "volatility_5m"))


@query
def var_by_symbol(spark, folder):
    return market.value_at_risk(stage(_moves(spark, folder), "moves"), ["symbol"]).select("symbol", "observations", *r6("value_at_risk"))


@query
def risk_summary(spark, folder):
    out = market.risk_summary(stage(_moves(spark, folder), "moves"), 0.03, 0.07)
    return out.select("symbol", "observations", *r6("value_at_risk", "volatility_5m"), "volatility_status", us("ts_ingest").alias("ingest_us"))


@query
def signal_latest(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, folder, "events").select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("name"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("source"), "value", F.col("ts").alias("ts_event"), (F.col("ts") + F.make_dt_interval(secs=k * 5)).alias("ts_ingest"))
    return market.latest_signals(rows).select("name", "source", "signal_id", "value")


def _closes(spark, folder):
    return daily.daily_closes(_deduped(spark, folder))


@query
def daily_close(spark, folder):
    return _closes(spark, folder).select("source", "symbol", day("day"), "price", "event_id")


def _daily(spark, folder):
    return daily.daily_risk(_closes(spark, folder), volatility_window=VOL_WINDOW, var_window=VAR_WINDOW)


@query
def daily_risk_summary(spark, folder):
    return _daily(spark, folder).select("source", "symbol", day("day"), *r6("return_1d", "volatility_annualized", "historical_var_loss", "maximum_drawdown"), "var_observations", "price_observations", "return_observations", "history_status", "first_event_id", "event_id")


@query
def daily_return_ids(spark, folder):
    return _daily(spark, folder).select("source", "symbol", day("day"), "return_id", "volatility_id")


@query
def latest_daily_returns(spark, folder):
    rows = table(spark, folder, "daily_returns").where("ts_event is not null").withColumn("source", id_key(F.col("source"))).withColumn("symbol", symbol_key(F.col("symbol")))
    return versions.latest_by(rows, ["source", "symbol", "ts_event"], ["ts_ingest", "calculation_id"]).select("source", "symbol", us("ts_event").alias("event_us"), "calculation_id", *raw("return_1d")).distinct()


@query
def daily_semantic(spark, folder):
    """Daily risk with the current dimension of its symbol."""
    dims = table(spark, folder, "symbol_grid").select("symbol", "period_seconds")
    return versions.bounded_broadcast(dims).join(_daily(spark, folder), "symbol", "right").select("source", "symbol", day("day"), "period_seconds", *r6("return_1d"))


@query
def finance_semantic(spark, folder):
    """Risk summary with its dimension and the single latest quality row (a one-row side joined to all)."""
    dims = table(spark, folder, "symbol_grid").select("symbol", "period_seconds")
    dq = table(spark, folder, "data_quality_metrics").orderBy(F.desc("ts_ingest"), F.desc("metric_id")).limit(1).select(F.col("metric_id").alias("dq_metric_id"), F.col("late_status").alias("dq_late_status"))
    out = market.risk_summary(stage(_moves(spark, folder), "moves"), 0.03, 0.07).join(versions.bounded_broadcast(dims), "symbol", "left")
    return out.join(F.broadcast(dq), F.lit(True), "left").select("symbol", "volatility_status", "period_seconds", "dq_metric_id", "dq_late_status")


@query
def top_k_recent(spark, folder):
    return versions.newest(_deduped(spark, folder), ["symbol"], ["ts_event", "event_id"], 3).select("symbol", "recency", "event_id", "price")


@query
def freshness(spark, folder):
    names = ("market_events_raw", "returns_1m", "volatility_5m", "daily_returns", "portfolio_daily_returns")
    return market.freshness({n: table(spark, folder, n) for n in names}).select("table_name", us("latest").alias("latest_us"))


@query
def replay_partition_hour(spark, folder):
    """One hour of ts_ingest, as replayed."""
    rows = stores.by_hour(_events(spark, folder)).where("year = '2003' and month = '01' and day = '07' and hour = '10'")
    return rows.select("event_id", "delivery_id", us("ts_ingest").alias("ingest_us"))


@query
def bench_filter_agg(spark, folder):
    rows = table(spark, folder, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    return rows.agg(F.count("*").alias("rows"), F.round(F.avg("l_extendedprice"), 4).alias("average_price"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query
def definition_history(spark, folder):
    """Versions of the portfolios' definitions as half-open intervals."""
    return _definitions(spark, folder).select("portfolio_id", "definition_fingerprint", us("effective_from").alias("from_us"), us("effective_to").alias("to_us"), "is_current")


def _definitions(spark, folder):
    rows = table(spark, folder, "portfolio_daily_returns").where("portfolio_id is not null and ts_event is not null and definition_fingerprint is not null")
    return versions.effective_intervals(rows.groupBy("portfolio_id", "definition_fingerprint").agg(F.min("ts_event").alias("effective_from")), ["portfolio_id"])


@query
def asof_definition(spark, folder):
    """Each evaluation with the definition valid at its time."""
    facts = table(spark, folder, "portfolio_risk_limit_evaluations").select("calculation_id", "portfolio_id", "ts_event").distinct()
    return versions.as_of(facts, _definitions(spark, folder).select("portfolio_id", F.col("definition_fingerprint").alias("valid_fingerprint"), "effective_from", "effective_to"), ["portfolio_id"], "ts_event").select("calculation_id", "portfolio_id", "valid_fingerprint")


_MANDATES = [("m1", "2026-01-01", "2026-01-31"), ("m2", "2026-02-01", None)]
_POLICIES = [("p1", "2026-01-01", "2026-01-14"), ("p2", "2026-01-16", None)]


def _segments(spark):
    make = lambda rows, name: spark.createDataFrame([("all", *r) for r in rows], f"scope string, {name} string, effective_from string, effective_to string").withColumns({c: F.col(c).cast("date") for c in ("effective_from", "effective_to")})
    return versions.overlaps(make(_MANDATES, "mandate"), make(_POLICIES, "policy"), ["scope"])


@query
def governed_segments(spark, folder):
    return _segments(spark).select("mandate", "policy", day("segment_start"), day("segment_end"))


@query
def governed_gaps(spark, folder):
    return versions.coverage_gaps(_segments(spark), ["scope"]).select("scope", day("previous_end"), day("next_start"), "problem")


def _aligned(spark, folder):
    parts = stage(portfolio.constituents(table(spark, folder, "portfolio_daily_returns"), GIVEN_DIGITS), "constituents")
    return portfolio.aligned_components(parts, portfolio.current_returns(table(spark, folder, "daily_returns")))


@query
def portfolio_constituents(spark, folder):
    return portfolio.constituents(table(spark, folder, "portfolio_daily_returns"), GIVEN_DIGITS).select("portfolio_id", "definition_fingerprint", "component", "size", *r6("weight"))


@query
def portfolio_returns(spark, folder):
    return portfolio.portfolio_returns(_aligned(spark, folder)).select("portfolio_id", "definition_fingerprint", day("day"), F.col("size").alias("constituents"), *r6("portfolio_return_1d"))


@query
def portfolio_return_ids(spark, folder):
    return portfolio.portfolio_returns(_aligned(spark, folder)).select("portfolio_id", "definition_fingerprint", day("day"), "calculation_id")


@query
def portfolio_risk_summary(spark, folder):
    out = portfolio.portfolio_risk(portfolio.portfolio_returns(_aligned(spark, folder)), VOL_WINDOW, VAR_WINDOW)
    return out.select("portfolio_id", "definition_fingerprint", day("day"), "aligned_observations", "var_observations", "history_status", *r6("volatility_annualized", "historical_var_loss", "maximum_drawdown"))


@query
def latest_portfolio_returns(spark, folder):
    rows = table(spark, folder, "portfolio_daily_returns")
    return versions.latest_by(rows, ["portfolio_id", "definition_fingerprint", "weighting_method", "ts_event"], ["ts_ingest", "calculation_id"]).select("portfolio_id", us("ts_event").alias("event_us"), "calculation_id", *raw("portfolio_return_1d")).distinct()


@query
def portfolio_contributions(spark, folder):
    return portfolio.contributions(table(spark, folder, "portfolio_daily_returns").dropDuplicates()).select("portfolio_id", day("day"), "calculation_id", "component", *raw("weight", "component_return", "contribution"))


def _matrix(spark, folder):
    return portfolio.rolling_matrix(_aligned(spark, folder), COV_WINDOW)


@query
def rolling_covariance(spark, folder):
    return _matrix(spark, folder).select("portfolio_id", "definition_fingerprint", day("day"), day("window_start"), "row_key", "column_key", *r6("covariance_annualized", "correlation"))


@query
def euler_attribution(spark, folder):
    return portfolio.euler_attribution(_matrix(spark, folder)).select("portfolio_id", "definition_fingerprint", day("day"), "component", "volatility_status", *r6("portfolio_volatility", "component_contribution", "contribution_share"))


def _computed_evaluations(spark, folder):
    aligned = stage(_aligned(spark, folder), "aligned")
    snaps = portfolio.attribution_snapshots(aligned, portfolio.rolling_matrix(aligned, COV_WINDOW), COV_WINDOW)
    return limits.evaluate(snaps, POLICY["volatility"], POLICY["share"], POLICY["fingerprint"])


@query
def attribution_snapshots(spark, folder):
    aligned = stage(_aligned(spark, folder), "aligned")
    snaps = portfolio.attribution_snapshots(aligned, portfolio.rolling_matrix(aligned, COV_WINDOW), COV_WINDOW)
    return snaps.select("portfolio_id", "definition_fingerprint", day("day"), "calculation_id", "volatility_status", "correlation_status", "undefined_correlation_cells", *r6("portfolio_variance", "portfolio_volatility"), (F.round("euler_residual", 6) + 0.0).alias("euler_residual"))


@query
def limit_evaluations(spark, folder):
    return _computed_evaluations(spark, folder).select("portfolio_id", "definition_fingerprint", day("day"), "metric_name", "subject_key", "status", "is_breach", *r6("observed_value", "breach_excess"))


def _stored_evaluations(spark, folder):
    return table(spark, folder, "portfolio_risk_limit_evaluations").where("ts_event is not null").dropDuplicates()


def _latest_evaluations(spark, folder):
    return limits.latest_evaluations(_stored_evaluations(spark, folder))


@query
def limit_snapshot_status(spark, folder):
    out = limits.snapshot_status(_latest_evaluations(spark, folder))
    return out.select("policy_id", "portfolio_id", us("ts_event").alias("event_us"), "evaluations", "breaches", "criticals", "status")


@query
def metric_transitions(spark, folder):
    return limits.transitions(_latest_evaluations(spark, folder)).select("calculation_id", "previous_calculation_id", "previous_status", "status", "transition_type", "severity_rank", "subject_changed")


@query
def actionable_transitions(spark, folder):
    return limits.actionable(limits.transitions(_latest_evaluations(spark, folder))).select("calculation_id", "transition_type")


def _episodes(spark, folder):
    return limits.episodes(limits.transitions(_latest_evaluations(spark, folder)))


@query
def breach_episodes(spark, folder):
    return _episodes(spark, folder).select(
        "policy_fingerprint", "definition_fingerprint", "portfolio_id", "metric_name", "episode_sequence", us("episode_start").alias("start_us"), us("last_breach").alias("last_us"), "episode_status", "breach_observations", "warning_observations", "critical_observations", "subject_changes",
        F.col("opening.calculation_id").alias("opening_id"), F.col("latest.calculation_id").alias("latest_id"), F.col("peak.calculation_id").alias("peak_id"), F.col("resolution.calculation_id").alias("resolution_id"), *r6("peak.observed_value"),
    )


@query
def open_episodes(spark, folder):
    return _episodes(spark, folder).where("episode_status = 'open'").select("portfolio_id", "metric_name", "episode_sequence", us("episode_start").alias("start_us"))


@query
def notification_candidates(spark, folder):
    return limits.candidates(limits.transitions(_latest_evaluations(spark, folder))).select("event_id", "event_type", "delivery_disposition", "suppression_reason", F.col("calculation_id").alias("evaluation_id"))


def _outbox(spark, folder):
    return table(spark, folder, "portfolio_risk_notification_outbox").dropDuplicates()


def _current_outbox(spark, folder):
    return limits.current_outbox(_outbox(spark, folder), limits.transitions(_latest_evaluations(spark, folder)))


@query
def outbox_current(spark, folder):
    return _current_outbox(spark, folder).select("event_id", "delivery_disposition").distinct()


@query
def outbox_summary(spark, folder):
    """All stored messages by the coarser keys; the view of the current ones is view_outbox_summary."""
    return limits.outbox_summary(_outbox(spark, folder), ["policy_id", "portfolio_id", "metric_name", "event_type", "delivery_disposition"]).select("policy_id", "portfolio_id", "metric_name", "event_type", "delivery_disposition", "events", us("first_event").alias("first_us"), us("last_event").alias("last_us"))


def _acknowledgements(spark, folder):
    """Requests derived of the outbox: pending messages are acknowledged an hour after they were written, some twice."""
    rows = _outbox(spark, folder).where("delivery_disposition = 'pending' and ts_ingest is not null")
    asked = rows.select(id_key(F.col("source_evaluation_calculation_id")).alias("calculation_id"), F.explode(F.array("event_id", F.concat("event_id", F.lit("-again")))).alias("request_id"), (F.col("ts_ingest") + F.expr("interval 1 hour")).alias("acknowledged_at"), F.col("portfolio_id").alias("acknowledged_by"))
    return limits.acknowledge(_latest_evaluations(spark, folder).dropDuplicates(["calculation_id"]), asked)


@query
def breach_ack_status(spark, folder):
    latest = _latest_evaluations(spark, folder).dropDuplicates(["calculation_id"])
    return limits.breach_status(latest, _acknowledgements(spark, folder)).select("calculation_id", "acknowledgements", "acknowledgement_status", us("acknowledged_at").alias("acknowledged_us"))


def _split(spark, folder):
    rows = table(spark, folder, "daily_returns").select("calculation_id", "ts_ingest", "return_1d").where("ts_ingest is not null")
    rows = rows.groupBy("calculation_id").agg(F.min("ts_ingest").alias("ts_ingest"), F.min("return_1d").alias("return_1d"))
    part = F.ascii(F.right("calculation_id", F.lit(1))) % 3
    stored, incoming = rows.where(part != 2), rows.where(part != 0).withColumn("return_1d", F.col("return_1d") + 1)
    return stored, incoming.withColumn("ts_ingest", F.when(part == 1, F.col("ts_ingest") - F.expr("interval 1 day")).otherwise(F.col("ts_ingest")))


@query
def upsert_latest_wins(spark, folder):
    return versions.upsert(*_split(spark, folder), ["calculation_id"]).select("calculation_id", *raw("return_1d"))


@query
def upsert_guarded(spark, folder):
    return versions.upsert_newer(*_split(spark, folder), ["calculation_id"]).select("calculation_id", *raw("return_1d"))


@query
def insert_only(spark, folder):
    return versions.insert_new(*_split(spark, folder), ["calculation_id"]).select("calculation_id")


@query
def checks_core(spark, folder):
    raw, events = table(spark, folder, "market_events_raw"), stage(_events(spark, folder), "events")
    return checks.core_checks(raw, events, market.first_arrivals(events), quality.batch_rates(events))


@query
def checks_daily(spark, folder):
    rows = table(spark, folder, "daily_returns").where("ts_event is not null").withColumn("source", id_key(F.col("source"))).withColumn("symbol", symbol_key(F.col("symbol")))
    return checks.daily_checks(rows, versions.latest_by(rows, ["source", "symbol", "ts_event"], ["ts_ingest", "calculation_id"]))


@query
def checks_portfolio(spark, folder):
    return checks.portfolio_checks(table(spark, folder, "portfolio_daily_returns"))


@query
def checks_attribution(spark, folder):
    matrix = stage(_matrix(spark, folder), "matrix")
    return checks.attribution_checks(matrix, portfolio.euler_attribution(matrix))


@query
def checks_limits(spark, folder):
    return checks.limit_checks(_stored_evaluations(spark, folder), _latest_evaluations(spark, folder), table(spark, folder, "portfolio_risk_attribution"))


@query
def checks_lifecycle(spark, folder):
    latest = stage(_latest_evaluations(spark, folder), "latest")
    moves = stage(limits.transitions(latest), "moves")
    return checks.lifecycle_checks(latest, moves, limits.episodes(moves))


@query
def checks_outbox(spark, folder):
    return checks.outbox_checks(_outbox(spark, folder), _current_outbox(spark, folder), table(spark, folder, "portfolio_risk_limit_evaluations"))


@query
def checks_limits_evidence(spark, folder):
    """The reference's other checks of limits; here acknowledgements are the derived ones."""
    stored = stage(_stored_evaluations(spark, folder), "stored")
    latest = stage(limits.latest_evaluations(stored), "latest")
    return checks.limit_reconciliation(stored, latest, table(spark, folder, "portfolio_risk_attribution").dropDuplicates(), stage(_acknowledgements(spark, folder), "acknowledgements"))


@query
def checks_limits_snapshots(spark, folder):
    return checks.snapshot_checks(_latest_evaluations(spark, folder))


@query
def checks_lifecycle_episodes(spark, folder):
    """The reference's other checks of transitions and episodes."""
    moves = stage(limits.transitions(_latest_evaluations(spark, folder)), "moves")
    return checks.lifecycle_reconciliation(moves, stage(limits.episodes(moves), "episodes"))


@query
def checks_outbox_candidates(spark, folder):
    """The reference's other checks of the outbox against the transitions."""
    moves, outbox = stage(limits.transitions(_latest_evaluations(spark, folder)), "moves"), _outbox(spark, folder)
    return checks.outbox_reconciliation(outbox, stage(limits.current_outbox(outbox, moves), "current"), moves, _stored_evaluations(spark, folder))


@query
def checks_daily_history(spark, folder):
    """The reference's other checks of daily returns and of the views with a dimension."""
    keyed = lambda df: df.withColumn("source", id_key(F.col("source"))).withColumn("symbol", symbol_key(F.col("symbol")))
    raw, dims = table(spark, folder, "market_events_raw"), versions.bounded_broadcast(table(spark, folder, "symbol_grid").select("symbol", "period_seconds"))
    events = stage(_deduped(spark, folder), "events")
    risk = stage(daily.daily_risk(daily.daily_closes(events), volatility_window=VOL_WINDOW, var_window=VAR_WINDOW), "daily")
    latest = stage(market.risk_summary(stage(market.returns_and_volatility(events, VOL_WINDOW), "moves"), 0.03, 0.07), "risk")
    returns = table(spark, folder, "daily_returns").where("ts_event is not null")
    return checks.daily_reconciliation(keyed(returns), keyed(raw), events, risk, risk.join(dims, "symbol", "left"), latest, latest.join(dims, "symbol", "left"), max(VOL_WINDOW, VAR_WINDOW))


@query
def checks_portfolio_history(spark, folder):
    """The reference's other checks of portfolio returns."""
    stored = stage(table(spark, folder, "portfolio_daily_returns").where("ts_event is not null").dropDuplicates(), "stored")
    risk = stage(portfolio.portfolio_risk(portfolio.portfolio_returns(_aligned(spark, folder)), VOL_WINDOW, VAR_WINDOW), "portfolio")
    return checks.portfolio_reconciliation(stored, table(spark, folder, "daily_returns"), risk, max(VOL_WINDOW, VAR_WINDOW))


@query
def checks_attribution_history(spark, folder):
    """The reference's other checks of attributions, stored and computed."""
    aligned = stage(_aligned(spark, folder), "aligned")
    matrix = stage(portfolio.rolling_matrix(aligned, COV_WINDOW), "matrix")
    snapshots = stage(portfolio.attribution_snapshots(aligned, matrix, COV_WINDOW), "snapshots")
    return checks.attribution_reconciliation(table(spark, folder, "portfolio_risk_attribution").where("ts_event is not null").dropDuplicates(), snapshots, matrix)


def _warehouse(spark, folder):
    names = ("data_quality_metrics", "portfolio_daily_returns", "portfolio_risk_attribution", "portfolio_risk_limit_evaluations", "portfolio_risk_notification_outbox")
    return Warehouse({n: table(spark, folder, n).dropDuplicates() for n in names})


@query
def view_latest_attribution(spark, folder):
    return _warehouse(spark, folder).latest_portfolio_risk_attribution().select("portfolio_id", us("ts_event").alias("event_us"), "calculation_id", *raw("portfolio_volatility_annualized"))


@query
def view_volatility_contributions(spark, folder):
    return _warehouse(spark, folder).portfolio_volatility_contribution_model().select("calculation_id", "constituent_key", *raw("contribution_share"))


@query
def view_breaches(spark, folder):
    return _warehouse(spark, folder).portfolio_risk_limit_breaches().select("calculation_id", "metric_name", "status", *raw("breach_excess"))


@query
def view_contributions(spark, folder):
    return _warehouse(spark, folder).portfolio_daily_contribution_model().select("calculation_id", "component", *raw("contribution"))


@query
def view_pending(spark, folder):
    return _warehouse(spark, folder).portfolio_risk_notification_pending().select("event_id", "transition_type").distinct()


@query
def view_suppressed(spark, folder):
    return _warehouse(spark, folder).portfolio_risk_notification_suppressed().select("event_id", "suppression_reason").distinct()


@query
def ops_health(spark, folder):
    return _warehouse(spark, folder).pipeline_health()


@query
def ops_incidents(spark, folder):
    return _warehouse(spark, folder).recent_incidents().select("metric_id", us("ts_ingest").alias("ingest_us"))


@query
def contract_violations(spark, folder):
    """Rows of each dataset that break a constraint of its contract."""
    sets = {
        "market_events_raw": contracts.market_events(),
        "daily_returns": contracts.daily_returns(),
        "portfolio_daily_returns": contracts.portfolio_returns(1e-6, GIVEN_DIGITS),
        "portfolio_risk_attribution": contracts.attribution(GIVEN_DIGITS),
        "portfolio_risk_limit_evaluations": contracts.limit_evaluations(),
        "portfolio_risk_notification_outbox": contracts.outbox(),
    }
    rows = None
    for name, constraints in sets.items():
        part = quality.violations(table(spark, folder, name), constraints).withColumn("table_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("table_name", "constraint_name", "checked", "violations")


from tidegrid.plans.catalogue_sql import ORACLES  # noqa: E402, F401
