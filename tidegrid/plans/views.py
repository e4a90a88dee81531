"""Queries through the reporting views, over a warehouse of stored and computed tables, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import contracts, daily, limits, market, portfolio, quality, versions
from tidegrid.operators.serving import Warehouse
from tidegrid.plans import catalogue as c
from tidegrid.plans.catalogue import COV_WINDOW, VAR_WINDOW, VOL_WINDOW, day, r6, us
from tidegrid.plans.catalogue_sql import ALIGNED, CLOSES, CURRENT, DAILY, DD, DEFS, EULER, EV, LATEST, MATRIX, MOVES, OUTBOX, PARTS, RETURN_IDS, SUMMARY, TRANSITIONS, _day, _id, _rows
from tidegrid.session import stage
from tidegrid.sources.tables import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def symbol_dimension(events: DataFrame) -> DataFrame:
    """A history of symbols by source: one version per month in which the source tells of the symbol, the last is current."""
    months = events.groupBy("source", "symbol", F.date_format("ts_event", "yyyy-MM").alias("sector")).agg(F.min("ts_event").alias("effective_from"))
    return versions.effective_intervals(months.withColumn("asset_class", F.substring("source", 1, 4)).withColumn("reporting_currency", F.lit("USD")), ["source", "symbol"])


def _market(spark: SparkSession, folder: str) -> Warehouse:
    events = stage(c._deduped(spark, folder), "view-events")
    moves = stage(market.returns_and_volatility(events, VOL_WINDOW), "view-moves")
    risk = daily.daily_risk(daily.daily_closes(events), volatility_window=VOL_WINDOW, var_window=VAR_WINDOW)
    named = {"model_version": daily.MODEL_VERSION, "volatility_window": VOL_WINDOW, "var_window": VAR_WINDOW, "var_confidence": 0.95, "annualization_days": daily.TRADING_DAYS}
    risk = risk.withColumns({k: F.lit(v) for k, v in named.items()}).withColumn("ts_event", F.to_timestamp("day")).withColumn("ts_ingest", F.col("history_ingest")).withColumn("calculation_id", F.col("summary_id"))
    return Warehouse(
        {
            "risk_summary": market.risk_summary(moves, 0.03, 0.07),
            "daily_risk_summary": risk,
            "symbol_dimension_history": symbol_dimension(c._events(spark, folder)),
            "data_quality_metrics": table(spark, folder, "data_quality_metrics").dropDuplicates(),
        }
    )


def _nested(value: str) -> Column:
    """{row: {column: value}} of one snapshot as JSON."""
    return F.to_json(F.map_from_entries(F.collect_list(F.struct("row_key", value))))


def _portfolios(spark: SparkSession, folder: str) -> Warehouse:
    aligned = stage(c._aligned(spark, folder), "view-aligned")
    matrix = stage(portfolio.rolling_matrix(aligned, COV_WINDOW), "view-matrix")
    grain = ["portfolio_id", "definition_fingerprint", "day"]
    lines = matrix.groupBy(*grain, "row_key").agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_key", v)))).alias(v) for v in ("covariance_annualized", "correlation")))
    nested = lines.groupBy(*grain).agg(*(_nested(v).alias(f"{v}_json") for v in ("covariance_annualized", "correlation")))
    named = {"weighting_method": portfolio.WEIGHTING_METHOD, "annualization_days": portfolio.TRADING_DAYS}
    timed = lambda df: df.withColumns({k: F.lit(v) for k, v in named.items()}).withColumn("ts_event", F.to_timestamp("day"))
    snaps = timed(portfolio.attribution_snapshots(aligned, matrix, COV_WINDOW).join(nested, grain)).withColumns(
        {"model_version": F.lit(portfolio.ATTRIBUTION_VERSION), "covariance_method": F.lit(portfolio.COVARIANCE_METHOD), "correlation_method": F.lit(portfolio.CORRELATION_METHOD), "covariance_window": F.lit(COV_WINDOW), "window_end": F.col("day")}
    )
    risk = timed(portfolio.portfolio_risk(portfolio.portfolio_returns(aligned), VOL_WINDOW, VAR_WINDOW)).withColumns({"model_version": F.lit(portfolio.RETURN_VERSION), "volatility_window": F.lit(VOL_WINDOW), "var_window": F.lit(VAR_WINDOW), "var_confidence": F.lit(0.95), "weights_json": F.lit("{}")})
    return Warehouse({"portfolio_risk_attribution": snaps, "portfolio_daily_risk_summary": risk})


def _limits(spark: SparkSession, folder: str) -> Warehouse:
    return Warehouse({"portfolio_risk_limit_evaluations": c._stored_evaluations(spark, folder), "portfolio_risk_notification_outbox": c._outbox(spark, folder), "portfolio_risk_limit_acknowledgements": stage(c._acknowledgements(spark, folder), "view-acknowledgements")})


@query
def view_latest_risk_summary(spark, folder):
    return _market(spark, folder).latest_risk_summary().select("symbol", "observations", us("ts_ingest").alias("ingest_us"), *r6("value_at_risk"))


@query
def view_symbol_dimension(spark, folder):
    return _market(spark, folder).current_symbol_dimension().select("source", "symbol", "sector", us("effective_from").alias("from_us"))


@query
def view_latest_daily_risk(spark, folder):
    return _market(spark, folder).latest_daily_risk_summary().select("source", "symbol", day("day"), "history_status", *r6("return_1d", "maximum_drawdown"))


@query
def view_daily_semantic(spark, folder):
    return _market(spark, folder).daily_risk_semantic_model().select("source", "symbol", day("day"), "asset_class", "sector", *r6("return_1d"))


@query
def view_finance_semantic(spark, folder):
    return _market(spark, folder).finance_risk_semantic_model().select("symbol", "source", "asset_class", "sector", "required_fields_status", "null_rate_status", *r6("value_at_risk"))


@query
def view_latest_portfolio_risk(spark, folder):
    return _portfolios(spark, folder).latest_portfolio_daily_risk_summary().select("portfolio_id", "definition_fingerprint", day("day"), "calculation_id", "aligned_observations", *r6("portfolio_return_1d"))


@query
def view_portfolio_semantic(spark, folder):
    return _portfolios(spark, folder).portfolio_risk_semantic_model().select("portfolio_id", "definition_fingerprint", us("metric_ts").alias("metric_us"), "calculation_id", "history_status")


@query
def view_attribution_semantic(spark, folder):
    return _portfolios(spark, folder).portfolio_attribution_semantic_model().select("portfolio_id", "definition_fingerprint", us("metric_ts").alias("metric_us"), "volatility_status", *r6("portfolio_volatility"))


@query
def view_covariance(spark, folder):
    return _portfolios(spark, folder).portfolio_covariance_model().select("portfolio_id", "definition_fingerprint", us("ts_event").alias("event_us"), "row_constituent_key", "column_constituent_key", *r6("covariance_annualized"))


@query
def view_correlation(spark, folder):
    return _portfolios(spark, folder).portfolio_correlation_model().select("portfolio_id", "definition_fingerprint", us("ts_event").alias("event_us"), "row_constituent_key", "column_constituent_key", "correlation_undefined", *r6("correlation"))


@query
def view_acknowledgement_history(spark, folder):
    return _limits(spark, folder).portfolio_risk_limit_acknowledgement_history().select("calculation_id", "request_id", us("acknowledged_at").alias("acknowledged_us"))


@query
def view_open_breaches(spark, folder):
    return _limits(spark, folder).portfolio_risk_limit_open_breaches().select("calculation_id", "metric_name", "status")


@query
def view_acknowledged_breaches(spark, folder):
    return _limits(spark, folder).portfolio_risk_limit_acknowledged_breaches().select("calculation_id", "acknowledgements", us("acknowledged_at").alias("acknowledged_us"))


@query
def view_outbox_summary(spark, folder):
    """The current messages by the eight keys of the summary."""
    return _limits(spark, folder).portfolio_risk_notification_outbox_summary().select(*limits.SUMMARY_KEYS, "events", us("first_event").alias("first_us"), us("last_event").alias("last_us"))


@query
def governed_history(spark, folder):
    """Closed segments in which one definition and one policy of a portfolio hold together, from the stored tables."""
    defined = c._definitions(spark, folder).select("portfolio_id", "definition_fingerprint", F.to_date("effective_from").alias("effective_from"), F.date_sub(F.to_date("effective_to"), 1).alias("effective_to"))
    ruled = c._stored_evaluations(spark, folder).where("portfolio_id is not null and policy_fingerprint is not null").groupBy("portfolio_id", "policy_fingerprint").agg(F.min(F.to_date("ts_event")).alias("effective_from"))
    ruled = versions.effective_intervals(ruled, ["portfolio_id"]).drop("is_current").withColumn("effective_to", F.date_sub("effective_to", 1))
    return versions.overlaps(defined, ruled, ["portfolio_id"]).select("portfolio_id", "definition_fingerprint", "policy_fingerprint", day("segment_start"), day("segment_end"))


@query
def limit_diagnostics(spark, folder):
    out = limits.diagnostics(c._stored_evaluations(spark, folder))
    return out.select("policy_id", "policy_fingerprint", "matched_records", "current_evaluations", "snapshots", "ok", "warning", "critical", day("first_date"), day("last_date"))


@query
def alignment_diagnostics(spark, folder):
    parts = stage(portfolio.constituents(table(spark, folder, "portfolio_daily_returns"), c.GIVEN_DIGITS), "view-constituents")
    out = portfolio.alignment_diagnostics(parts, portfolio.current_returns(table(spark, folder, "daily_returns")))
    return out.select("portfolio_id", "definition_fingerprint", "candidate_dates", "aligned_dates", "dropped_incomplete_dates", day("first_aligned"), day("last_aligned"))


@query
def contract_common(spark, folder):
    """The constraints that all stored tables share in form: present texts, upper-case currencies, JSON objects, order of times, finite figures."""
    rows = None
    for name in contracts.COMMON:
        part = quality.violations(table(spark, folder, name), contracts.common(name)).withColumn("table_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("table_name", "constraint_name", "checked", "violations")


_DIMENSION = "months AS (SELECT source, symbol, strftime(make_timestamp(e), '%Y-%m') AS sector, min(e) AS from_us FROM ev GROUP BY ALL), dim AS (SELECT *, substr(source, 1, 4) AS asset_class FROM months QUALIFY lead(from_us) OVER (PARTITION BY source, symbol ORDER BY from_us) IS NULL)"
_DAY_US = "d * 86400000000"
_ASKED = f"asked AS (SELECT {_id('source_evaluation_calculation_id')} AS id, unnest([event_id, event_id || '-again']) AS request, epoch_us(ts_ingest) + 3600000000 AS t FROM ob WHERE delivery_disposition = 'pending' AND ts_ingest IS NOT NULL)"
_ACKS = "one AS (SELECT * FROM lat QUALIFY row_number() OVER (PARTITION BY calculation_id) = 1), acks AS (SELECT id, request, t FROM (SELECT id, request, min(t) AS t FROM asked GROUP BY ALL) a JOIN one ON one.calculation_id = a.id AND one.is_breach AND a.t >= epoch_us(one.ts_event))"
_QUALITY = "(SELECT required_fields_status, null_rate_status FROM (SELECT DISTINCT * FROM data_quality_metrics) ORDER BY ts_ingest DESC NULLS LAST, metric_id DESC LIMIT 1)"


def _common_sql(name: str) -> str:
    texts, objects, numbers, currency = contracts.COMMON[name]
    rules = {f"{t}_present": f"{t} IS NOT NULL AND {t} <> ''" for t in texts}
    rules |= {f"{o}_is_object": f"CASE WHEN json_valid({o}) THEN json_type({o}) = 'OBJECT' ELSE FALSE END" for o in objects}
    rules |= {f"{n}_finite": f"isfinite({n})" for n in numbers}
    rules["ingested_after_event"] = "ts_ingest >= ts_event"
    if currency:
        rules["currency_upper"] = "base_currency = upper(base_currency)"
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{rule}' AS constraint_name, count(*) AS checked, count(*) FILTER (WHERE NOT ({test})) AS violations FROM {name}" for rule, test in rules.items())


ORACLES = {
    "view_latest_risk_summary": _rows("SELECT symbol, observations, ingest_us, round(value_at_risk, 6) AS value_at_risk FROM summary", EV, DD, MOVES, SUMMARY),
    "view_symbol_dimension": _rows("SELECT source, symbol, sector, from_us FROM dim", EV, _DIMENSION),
    "view_latest_daily_risk": _rows(f"SELECT source, symbol, {_day(_DAY_US)} AS day, CASE WHEN n - 1 >= 10 THEN 'ready' ELSE 'partial' END AS history_status, round(r, 6) AS return_1d, round(worst, 6) AS maximum_drawdown FROM daily WHERE n > 1", EV, DD, CLOSES, DAILY),
    "view_daily_semantic": _rows(f"SELECT daily.source, daily.symbol, {_day(_DAY_US)} AS day, asset_class, sector, round(r, 6) AS return_1d FROM daily LEFT JOIN dim USING (source, symbol) WHERE n > 1", EV, DD, CLOSES, DAILY, _DIMENSION),
    "view_finance_semantic": _rows(f"SELECT summary.symbol, source, asset_class, sector, required_fields_status, null_rate_status, round(value_at_risk, 6) AS value_at_risk FROM summary LEFT JOIN (SELECT * FROM dim QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY source) = 1) k ON k.symbol = summary.symbol LEFT JOIN {_QUALITY} ON TRUE", EV, DD, MOVES, SUMMARY, _DIMENSION),
    "view_latest_portfolio_risk": _rows(f"SELECT portfolio_id, definition_fingerprint, {_day(_DAY_US)} AS day, id AS calculation_id, row_number() OVER (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d) AS aligned_observations, round(r, 6) AS portfolio_return_1d FROM pr JOIN pri USING (portfolio_id, definition_fingerprint, d)", PARTS, ALIGNED, RETURN_IDS),
    "view_portfolio_semantic": _rows("SELECT portfolio_id, definition_fingerprint, d * 86400000000 AS metric_us, id AS calculation_id, CASE WHEN row_number() OVER (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d) >= 10 THEN 'ready' ELSE 'partial' END AS history_status FROM pri", PARTS, ALIGNED, RETURN_IDS),
    "view_attribution_semantic": _rows("SELECT DISTINCT portfolio_id, definition_fingerprint, d * 86400000000 AS metric_us, CASE WHEN positive THEN 'positive' ELSE 'zero' END AS volatility_status, round(vol, 6) AS portfolio_volatility FROM es", PARTS, ALIGNED, MATRIX, EULER),
    "view_covariance": _rows("SELECT portfolio_id, definition_fingerprint, d * 86400000000 AS event_us, row_key AS row_constituent_key, column_key AS column_constituent_key, round(cov, 6) AS covariance_annualized FROM mx", PARTS, ALIGNED, MATRIX),
    "view_correlation": _rows("SELECT portfolio_id, definition_fingerprint, d * 86400000000 AS event_us, row_key AS row_constituent_key, column_key AS column_constituent_key, corr IS NULL AS correlation_undefined, round(corr, 6) AS correlation FROM mx", PARTS, ALIGNED, MATRIX),
    "view_acknowledgement_history": _rows("SELECT id AS calculation_id, request AS request_id, t AS acknowledged_us FROM acks", LATEST, OUTBOX, _ASKED, _ACKS),
    "view_open_breaches": _rows("SELECT calculation_id, metric_name, status FROM lat WHERE is_breach AND calculation_id NOT IN (SELECT id FROM acks)", LATEST, OUTBOX, _ASKED, _ACKS),
    "view_acknowledged_breaches": _rows("SELECT calculation_id, n AS acknowledgements, t AS acknowledged_us FROM lat JOIN (SELECT id, count(*) AS n, max(t) AS t FROM acks GROUP BY id) k ON k.id = lat.calculation_id WHERE is_breach", LATEST, OUTBOX, _ASKED, _ACKS),
    "view_outbox_summary": _rows(
        """SELECT policy_id, policy_fingerprint, portfolio_id, definition_fingerprint, metric_name, event_type, transition_type, delivery_disposition, count(*) AS events, epoch_us(min(ts_event)) AS first_us, epoch_us(max(ts_event)) AS last_us FROM cob
JOIN (SELECT calculation_id AS i, previous_calculation_id AS p, transition_type AS t, metric_name AS m, min(policy_fingerprint) AS policy_fingerprint, min(definition_fingerprint) AS definition_fingerprint FROM tr GROUP BY ALL) k
ON i = source_evaluation_calculation_id AND p IS NOT DISTINCT FROM source_previous_evaluation_calculation_id AND t = transition_type AND m = metric_name GROUP BY ALL""",
        OUTBOX, LATEST, TRANSITIONS, CURRENT,
    ),
    "governed_history": _rows(
        """SELECT d.portfolio_id, definition_fingerprint, policy_fingerprint, CAST(greatest(d.a, r.a) AS VARCHAR) AS segment_start, CAST(least(d.b, r.b) AS VARCHAR) AS segment_end FROM
  (SELECT portfolio_id, definition_fingerprint, CAST(make_timestamp(from_us) AS DATE) AS a, coalesce(CAST(make_timestamp(to_us) AS DATE) - 1, DATE '9999-12-31') AS b FROM defs) d JOIN
  (SELECT portfolio_id, policy_fingerprint, a, coalesce(CAST(lead(a) OVER (PARTITION BY portfolio_id ORDER BY a) AS DATE) - 1, DATE '9999-12-31') AS b FROM (SELECT portfolio_id, policy_fingerprint, min(CAST(make_timestamp(epoch_us(ts_event)) AS DATE)) AS a FROM portfolio_risk_limit_evaluations WHERE ts_event IS NOT NULL AND portfolio_id IS NOT NULL AND policy_fingerprint IS NOT NULL GROUP BY ALL)) r
  ON d.portfolio_id = r.portfolio_id AND greatest(d.a, r.a) <= least(d.b, r.b)""",
        DEFS,
    ),
    "limit_diagnostics": _rows(
        """SELECT policy_id, policy_fingerprint, matched_records, current_evaluations, snapshots, ok, warning, critical, first_date, last_date FROM
  (SELECT policy_id, policy_fingerprint, count(*) AS matched_records FROM (SELECT DISTINCT * FROM portfolio_risk_limit_evaluations WHERE ts_event IS NOT NULL) GROUP BY ALL) JOIN
  (SELECT policy_id, policy_fingerprint, count(*) AS current_evaluations, count(DISTINCT attribution_calculation_id) AS snapshots, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'critical') AS critical, CAST(CAST(make_timestamp(epoch_us(min(ts_event))) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(make_timestamp(epoch_us(max(ts_event))) AS DATE) AS VARCHAR) AS last_date FROM lat GROUP BY ALL) USING (policy_id, policy_fingerprint)""",
        LATEST,
    ),
    "alignment_diagnostics": _rows(
        f"""SELECT portfolio_id, definition_fingerprint, count(*) AS candidate_dates, count(*) FILTER (WHERE n = size) AS aligned_dates, count(*) FILTER (WHERE n < size) AS dropped_incomplete_dates, {_day(f"(min(d) FILTER (WHERE n = size)) * 86400000000")} AS first_aligned, {_day(f"(max(d) FILTER (WHERE n = size)) * 86400000000")} AS last_aligned
FROM (SELECT portfolio_id, definition_fingerprint, d, any_value(size) AS size, count(*) AS n FROM parts_ok JOIN cur USING (component) GROUP BY portfolio_id, definition_fingerprint, d) GROUP BY ALL""",
        PARTS, ALIGNED,
    ),
    "contract_common": " UNION ALL ".join(_common_sql(name) for name in contracts.COMMON),
}
