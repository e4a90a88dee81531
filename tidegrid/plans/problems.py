"""The queries of the data-pipeline problems, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import drift, gridfill, lateness, orphans, redelivery, rolling
from tidegrid.functions.text import symbol_key
from tidegrid.sources.tables import table

#: Added before rounding sums and averages to 6 digits: exact halves, which engines round differently, are none then.
OFF_HALF = 3.1415e-8


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return gridfill.missing_slots(table(spark, folder, "market_events_raw"), table(spark, folder, "symbol_grid"))


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = gridfill.regularize(table(spark, folder, "market_events_raw"), table(spark, folder, "symbol_grid"))
    return grid.select("symbol", "slot_start", "readings", "first_price", "last_price", "price", "is_missing", "filled_from")


def _rolled(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing totals of the three series, keyed by (series, entity)."""
    parts = None
    for name, value in (("returns_1m", "return_1m"), ("volatility_5m", "volatility_5m")):
        rows = table(spark, folder, name).where("ts_event is not null").select(symbol_key(F.col("symbol")).alias("entity"), "ts_event", "ts_ingest", "loaded_at", value).where("entity is not null")
        now = rolling.current_rows(rows, ["entity", "ts_event"], ["ts_ingest", "loaded_at"], value)
        daily = rolling.daily_totals(now.withColumn("day", rolling.day_number(F.col("ts_event"))), ["entity"]).withColumn("series", F.lit(name))
        parts = daily if parts is None else parts.unionByName(daily)
    rows = table(spark, folder, "portfolio_daily_returns").where("ts_event is not null and portfolio_id is not null").select(F.col("portfolio_id").alias("entity"), rolling.day_number(F.col("ts_event")).alias("day"), "ts_ingest", "calculation_id", "portfolio_return_1d")
    now = rolling.current_rows(rows, ["entity", "day"], ["ts_ingest", "calculation_id"], "portfolio_return_1d")
    daily = rolling.daily_totals(now, ["entity"]).withColumn("series", F.lit("portfolio_daily_returns"))
    return rolling.rolling_totals(parts.unionByName(daily), ["series", "entity"]).withColumn("day", rolling.day_text(F.col("day")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.quiet_spells(_rolled(spark, folder)).select("series", "entity", "day")


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["total", "total_7", "total_30", "average_7", "average_30"]
    return _rolled(spark, folder).select("series", "entity", "day", "active", *(F.round(F.col(c) + OFF_HALF, 6).alias(c) for c in cols))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.findings(table(spark, folder, "data_quality_metrics"), table(spark, folder, "market_events_raw"), table(spark, folder, "field_baseline"))


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "market_events_raw")
    figures = drift.base_profile(rows).join(drift.distinct_values(rows), ["load", "field"], "left")
    return figures.select("load", "field", "rows", "nulls", "blanks", "invalid", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), F.round("level_mean", 6).alias("level_mean"))


def p3_columns(spark: SparkSession, folder: str) -> DataFrame:
    profile = drift.column_profile(table(spark, folder, "market_events_raw"))
    return profile.select("load", "field", "rows", "nulls", "blanks", "invalid", "distinct_values", F.round("level_mean", 6).alias("level_mean"), "low_text", "high_text", "low_value", "high_value")


def p3_drift(spark: SparkSession, folder: str) -> DataFrame:
    profile = drift.profile_loads(table(spark, folder, "market_events_raw"), table(spark, folder, "field_baseline"))
    return profile.select("load", "field", "rows", "null_rate", "level_mean", "discrimination", "null_ablation", "level_ablation", "by_classifier", "untested", "by_figures")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return redelivery.surplus(table(spark, folder, "market_events_raw"))


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    """NaN is told apart from null by a column of its own, as NaN equals nothing."""
    nan = F.coalesce(F.isnan("price"), F.lit(False))
    return redelivery.keep_one(table(spark, folder, "market_events_raw")).select("delivery_id", "event_id", "symbol", F.when(~nan, F.col("price")).alias("price"), nan.alias("price_is_nan"), "volume")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    t = {n: table(spark, folder, n) for n in ("portfolio_daily_returns", "portfolio_risk_limit_evaluations", "portfolio_risk_notification_outbox", "daily_returns", "portfolio_risk_attribution")}
    refs = [
        orphans.Reference("portfolio_daily_returns", t["portfolio_daily_returns"], "calculation_id", orphans.json_object_values("component_calculation_ids_json"), "daily_returns", t["daily_returns"]),
        orphans.Reference("portfolio_risk_limit_evaluations", t["portfolio_risk_limit_evaluations"], "calculation_id", orphans.one("attribution_calculation_id"), "portfolio_risk_attribution", t["portfolio_risk_attribution"]),
        orphans.Reference("portfolio_risk_notification_outbox", t["portfolio_risk_notification_outbox"], "event_id", orphans.one("source_evaluation_calculation_id"), "portfolio_risk_limit_evaluations", t["portfolio_risk_limit_evaluations"]),
    ]
    return orphans.orphan_references(refs, table(spark, folder, "deleted_calculations"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder))


def _windows(spark: SparkSession, folder: str, window_seconds: int = lateness.HOUR) -> DataFrame:
    kept = redelivery.keep_one(table(spark, folder, "market_events_raw"))
    return lateness.compose(lateness.panes(lateness.usable(kept), window_seconds=window_seconds), window_seconds=window_seconds)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return lateness.outcomes(_windows(spark, folder))


def p6_hourly(spark: SparkSession, folder: str) -> DataFrame:
    rows = lateness.emissions(_windows(spark, folder))
    return rows.select("symbol", F.col("window_start").alias("hour_start"), "revision", "events", "volume", F.round(F.col("average_price") + OFF_HALF, 6).alias("average_price"), "low", "high", "open_price", "close_price", "corrections", "rejected")


def p6_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of three hours, one beginning each hour; arrival is judged against the end of each window."""
    return _windows(spark, folder, 3 * lateness.HOUR).select("symbol", "window_start", "events_published", "events_final", "volume_final", "low_final", "high_final", "corrections", "rejected")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_rolling, p3_found, p3_profile, p3_columns, p3_drift, p4_found, p4_kept, p5_found, p5_report, p6_found, p6_hourly, p6_sliding)}

_TRIM = "trim({0}, ' ' || chr(9))"
_SYMBOL = "nullif(upper(trim(symbol, ' ' || chr(9))), '')"

_GRID = f"""
WITH g AS (SELECT min_by(symbol, (period_seconds, open_second, close_second, symbol)) AS symbol, {_SYMBOL} AS k, min((period_seconds, open_second, close_second, symbol)) AS m FROM symbol_grid WHERE {_SYMBOL} IS NOT NULL AND period_seconds > 0 AND close_second > open_second GROUP BY {_SYMBOL}),
grid AS (SELECT symbol, k, CAST(struct_extract_at(m, 1) AS BIGINT) AS period_seconds, CAST(struct_extract_at(m, 2) AS BIGINT) AS open_second, (struct_extract_at(m, 3) - struct_extract_at(m, 2)) // struct_extract_at(m, 1) AS n FROM g),
valid AS (
  SELECT grid.k, epoch_us(ts_event) AS us, CAST(floor(epoch_us(ts_event) / 86400000000.0) AS BIGINT) AS day, price, period_seconds, open_second, n
  FROM market_events_raw JOIN grid ON grid.k = {_SYMBOL.replace('symbol', 'market_events_raw.symbol')}
  WHERE ts_event IS NOT NULL AND price > 0 AND NOT isnan(price)),
placed AS (SELECT k, us, day, price, CAST(floor((us - day * 86400000000 - open_second * 1000000) / (period_seconds * 1000000.0)) AS BIGINT) AS slot, n FROM valid),
taken AS (
  SELECT k, day, slot, count(*) AS readings, arg_min(price, (us, price)) AS first_price, arg_max(price, (us, price)) AS last_price, max(us) AS last_us
  FROM placed WHERE slot >= 0 AND slot < n GROUP BY ALL),
expected AS (
  SELECT grid.symbol, grid.k, d.day, CAST(s.slot AS BIGINT) AS slot, d.day * 86400 + open_second + s.slot * period_seconds AS slot_start
  FROM grid CROSS JOIN (SELECT DISTINCT day FROM valid) d CROSS JOIN LATERAL (SELECT unnest(range(grid.n)) AS slot) s)
"""

_ROLLED = """
WITH cur AS (
  SELECT 'returns_1m' AS series, nullif(upper(trim(symbol, ' ' || chr(9))), '') AS entity, epoch_us(ts_event) // 86400000000 AS day, arg_max(coalesce(return_1m, 'nan'::double), (coalesce(epoch_us(ts_ingest), -9223372036854775807), coalesce(epoch_us(loaded_at), -9223372036854775807), coalesce(return_1m, '-infinity'::double))) AS value FROM returns_1m WHERE ts_event IS NOT NULL GROUP BY 2, 3, ts_event
  UNION ALL
  SELECT 'volatility_5m', nullif(upper(trim(symbol, ' ' || chr(9))), ''), epoch_us(ts_event) // 86400000000 AS day, arg_max(coalesce(volatility_5m, 'nan'::double), (coalesce(epoch_us(ts_ingest), -9223372036854775807), coalesce(epoch_us(loaded_at), -9223372036854775807), coalesce(volatility_5m, '-infinity'::double))) FROM volatility_5m WHERE ts_event IS NOT NULL GROUP BY 2, 3, ts_event
  UNION ALL
  SELECT 'portfolio_daily_returns', portfolio_id, epoch_us(ts_event) // 86400000000 AS day, arg_max(coalesce(portfolio_return_1d, 'nan'::double), (coalesce(epoch_us(ts_ingest), -9223372036854775807), coalesce(calculation_id, ''), coalesce(portfolio_return_1d, '-infinity'::double))) FROM portfolio_daily_returns WHERE ts_event IS NOT NULL AND portfolio_id IS NOT NULL GROUP BY 2, 3),
daily AS (SELECT series, entity, day, sum(value) AS total, count(*) AS active FROM cur WHERE entity IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
cal AS (SELECT series, entity, unnest(range(min(day), max(day) + 1)) AS day FROM daily GROUP BY series, entity),
days AS (SELECT series, entity, day, coalesce(total, 0.0) AS total, coalesce(active, 0) AS active FROM cal LEFT JOIN daily USING (series, entity, day)),
rolled AS (
  SELECT *, sum(total) OVER (PARTITION BY series, entity ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS total_7, sum(total) OVER (PARTITION BY series, entity ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS total_30 FROM days)
"""

_SURPLUS = """
WITH keyed AS (SELECT nullif(lower(trim(event_id, ' ' || chr(9))), '') AS event_id, delivery_id, coalesce(epoch_us(ts_ingest), 9223372036854775807) AS us FROM market_events_raw),
surplus AS (SELECT event_id, delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY us, delivery_id) AS rn FROM keyed WHERE event_id IS NOT NULL) WHERE rn > 1)
"""

_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT batch_id AS load, '{f}' AS field, count(*) AS n, count(*) FILTER (WHERE {f} IS NULL) AS nulls, "
    + (f"count(*) FILTER (WHERE {_TRIM.format(f)} = '') AS blanks, " if f in drift.TEXT_FIELDS else "CAST(0 AS BIGINT) AS blanks, ")
    + {"price": "count(*) FILTER (WHERE price IS NOT NULL AND (isnan(price) OR NOT price > 0))", "volume": "count(*) FILTER (WHERE volume < 0)"}.get(f, "CAST(0 AS BIGINT)")
    + " AS invalid, "
    + (f"count(DISTINCT {_TRIM.format(f)})" if f in drift.TEXT_FIELDS else f"count(DISTINCT {f})")
    + " AS distinct_values, "
    + (f"avg(CASE WHEN {f} > 0 AND NOT isnan(CAST({f} AS DOUBLE)) THEN log10(CAST({f} AS DOUBLE)) END)" if f in drift.LEVEL_FIELDS else "CAST(NULL AS DOUBLE)")
    + " AS level_mean FROM market_events_raw GROUP BY batch_id"
    for f in drift.FIELDS
)


def _said(column: str, fields: tuple[str, ...], finding: str) -> str:
    names = ", ".join(f"'{f}'" for f in fields)
    return f"""
SELECT metric_id, batch_id AS load, field, '{finding}' AS finding,
  coalesce((SELECT max(TRY_CAST(json_extract_string({column}, '$."' || k || '"') AS DOUBLE)) FROM (SELECT unnest(json_keys({column})) AS k) WHERE lower(trim(k)) = field), 0) AS value
FROM (SELECT *, unnest([{names}]) AS field FROM data_quality_metrics WHERE CASE WHEN json_valid({column}) THEN json_type({column}) = 'OBJECT' ELSE FALSE END)"""


_ORPHANS = """
WITH refs AS (
  SELECT 'portfolio_daily_returns' AS table_name, 'daily_returns' AS target, calculation_id AS record_id, ts_event, ts_ingest, unnest([json_extract_string(component_calculation_ids_json, '$."' || k || '"') FOR k IN json_keys(component_calculation_ids_json)]) AS raw
  FROM portfolio_daily_returns WHERE CASE WHEN json_valid(component_calculation_ids_json) THEN json_type(component_calculation_ids_json) = 'OBJECT' ELSE FALSE END
  UNION ALL SELECT 'portfolio_risk_limit_evaluations', 'portfolio_risk_attribution', calculation_id, ts_event, ts_ingest, attribution_calculation_id FROM portfolio_risk_limit_evaluations
  UNION ALL SELECT 'portfolio_risk_notification_outbox', 'portfolio_risk_limit_evaluations', event_id, ts_event, ts_ingest, source_evaluation_calculation_id FROM portfolio_risk_notification_outbox),
cases AS (SELECT DISTINCT table_name, target, strftime(make_timestamp(epoch_us(ts_event)), '%Y-%m') AS period, record_id, ts_ingest, nullif(lower(trim(raw, ' ' || chr(9))), '') AS missing_id FROM refs),
parents AS (
  SELECT target, lower(trim(id, ' ' || chr(9))) AS id, min(ts_ingest) AS first_seen, count(*) FILTER (WHERE ts_ingest IS NULL) AS undated FROM (
    SELECT 'daily_returns' AS target, calculation_id AS id, ts_ingest FROM daily_returns
    UNION ALL SELECT 'portfolio_risk_attribution', calculation_id, ts_ingest FROM portfolio_risk_attribution
    UNION ALL SELECT 'portfolio_risk_limit_evaluations', calculation_id, ts_ingest FROM portfolio_risk_limit_evaluations) GROUP BY 1, 2),
gone AS (SELECT lower(trim(table_name)) AS target, lower(trim(calculation_id, ' ' || chr(9))) AS id, min(deleted_at) AS deleted_at FROM deleted_calculations GROUP BY 1, 2),
judged AS (
  SELECT table_name, period, record_id, missing_id,
    CASE WHEN gone.deleted_at <= cases.ts_ingest THEN 'deleted' WHEN parents.id IS NULL THEN 'missing' WHEN parents.undated = 0 AND parents.first_seen > cases.ts_ingest THEN 'late' END AS state
  FROM cases LEFT JOIN parents ON parents.target = cases.target AND parents.id = cases.missing_id LEFT JOIN gone ON gone.target = cases.target AND gone.id = cases.missing_id
  WHERE missing_id IS NOT NULL),
found AS (SELECT DISTINCT * FROM judged WHERE state IS NOT NULL)
"""

_HOURS = (
    _SURPLUS
    + f""", taken AS (
  SELECT {_SYMBOL} AS symbol, epoch_us(ts_event) AS e, epoch_us(ts_ingest) AS i, CAST(floor(epoch_us(ts_event) / 3600000000.0) AS BIGINT) * 3600 AS h, price, volume, delivery_id
  FROM market_events_raw WHERE delivery_id NOT IN (SELECT delivery_id FROM surplus) AND ts_event IS NOT NULL AND ts_ingest IS NOT NULL AND price > 0 AND NOT isnan(price)),
classed AS (SELECT *, CASE WHEN i <= (h + 3900) * 1000000 THEN 0 WHEN i <= (h + 90000) * 1000000 THEN 1 ELSE 2 END AS c FROM taken WHERE symbol IS NOT NULL)
"""
)

ORACLES = {
    "p1_found": _GRID + "SELECT symbol, slot_start FROM expected ANTI JOIN taken USING (k, day, slot)",
    "p1_grid": _GRID
    + """, series AS (SELECT *, last_value(last_price IGNORE NULLS) OVER w AS price, last_value(last_us IGNORE NULLS) OVER w AS filled_from FROM expected LEFT JOIN taken USING (k, day, slot) WINDOW w AS (PARTITION BY k ORDER BY slot_start ROWS UNBOUNDED PRECEDING))
SELECT symbol, slot_start, coalesce(readings, 0) AS readings, first_price, last_price, price, readings IS NULL AS is_missing, filled_from FROM series""",
    "p2_found": _ROLLED + "SELECT series, entity, strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS day FROM rolled WHERE active = 0 AND total_30 > 0.000001 AND total_7 / 7 < 0.5 * total_30 / 30",
    "p2_rolling": _ROLLED
    + f"SELECT series, entity, strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS day, active, round(total + {OFF_HALF}, 6) AS total, round(total_7 + {OFF_HALF}, 6) AS total_7, round(total_30 + {OFF_HALF}, 6) AS total_30, round(total_7 / 7 + {OFF_HALF}, 6) AS average_7, round(total_30 / 30 + {OFF_HALF}, 6) AS average_30 FROM rolled",
    "p3_found": f"""
WITH p AS ({_FIELD_ROWS}),
said AS ({_said("null_rates_by_name", drift.FIELDS, "null_rate_wrong")} UNION ALL {_said("missing_required_fields_by_name", drift.FIELDS, "missing_wrong")} UNION ALL {_said("invalid_values_by_name", drift.LEVEL_FIELDS, "invalid_wrong")})
SELECT DISTINCT metric_id, field, finding FROM said JOIN p USING (load, field)
WHERE CASE finding WHEN 'null_rate_wrong' THEN abs(value - nulls / n) > 0.0005 WHEN 'missing_wrong' THEN value <> blanks ELSE value <> invalid END
UNION ALL
SELECT m.metric_id, field, 'null_rate_shift' FROM (SELECT DISTINCT metric_id, batch_id AS load FROM data_quality_metrics) m JOIN p USING (load) JOIN field_baseline b USING (field) WHERE nulls >= 5 AND nulls / n > 3 * usual_null_rate
UNION ALL
SELECT m.metric_id, field, 'level_shift' FROM (SELECT DISTINCT metric_id, batch_id AS load FROM data_quality_metrics) m JOIN p USING (load) JOIN field_baseline b USING (field) WHERE abs(level_mean - usual_log10_mean) > 0.3""",
    "p3_profile": f"SELECT load, field, n AS rows, nulls, blanks, invalid, distinct_values, round(level_mean, 6) AS level_mean FROM ({_FIELD_ROWS})",
    "p4_found": _SURPLUS + "SELECT event_id, delivery_id FROM surplus",
    "p4_kept": _SURPLUS + "SELECT delivery_id, event_id, symbol, CASE WHEN NOT isnan(price) THEN price END AS price, coalesce(isnan(price), FALSE) AS price_is_nan, volume FROM market_events_raw WHERE delivery_id NOT IN (SELECT delivery_id FROM surplus)",
    "p5_found": _ORPHANS + "SELECT table_name, period, record_id, missing_id, state FROM found",
    "p5_report": _ORPHANS + "SELECT table_name, period, state, count(*) AS orphan_references, count(DISTINCT record_id) AS records FROM found GROUP BY ALL",
    "p6_found": _HOURS + "SELECT DISTINCT symbol, h AS hour_start, CASE c WHEN 1 THEN 'corrected' ELSE 'rejected' END AS outcome FROM classed WHERE c > 0",
    "p6_hourly": _HOURS
    + f""", base AS (SELECT symbol, h, count(*) FILTER (WHERE c = 1) AS corrections, count(*) FILTER (WHERE c = 2) AS rejected FROM classed GROUP BY ALL),
rev AS (SELECT symbol, h, 0 AS revision, * EXCLUDE (symbol, h) FROM classed WHERE c = 0 UNION ALL SELECT c.symbol, c.h, 1, c.* EXCLUDE (symbol, h) FROM classed c JOIN base USING (symbol, h) WHERE c.c < 2 AND corrections > 0),
agg AS (SELECT symbol, h, revision, count(*) AS events, CAST(sum(volume) AS BIGINT) AS volume, round(sum(price) / count(*) + {OFF_HALF}, 6) AS average_price, min(price) AS low, max(price) AS high, arg_min(price, (e, delivery_id)) AS open_price, arg_max(price, (e, delivery_id)) AS close_price FROM rev GROUP BY ALL)
SELECT symbol, h AS hour_start, revision, events, volume, average_price, low, high, open_price, close_price, corrections, rejected FROM agg JOIN base USING (symbol, h)""",
}

ORACLES["p6_sliding"] = (
    _HOURS
    + """, spread AS (SELECT symbol, h - k * 3600 AS window_start, i, price, volume FROM (SELECT *, unnest([0, 1, 2]) AS k FROM classed)),
judged AS (SELECT *, CASE WHEN i <= (window_start + 3 * 3600 + 300) * 1000000 THEN 0 WHEN i <= (window_start + 3 * 3600 + 86400) * 1000000 THEN 1 ELSE 2 END AS w FROM spread)
SELECT symbol, window_start, count(*) FILTER (WHERE w = 0) AS events_published, count(*) FILTER (WHERE w < 2) AS events_final, CAST(sum(volume) FILTER (WHERE w < 2) AS BIGINT) AS volume_final, min(price) FILTER (WHERE w < 2) AS low_final, max(price) FILTER (WHERE w < 2) AS high_final, count(*) FILTER (WHERE w = 1) AS corrections, count(*) FILTER (WHERE w = 2) AS rejected
FROM judged GROUP BY symbol, window_start"""
)


def _column_figures(f: str) -> str:
    text, level = f in drift.COLUMN_TEXTS, f in drift.LEVEL_FIELDS
    number = f"epoch_us({f})" if f in drift.COLUMN_TIMES else f
    kept = " FILTER (WHERE NOT isnan(price))" if f == "price" else ""
    return f"""
SELECT batch_id AS load, '{f}' AS field, count(*) AS rows, count(*) FILTER (WHERE {f} IS NULL) AS nulls,
  {f"count(*) FILTER (WHERE {_TRIM.format(f)} = '')" if text else "CAST(0 AS BIGINT)"} AS blanks,
  {"count(*) FILTER (WHERE isnan(price) OR price <= 0)" if f == "price" else "count(*) FILTER (WHERE volume < 0)" if f == "volume" else "CAST(0 AS BIGINT)"} AS invalid,
  count(DISTINCT {_TRIM.format(f) if text else f}) AS distinct_values,
  {f"round(avg(CASE WHEN {f} > 0 AND NOT isnan(CAST({f} AS DOUBLE)) THEN log10(CAST({f} AS DOUBLE)) END), 6)" if level else "CAST(NULL AS DOUBLE)"} AS level_mean,
  {f"min({f})" if text else "CAST(NULL AS VARCHAR)"} AS low_text, {f"max({f})" if text else "CAST(NULL AS VARCHAR)"} AS high_text,
  {"CAST(NULL AS DOUBLE)" if text else f"CAST((min({number}){kept}) AS DOUBLE)"} AS low_value, {"CAST(NULL AS DOUBLE)" if text else f"CAST((max({number}){kept}) AS DOUBLE)"} AS high_value
FROM market_events_raw GROUP BY batch_id"""


ORACLES["p3_columns"] = " UNION ALL ".join(_column_figures(f) for f in drift.COLUMNS)
