"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

_T = "trim({0}, ' ' || chr(9))"


def _id(c: str) -> str:
    return f"nullif(lower({_T.format(c)}), '')"


def _sym(c: str) -> str:
    return f"nullif(upper({_T.format(c)}), '')"


def _day(us: str) -> str:
    return f"CAST(CAST(make_timestamp({us}) AS DATE) AS VARCHAR)"


def _rows(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query


EV = f"""ev AS (
  SELECT *, i - e > 300000000 AS is_late, e // 300000000 * 300 AS bar FROM (
    SELECT delivery_id, {_id('event_id')} AS event_id, {_sym('symbol')} AS symbol, price, volume, epoch_us(ts_event) AS e, epoch_us(ts_ingest) AS i, {_id('source')} AS source FROM market_events_raw)
  WHERE event_id IS NOT NULL AND symbol IS NOT NULL AND source IS NOT NULL AND e IS NOT NULL AND i IS NOT NULL AND volume >= 0 AND price > 0 AND NOT isnan(price) AND NOT isinf(price))"""
DD = "dd AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) = 1)"
MOVES = """lagged AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY e, event_id) - 1 AS r FROM dd),
moves AS (
  SELECT symbol, event_id, e, i, bar, r, CASE WHEN count(r) OVER w = 5 THEN stddev_samp(r) OVER w END AS v FROM lagged
  WINDOW w AS (PARTITION BY symbol ORDER BY e, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
mv AS (SELECT * FROM moves WHERE r IS NOT NULL)"""
SUMMARY = "summary AS (SELECT symbol, count(*) AS observations, quantile_cont(r, 0.05) AS value_at_risk, arg_max(coalesce(v, 'nan'::double), (e, event_id)) AS v, max(i) AS ingest_us FROM mv GROUP BY symbol)"
CLOSES = "closes AS (SELECT source, symbol, e // 86400000000 AS d, arg_max(price, (e, event_id)) AS price, arg_max(event_id, (e, event_id)) AS event_id FROM dd GROUP BY ALL)"
DAILY = """dr AS (SELECT *, price / lag(price) OVER k - 1 AS r, lag(event_id) OVER k AS previous, row_number() OVER k AS n FROM closes WINDOW k AS (PARTITION BY source, symbol ORDER BY d)),
dw AS (
  SELECT *, count(r) OVER v AS nv, stddev_samp(r) OVER v * sqrt(252) AS vol, count(r) OVER q AS nq, quantile_cont(r, 0.05) OVER q AS quant, price / max(price) OVER u - 1 AS draw,
    first_value(event_id) OVER u AS first_event_id, list(event_id) OVER x AS ids
  FROM dr WINDOW v AS (PARTITION BY source, symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), q AS (PARTITION BY source, symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    u AS (PARTITION BY source, symbol ORDER BY d ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY source, symbol ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
daily AS (
  SELECT *, min(draw) OVER (PARTITION BY source, symbol ORDER BY d ROWS UNBOUNDED PRECEDING) AS worst FROM dw)"""
SIX = "round({0}, 6) AS {1}"

PARTS = """pd AS (
  SELECT portfolio_id, definition_fingerprint, max(weights_json) AS w FROM portfolio_daily_returns
  WHERE portfolio_id IS NOT NULL AND CASE WHEN json_valid(weights_json) THEN json_type(weights_json) = 'OBJECT' ELSE FALSE END GROUP BY ALL),
parts AS (
  SELECT portfolio_id, definition_fingerprint, k AS component, CAST(json_extract_string(w, '$."' || k || '"') AS DOUBLE) AS weight, len(json_keys(w)) AS size FROM (SELECT *, unnest(json_keys(w)) AS k FROM pd)),
parts_ok AS (SELECT * FROM parts WHERE (portfolio_id, definition_fingerprint) IN (SELECT (portfolio_id, definition_fingerprint) FROM parts GROUP BY portfolio_id, definition_fingerprint HAVING abs(sum(weight) - 1) <= 0.00001 AND min(weight) > 0))"""
ALIGNED = f"""cur AS (
  SELECT {_id('source')} || ':' || {_sym('symbol')} AS component, epoch_us(ts_event) // 86400000000 AS d, return_1d, calculation_id, ts_ingest FROM daily_returns WHERE return_1d > -1 AND NOT isnan(return_1d) AND ts_event IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY component, d ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1),
al AS (SELECT portfolio_id, definition_fingerprint, d, size, component, weight, return_1d, calculation_id FROM parts_ok JOIN cur USING (component) QUALIFY count(*) OVER (PARTITION BY portfolio_id, definition_fingerprint, d) = size),
pr AS (SELECT portfolio_id, definition_fingerprint, d, any_value(size) AS size, sum(weight * return_1d) AS r FROM al GROUP BY ALL)"""
MATRIX = """px AS (SELECT a.portfolio_id, a.definition_fingerprint, a.d, a.component AS row_key, b.component AS column_key, a.weight AS wa, b.weight AS wb, a.return_1d AS x, b.return_1d AS y FROM al a JOIN al b USING (portfolio_id, definition_fingerprint, d)),
pw AS (
  SELECT *, covar_samp(x, y) OVER w * 252 AS cov, count(*) OVER w AS n, min(d) OVER w AS d0, stddev_samp(x) OVER w AS sx, stddev_samp(y) OVER w AS sy FROM px
  WINDOW w AS (PARTITION BY portfolio_id, definition_fingerprint, row_key, column_key ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
mx AS (SELECT *, CASE WHEN sx * sy > 0 THEN greatest(-1.0, least(1.0, cov / 252 / (sx * sy))) END AS corr FROM pw WHERE n = 10)"""
EULER = """em AS (SELECT portfolio_id, definition_fingerprint, d, row_key AS component, wa AS weight, sum(cov * wb) AS m FROM mx GROUP BY ALL),
eu AS (SELECT *, sqrt(greatest(0.0, sum(weight * m) OVER (PARTITION BY portfolio_id, definition_fingerprint, d))) AS vol FROM em),
es AS (SELECT *, vol > 1e-12 AS positive, CASE WHEN vol > 1e-12 THEN weight * m / vol ELSE 0.0 END AS contribution, CASE WHEN vol > 1e-12 THEN weight * m / vol / vol ELSE 0.0 END AS share FROM eu)"""
RETURN_IDS = """pri AS (
  SELECT portfolio_id, definition_fingerprint, d, 'portfolio-risk-v1-return-' || substr(sha256('{"component_calculation_ids":["' || string_agg(calculation_id, '","' ORDER BY component) || '"],"definition_fingerprint":"' || definition_fingerprint || '","metric":"return","model_version":"portfolio-risk-v1","parameters":{"weighting_method":"constant_weight_daily_rebalanced"}}'), 1, 24) AS id
  FROM al GROUP BY portfolio_id, definition_fingerprint, d)"""
EVALUATED = """ev2 AS (
  SELECT portfolio_id, definition_fingerprint, d, 'portfolio_volatility_annualized' AS metric_name, portfolio_id AS subject_key, any_value(vol) AS observed, 0.25 AS warn, 0.40 AS crit FROM es GROUP BY ALL
  UNION ALL
  SELECT portfolio_id, definition_fingerprint, d, 'largest_absolute_component_contribution_share', component, abs(share), 0.65, 0.80 FROM (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY portfolio_id, definition_fingerprint, d ORDER BY abs(share) DESC, component) = 1))"""

_SERIES = "policy_id, policy_fingerprint, portfolio_id, definition_fingerprint, model_version, attribution_model_version, weighting_method, covariance_method, correlation_method, covariance_window, annualization_days, metric_name"
LATEST = f"""lat AS (
  SELECT * FROM (SELECT DISTINCT * FROM portfolio_risk_limit_evaluations WHERE ts_event IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY {_SERIES}, ts_event ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1)"""
TRANSITIONS = f"""tl AS (
  SELECT *, lag(status) OVER w AS previous_status, lag(calculation_id) OVER w AS previous_calculation_id, lag(subject_key) OVER w AS previous_subject_key FROM lat
  WINDOW w AS (PARTITION BY {_SERIES} ORDER BY ts_event, ts_ingest NULLS FIRST, calculation_id)),
tr AS (
  SELECT *, CASE
      WHEN status IN ('warning', 'critical') AND coalesce(previous_status, 'ok') = 'ok' THEN 'opened'
      WHEN previous_status IS NULL AND status = 'ok' THEN 'initial_ok'
      WHEN previous_status || '>' || status = 'warning>critical' THEN 'escalated'
      WHEN previous_status || '>' || status = 'critical>warning' THEN 'deescalated'
      WHEN previous_status IN ('warning', 'critical') AND status = 'ok' THEN 'resolved'
      ELSE 'unchanged' END AS transition_type,
    CAST(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS INTEGER) AS severity_rank, coalesce(previous_subject_key <> subject_key, FALSE) AS subject_changed FROM tl)"""
EPISODES = f"""num AS (SELECT *, CAST(sum(CASE WHEN transition_type = 'opened' THEN 1 ELSE 0 END) OVER (PARTITION BY {_SERIES} ORDER BY ts_event, ts_ingest NULLS FIRST, calculation_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_sequence FROM tr),
ep AS (
  SELECT {_SERIES}, episode_sequence, min(epoch_us(ts_event)) FILTER (WHERE is_breach) AS start_us, max(epoch_us(ts_event)) FILTER (WHERE is_breach) AS last_us,
    count(*) FILTER (WHERE is_breach) AS breach_observations, count(*) FILTER (WHERE is_breach AND status = 'warning') AS warning_observations, count(*) FILTER (WHERE is_breach AND status = 'critical') AS critical_observations, count(*) FILTER (WHERE is_breach AND subject_changed) AS subject_changes,
    arg_min(calculation_id, (ts_event, ts_ingest, calculation_id)) FILTER (WHERE is_breach) AS opening_id, arg_max(calculation_id, (ts_event, ts_ingest, calculation_id)) FILTER (WHERE is_breach) AS latest_id,
    arg_min(calculation_id, (-severity_rank, -breach_excess, -observed_value, ts_event, ts_ingest, calculation_id)) FILTER (WHERE is_breach) AS peak_id, arg_min(observed_value, (-severity_rank, -breach_excess, -observed_value, ts_event, ts_ingest, calculation_id)) FILTER (WHERE is_breach) AS peak_value,
    arg_min(calculation_id, (ts_event, ts_ingest, calculation_id)) FILTER (WHERE status = 'ok') AS resolution_id
  FROM num WHERE episode_sequence > 0 GROUP BY ALL)"""
OUTBOX = "ob AS (SELECT DISTINCT * FROM portfolio_risk_notification_outbox)"
CURRENT = "cob AS (SELECT * FROM ob WHERE EXISTS (SELECT 1 FROM tr WHERE transition_type IN ('opened', 'escalated', 'deescalated', 'resolved') AND tr.calculation_id = ob.source_evaluation_calculation_id AND tr.previous_calculation_id IS NOT DISTINCT FROM ob.source_previous_evaluation_calculation_id AND tr.transition_type = ob.transition_type AND tr.metric_name = ob.metric_name))"
SPLIT = """base AS (SELECT calculation_id, min(epoch_us(ts_ingest)) AS i, min(return_1d) AS r FROM daily_returns WHERE ts_ingest IS NOT NULL GROUP BY 1),
parted AS (SELECT *, ascii(right(calculation_id, 1)) % 3 AS p FROM base)"""
DEFS = "defs AS (SELECT *, lead(from_us) OVER (PARTITION BY portfolio_id ORDER BY from_us) AS to_us FROM (SELECT portfolio_id, definition_fingerprint, min(epoch_us(ts_event)) AS from_us FROM portfolio_daily_returns WHERE portfolio_id IS NOT NULL AND ts_event IS NOT NULL AND definition_fingerprint IS NOT NULL GROUP BY ALL))"
_FIELDS = ("event_id", "symbol", "price", "volume", "ts_event", "ts_ingest", "source")


def _json_counts(column: str, table: str, names: tuple[str, ...]) -> str:
    text = f"(CASE WHEN json_valid({column}) AND json_type(CASE WHEN json_valid({column}) THEN {column} END) = 'OBJECT' THEN {column} END)"
    aggs = ["count(*) AS rows"]
    for tag, n in zip("ab", names):
        has = f"list_contains(json_keys({text}), '{n}')"
        aggs += [f"count(*) FILTER (WHERE NOT coalesce({has}, FALSE)) AS missing_{tag}", f"count(*) FILTER (WHERE coalesce({has} AND json_extract_string({text}, '$.\"{n}\"') IS NULL, FALSE)) AS null_{tag}"]
    return f"SELECT {', '.join(aggs)} FROM {table}"


def _check(name: str, actual: str, expected: str = "0") -> str:
    return f"SELECT '{name}' AS check_name, CAST(({expected}) AS BIGINT) AS expected, CAST(({actual}) AS BIGINT) AS actual"


def _suite(*parts: str) -> str:
    return "SELECT *, CASE WHEN expected = actual THEN 'pass' ELSE 'fail' END AS status FROM (" + " UNION ALL ".join(parts) + ")"


def _surplus(table: str, key: str = "calculation_id") -> str:
    return f"SELECT count(*) - count(DISTINCT {key}) FROM {table}"


_OBJ = "CASE WHEN json_valid({0}) THEN json_type({0}) = 'OBJECT' ELSE FALSE END"
_NUM = "[CAST(json_extract_string({0}, '$.\"' || k || '\"') AS DOUBLE) FOR k IN json_keys({0})]"
PMAPS = f"""pm AS (
  SELECT calculation_id, constituent_count, portfolio_return_1d,
    CASE WHEN {_OBJ.format('weights_json')} THEN weights_json END AS w, CASE WHEN {_OBJ.format('component_returns_json')} THEN component_returns_json END AS r, CASE WHEN {_OBJ.format('contributions_json')} THEN contributions_json END AS c
  FROM portfolio_daily_returns),
pe AS (SELECT calculation_id, k, CAST(json_extract_string(w, '$."' || k || '"') AS DOUBLE) AS wv, CAST(json_extract_string(r, '$."' || k || '"') AS DOUBLE) AS rv, CAST(json_extract_string(c, '$."' || k || '"') AS DOUBLE) AS cv FROM (SELECT *, unnest(json_keys(c)) AS k FROM pm WHERE w IS NOT NULL AND r IS NOT NULL AND c IS NOT NULL))"""
ATTRIBUTED = "la AS (SELECT * FROM (SELECT DISTINCT * FROM portfolio_risk_attribution) QUALIFY row_number() OVER (PARTITION BY portfolio_id, definition_fingerprint, model_version, weighting_method, covariance_method, correlation_method, covariance_window, annualization_days, ts_event ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1)"
DAYS = f"dn AS (SELECT *, {_id('source')} AS s, {_sym('symbol')} AS y FROM daily_returns WHERE ts_event IS NOT NULL),\ndl AS (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY s, y, ts_event ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1)"



def _map_sum(column: str) -> str:
    return f"list_sum({_NUM.format(column)})"


def _object(column: str) -> str:
    return f"(CASE WHEN {_OBJ.format(column)} THEN {column} END)"


_W, _R, _C, _S = (_object(c) for c in ("weights_json", "component_returns_json", "contributions_json", "component_contribution_share_json"))
_MIDNIGHT = "epoch_us(ts_event) % 86400000000 = 0"
CONTRACTS = {
    "market_events_raw": {
        "event_id_present": "length(trim(event_id)) > 0",
        "symbol_is_upper": "symbol = upper(trim(symbol))",
        "price_positive": "price IS NOT NULL AND NOT isnan(price) AND price > 0",
        "volume_not_negative": "volume >= 0",
        "not_ingested_before_event": "ts_ingest >= ts_event",
    },
    "daily_returns": {
        "id_has_form": "regexp_full_match(calculation_id, 'daily-risk-v2-return-[0-9a-f]{24}')",
        "return_above_minus_one": "return_1d IS NOT NULL AND NOT isnan(return_1d) AND return_1d > -1",
        "event_at_midnight": _MIDNIGHT,
        "inputs_differ": "source_event_id <> previous_source_event_id",
    },
    "portfolio_daily_returns": {
        "id_has_form": "regexp_full_match(calculation_id, 'portfolio-risk-v1-return-[0-9a-f]{24}')",
        "evidence_readable": f"{_W} IS NOT NULL AND {_R} IS NOT NULL AND {_C} IS NOT NULL",
        "two_to_fifty_constituents": "constituent_count BETWEEN 2 AND 50",
        "constituents_counted": f"len(json_keys({_W})) = constituent_count",
        "same_keys": f"list_sort(json_keys({_W})) = list_sort(json_keys({_R})) AND list_sort(json_keys({_W})) = list_sort(json_keys({_C}))",
        "weights_add_to_one": f"abs({_map_sum(_W)} - 1) <= 0.00001",
        "contributions_add_up": f"abs({_map_sum(_C)} - portfolio_return_1d) <= 0.000001",
        "event_at_midnight": _MIDNIGHT,
    },
    "portfolio_risk_attribution": {
        "window_at_least_two": "covariance_window >= 2",
        "window_full": "window_observations = covariance_window",
        "window_ordered": "window_start < window_end",
        "window_ends_at_event": "window_end = ts_event",
        "volatility_not_negative": "portfolio_volatility_annualized >= 0",
        "status_matches": "CASE WHEN volatility_status = 'zero' THEN portfolio_volatility_annualized <= 1e-12 ELSE portfolio_volatility_annualized > 1e-12 END",
        "two_shares_or_more": f"len(json_keys({_S})) >= 2",
        "shares_add_to_one": f"portfolio_volatility_annualized <= 1e-12 OR abs({_map_sum(_S)} - 1) <= 0.00001",
    },
    "portfolio_risk_limit_evaluations": {
        "status_known": "status IN ('ok', 'warning', 'critical')",
        "thresholds_ordered": "warning_threshold >= 0 AND warning_threshold < critical_threshold",
        "observed_not_negative": "observed_value >= 0",
        "observed_is_magnitude": "abs(observed_value - abs(observed_signed_value)) <= 1e-9",
        "breach_is_not_ok": "is_breach = (status <> 'ok')",
        "threshold_only_in_breach": "is_breach = (breach_threshold IS NOT NULL)",
        "excess_matches": "abs(breach_excess - CASE WHEN is_breach THEN observed_value - breach_threshold ELSE 0.0 END) <= 0.000001",
    },
    "portfolio_risk_notification_outbox": {
        "disposition_known": "delivery_disposition IN ('pending', 'suppressed')",
        "transition_is_actionable": "transition_type IN ('opened', 'escalated', 'deescalated', 'resolved')",
        "type_names_transition": "event_type = 'breach_' || transition_type",
        "only_deescalations_suppressed": "(delivery_disposition = 'pending') = (transition_type <> 'deescalated')",
        "reason_only_if_suppressed": "(delivery_disposition = 'pending') = (suppression_reason IS NULL)",
        "severity_matches": "severity_rank = CASE current_status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END",
        "payload_readable": f"{_object('payload_json')} IS NOT NULL",
    },
}

ORACLES = {
    "market_events_normalised": _rows("SELECT delivery_id, event_id, symbol, price, volume, source, is_late, e AS event_us, bar AS window_start FROM ev", EV),
    "dedupe_first_seen": _rows("SELECT event_id, delivery_id, symbol, price FROM dd", EV, DD),
    "raw_dedupe_earliest_ingest": _rows("SELECT event_id, delivery_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY i, delivery_id) = 1", EV),
    "raw_conflicts": _rows("SELECT event_id, count(*) AS copies FROM ev GROUP BY 1 HAVING count(DISTINCT (symbol, price, volume, e, source)) > 1", EV),
    "dq_json_fields": _json_counts("component_calculation_ids_json", "portfolio_daily_returns", ("feed_north:QELAW", "feed_north:VEXEX")),
    "dq_null_metrics": " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS rows, count(*) FILTER (WHERE {f} IS NULL) AS nulls, round(count(*) FILTER (WHERE {f} IS NULL) / count(*), 6) AS null_rate FROM market_events_raw" for f in _FIELDS),
    "dq_range_metrics": "SELECT 'price' AS field, count(price) AS checked, count(*) FILTER (WHERE isnan(price) OR price <= 0) AS invalid FROM market_events_raw UNION ALL SELECT 'volume', count(volume), count(*) FILTER (WHERE volume < 0 OR volume > 1000000000) FROM market_events_raw",
    "dq_batch_rates": _rows(
        "SELECT total_events, deduped_events, total_events - deduped_events AS duplicate_events, late_events, round(late_events / deduped_events, 6) AS late_rate, round((total_events - deduped_events) / total_events, 6) AS duplicate_rate, CASE WHEN late_events / deduped_events > 0.02 THEN 'critical' ELSE 'ok' END AS late_status, CASE WHEN (total_events - deduped_events) / total_events > 0.01 THEN 'critical' ELSE 'ok' END AS duplicate_status FROM (SELECT (SELECT count(*) FROM ev) AS total_events, count(*) AS deduped_events, count(*) FILTER (WHERE is_late) AS late_events FROM dd)",
        EV, DD,
    ),
    "dq_incidents": "SELECT DISTINCT metric_id, batch_id, late_status, duplicate_status FROM data_quality_metrics WHERE required_fields_status <> 'ok' OR null_rate_status <> 'ok' OR value_validity_status <> 'ok' OR late_status <> 'ok' OR duplicate_status <> 'ok'",
    "constraint_violations": " UNION ALL ".join(
        f"SELECT '{name}' AS constraint_name, count(*) AS checked, count(*) FILTER (WHERE NOT ({c})) AS violations FROM portfolio_risk_limit_evaluations"
        for name, c in {"thresholds_ordered": "warning_threshold <= critical_threshold", "observed_not_negative": "observed_value >= 0", "excess_only_in_breach": "is_breach OR breach_excess = 0", "currency_has_three_letters": "length(base_currency) = 3", "portfolio_id_is_slug": "regexp_matches(portfolio_id, '^[a-z0-9-]+$')"}.items()
    ),
    "late_rate_by_symbol": _rows("SELECT symbol, count(*) AS events, count(*) FILTER (WHERE is_late) AS late_events, round(count(*) FILTER (WHERE is_late) / count(*), 6) AS late_rate FROM dd GROUP BY 1", EV, DD),
    "minute_returns": _rows("SELECT symbol, event_id, e AS event_us, bar AS window_start, round(r, 6) AS return_1m, round(v, 6) AS volatility_5m FROM mv", EV, DD, MOVES),
    "var_by_symbol": _rows("SELECT symbol, observations, round(value_at_risk, 6) AS value_at_risk FROM summary", EV, DD, MOVES, SUMMARY),
    "risk_summary": _rows(
        "SELECT symbol, observations, round(value_at_risk, 6) AS value_at_risk, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) END AS volatility_5m, CASE WHEN isnan(v) THEN 'no_data' WHEN v >= 0.07 THEN 'critical' WHEN v >= 0.03 THEN 'warn' ELSE 'ok' END AS volatility_status, ingest_us FROM summary",
        EV, DD, MOVES, SUMMARY,
    ),
    "signal_latest": "SELECT upper(replace(trim(event_type), '-', '_')) AS name, 'u' || user_id % 7 AS source, arg_max(event_id, k) AS signal_id, arg_max(value, k) AS value FROM (SELECT *, (ts, ts + to_seconds(CAST(json_extract_string(props, '$.k') AS INTEGER) * 5), event_id) AS k FROM events) GROUP BY 1, 2",
    "daily_close": _rows(f"SELECT source, symbol, {_day('d * 86400000000')} AS day, price, event_id FROM closes", EV, DD, CLOSES),
    "daily_risk_summary": _rows(
        f"SELECT source, symbol, {_day('d * 86400000000')} AS day, round(r, 6) AS return_1d, CASE WHEN nv = 5 THEN round(vol, 6) END AS volatility_annualized, CASE WHEN nq >= 2 THEN round(greatest(0.0, -quant), 6) END AS historical_var_loss, round(worst, 6) AS maximum_drawdown, nq AS var_observations, n AS price_observations, n - 1 AS return_observations, CASE WHEN n - 1 >= 10 THEN 'ready' ELSE 'partial' END AS history_status, first_event_id, event_id FROM daily WHERE n > 1",
        EV, DD, CLOSES, DAILY,
    ),
    "daily_return_ids": _rows(
        f"""SELECT source, symbol, {_day('d * 86400000000')} AS day,
  'daily-risk-v2-return-' || substr(sha256('{{"event_ids":["' || previous || '","' || event_id || '"],"metric":"return","model_version":"daily-risk-v2","parameters":{{}}}}'), 1, 24) AS return_id,
  CASE WHEN nv = 5 THEN 'daily-risk-v2-volatility-' || substr(sha256('{{"event_ids":["' || array_to_string(ids, '","') || '"],"metric":"volatility","model_version":"daily-risk-v2","parameters":{{"annualization_days":252,"window":5}}}}'), 1, 24) END AS volatility_id
FROM daily WHERE n > 1""",
        EV, DD, CLOSES, DAILY,
    ),
    "latest_daily_returns": _rows("SELECT DISTINCT s AS source, y AS symbol, epoch_us(ts_event) AS event_us, calculation_id, return_1d AS return_1d FROM dl", DAYS),
    "daily_semantic": _rows(f"SELECT source, symbol, {_day('d * 86400000000')} AS day, period_seconds, round(r, 6) AS return_1d FROM daily LEFT JOIN symbol_grid USING (symbol) WHERE n > 1", EV, DD, CLOSES, DAILY),
    "finance_semantic": _rows(
        "SELECT symbol, CASE WHEN isnan(v) THEN 'no_data' WHEN v >= 0.07 THEN 'critical' WHEN v >= 0.03 THEN 'warn' ELSE 'ok' END AS volatility_status, period_seconds, dq_metric_id, dq_late_status FROM summary LEFT JOIN symbol_grid USING (symbol) LEFT JOIN (SELECT metric_id AS dq_metric_id, late_status AS dq_late_status FROM data_quality_metrics ORDER BY ts_ingest DESC NULLS LAST, metric_id DESC LIMIT 1) ON TRUE",
        EV, DD, MOVES, SUMMARY,
    ),
    "top_k_recent": _rows("SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY e DESC, event_id DESC) AS INTEGER) AS recency, event_id, price FROM dd QUALIFY recency <= 3", EV, DD),
    "freshness": " UNION ALL ".join(f"SELECT '{t}' AS table_name, epoch_us(max(ts_ingest)) AS latest_us FROM {t}" for t in ("market_events_raw", "returns_1m", "volatility_5m", "daily_returns", "portfolio_daily_returns")),
    "replay_partition_hour": _rows("SELECT event_id, delivery_id, i AS ingest_us FROM ev WHERE i // 3600000000 = epoch_us(TIMESTAMP '2003-01-07 10:00:00') // 3600000000", EV),
    "bench_filter_agg": "SELECT count(*) AS rows, round(avg(l_extendedprice), 4) AS average_price, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1996-01-01'",
    "definition_history": _rows("SELECT portfolio_id, definition_fingerprint, from_us, to_us, to_us IS NULL AS is_current FROM defs", DEFS),
    "asof_definition": _rows("SELECT calculation_id, f.portfolio_id, definition_fingerprint AS valid_fingerprint FROM (SELECT DISTINCT calculation_id, portfolio_id, epoch_us(ts_event) AS t FROM portfolio_risk_limit_evaluations) f LEFT JOIN defs ON defs.portfolio_id = f.portfolio_id AND f.t >= from_us AND (to_us IS NULL OR f.t < to_us)", DEFS),
    "governed_segments": "SELECT m.mandate, p.policy, CAST(greatest(m.a, p.a) AS VARCHAR) AS segment_start, CAST(least(m.b, p.b) AS VARCHAR) AS segment_end FROM (VALUES ('m1', DATE '2026-01-01', DATE '2026-01-31'), ('m2', DATE '2026-02-01', DATE '9999-12-31')) m(mandate, a, b) JOIN (VALUES ('p1', DATE '2026-01-01', DATE '2026-01-14'), ('p2', DATE '2026-01-16', DATE '9999-12-31')) p(policy, a, b) ON greatest(m.a, p.a) <= least(m.b, p.b)",
    "governed_gaps": "SELECT 'all' AS scope, '2026-01-14' AS previous_end, '2026-01-16' AS next_start, 'gap' AS problem",
    "portfolio_constituents": _rows("SELECT portfolio_id, definition_fingerprint, component, CAST(size AS INTEGER) AS size, round(weight, 6) AS weight FROM parts_ok", PARTS),
    "portfolio_returns": _rows(f"SELECT portfolio_id, definition_fingerprint, {_day('d * 86400000000')} AS day, CAST(size AS INTEGER) AS constituents, round(r, 6) AS portfolio_return_1d FROM pr", PARTS, ALIGNED),
    "portfolio_risk_summary": _rows(
        f"""SELECT portfolio_id, definition_fingerprint, {_day('d * 86400000000')} AS day, n AS aligned_observations, nq AS var_observations, CASE WHEN n >= 10 THEN 'ready' ELSE 'partial' END AS history_status,
  CASE WHEN n >= 5 THEN round(vol, 6) END AS volatility_annualized, CASE WHEN nq >= 2 THEN round(greatest(0.0, -quant), 6) END AS historical_var_loss, round(min(draw) OVER (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS maximum_drawdown
FROM (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1 AS draw FROM (
  SELECT *, row_number() OVER k AS n, stddev_samp(r) OVER v * sqrt(252) AS vol, count(r) OVER q AS nq, quantile_cont(r, 0.05) OVER q AS quant, product(1 + r) OVER u AS wealth FROM pr
  WINDOW k AS (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d), u AS (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS UNBOUNDED PRECEDING),
    v AS (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), q AS (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)))""",
        PARTS, ALIGNED,
    ),
    "latest_portfolio_returns": "SELECT DISTINCT portfolio_id, epoch_us(ts_event) AS event_us, calculation_id, portfolio_return_1d AS portfolio_return_1d FROM portfolio_daily_returns QUALIFY row_number() OVER (PARTITION BY portfolio_id, definition_fingerprint, weighting_method, ts_event ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1",
    "portfolio_contributions": f"""SELECT portfolio_id, {_day('epoch_us(ts_event)')} AS day, calculation_id, k AS component, CAST(json_extract_string(CASE WHEN {_OBJ.format('weights_json')} THEN weights_json END, '$."' || k || '"') AS DOUBLE) AS weight,
  CAST(json_extract_string(CASE WHEN {_OBJ.format('component_returns_json')} THEN component_returns_json END, '$."' || k || '"') AS DOUBLE) AS component_return, CAST(json_extract_string(contributions_json, '$."' || k || '"') AS DOUBLE) AS contribution
FROM (SELECT *, unnest(json_keys(contributions_json)) AS k FROM (SELECT DISTINCT * FROM portfolio_daily_returns) WHERE {_OBJ.format('contributions_json')})""",
    "rolling_covariance": _rows(f"SELECT portfolio_id, definition_fingerprint, {_day('d * 86400000000')} AS day, {_day('d0 * 86400000000')} AS window_start, row_key, column_key, round(cov, 6) AS covariance_annualized, round(corr, 6) AS correlation FROM mx", PARTS, ALIGNED, MATRIX),
    "euler_attribution": _rows(f"SELECT portfolio_id, definition_fingerprint, {_day('d * 86400000000')} AS day, component, CASE WHEN positive THEN 'positive' ELSE 'zero' END AS volatility_status, round(vol, 6) AS portfolio_volatility, round(contribution, 6) AS component_contribution, round(share, 6) AS contribution_share FROM es", PARTS, ALIGNED, MATRIX, EULER),
    "limit_evaluations": _rows(
        f"SELECT portfolio_id, definition_fingerprint, {_day('d * 86400000000')} AS day, metric_name, subject_key, CASE WHEN observed >= crit THEN 'critical' WHEN observed >= warn THEN 'warning' ELSE 'ok' END AS status, observed >= warn AS is_breach, round(observed, 6) AS observed_value, round(CASE WHEN observed >= crit THEN observed - crit WHEN observed >= warn THEN observed - warn ELSE 0.0 END, 6) AS breach_excess FROM ev2",
        PARTS, ALIGNED, MATRIX, EULER, EVALUATED,
    ),
    "limit_snapshot_status": _rows("SELECT policy_id, portfolio_id, epoch_us(ts_event) AS event_us, count(*) AS evaluations, count(*) FILTER (WHERE is_breach) AS breaches, count(*) FILTER (WHERE status = 'critical') AS criticals, CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status FROM lat GROUP BY policy_id, portfolio_id, ts_event", LATEST),
    "metric_transitions": _rows("SELECT calculation_id, previous_calculation_id, previous_status, status, transition_type, severity_rank, subject_changed FROM tr", LATEST, TRANSITIONS),
    "actionable_transitions": _rows("SELECT calculation_id, transition_type FROM tr WHERE transition_type IN ('opened', 'escalated', 'deescalated', 'resolved')", LATEST, TRANSITIONS),
    "breach_episodes": _rows(
        "SELECT policy_fingerprint, definition_fingerprint, portfolio_id, metric_name, episode_sequence, start_us, last_us, CASE WHEN resolution_id IS NULL THEN 'open' ELSE 'resolved' END AS episode_status, breach_observations, warning_observations, critical_observations, subject_changes, opening_id, latest_id, peak_id, resolution_id, round(peak_value, 6) AS observed_value FROM ep",
        LATEST, TRANSITIONS, EPISODES,
    ),
    "open_episodes": _rows("SELECT portfolio_id, metric_name, episode_sequence, start_us FROM ep WHERE resolution_id IS NULL", LATEST, TRANSITIONS, EPISODES),
    "notification_candidates": _rows(
        """SELECT 'portfolio-risk-notification-outbox-v1-event-' || substr(sha256('{"metric_name":"' || metric_name || '","model_version":"portfolio-risk-notification-outbox-v1","policy_fingerprint":"' || policy_fingerprint || '","source_evaluation_calculation_id":"' || calculation_id || '","source_previous_evaluation_calculation_id":' || coalesce('"' || previous_calculation_id || '"', 'null') || ',"transition_type":"' || transition_type || '"}'), 1, 24) AS event_id,
  'breach_' || transition_type AS event_type, CASE WHEN transition_type = 'deescalated' THEN 'suppressed' ELSE 'pending' END AS delivery_disposition, CASE WHEN transition_type = 'deescalated' THEN 'deescalation_not_routed' END AS suppression_reason, calculation_id AS evaluation_id
FROM tr WHERE transition_type IN ('opened', 'escalated', 'deescalated', 'resolved')""",
        LATEST, TRANSITIONS,
    ),
    "outbox_current": _rows("SELECT DISTINCT event_id, delivery_disposition FROM cob", OUTBOX, LATEST, TRANSITIONS, CURRENT),
    "outbox_summary": _rows("SELECT policy_id, portfolio_id, metric_name, event_type, delivery_disposition, count(*) AS events, epoch_us(min(ts_event)) AS first_us, epoch_us(max(ts_event)) AS last_us FROM ob GROUP BY ALL", OUTBOX),
    "breach_ack_status": _rows(
        f"""SELECT l.calculation_id, coalesce(n, 0) AS acknowledgements, CASE WHEN n > 0 THEN 'acknowledged' ELSE 'open' END AS acknowledgement_status, asked_at AS acknowledged_us FROM one l LEFT JOIN (
  SELECT id, count(*) AS n, max(t) AS asked_at FROM (SELECT id, request, min(t) AS t FROM asked GROUP BY ALL) a JOIN one ON one.calculation_id = a.id AND one.is_breach AND a.t >= epoch_us(one.ts_event) GROUP BY id) k ON k.id = l.calculation_id WHERE l.is_breach""",
        LATEST,
        "one AS (SELECT * FROM lat QUALIFY row_number() OVER (PARTITION BY calculation_id) = 1)",
        OUTBOX,
        f"asked AS (SELECT {_id('source_evaluation_calculation_id')} AS id, unnest([event_id, event_id || '-again']) AS request, epoch_us(ts_ingest) + 3600000000 AS t FROM ob WHERE delivery_disposition = 'pending' AND ts_ingest IS NOT NULL)",
    ),
    "upsert_latest_wins": _rows("SELECT calculation_id, CASE WHEN p <> 0 THEN r + 1 ELSE r END AS return_1d FROM parted", SPLIT),
    "upsert_guarded": _rows("SELECT calculation_id, CASE WHEN p = 2 THEN r + 1 ELSE r END AS return_1d FROM parted", SPLIT),
    "insert_only": _rows("SELECT calculation_id FROM parted WHERE p = 2", SPLIT),
    "attribution_snapshots": _rows(
        f"""SELECT portfolio_id, definition_fingerprint, {_day('d * 86400000000')} AS day, 'portfolio-attribution-v1-snapshot-' || substr(sha256('{{"annualization_days":252,"correlation_method":"pearson_from_sample_covariance","covariance_method":"sample_covariance_ddof_1","covariance_window":10,"definition_fingerprint":"' || definition_fingerprint || '","input_calculation_ids":["' || array_to_string(inputs, '","') || '"],"model_version":"portfolio-attribution-v1","weighting_method":"constant_weight_daily_rebalanced"}}'), 1, 24) AS calculation_id,
  CASE WHEN vol > 1e-12 THEN 'positive' ELSE 'zero' END AS volatility_status, CASE WHEN cells = 0 THEN 'complete' ELSE 'undefined_zero_variance' END AS correlation_status, cells AS undefined_correlation_cells, round(vol * vol, 6) AS portfolio_variance, round(vol, 6) AS portfolio_volatility, round(c - vol, 6) + 0.0 AS euler_residual
FROM (SELECT portfolio_id, definition_fingerprint, d, any_value(vol) AS vol, sum(contribution) AS c FROM es GROUP BY ALL)
JOIN (SELECT portfolio_id, definition_fingerprint, d, count(*) FILTER (WHERE corr IS NULL) AS cells FROM mx GROUP BY ALL) USING (portfolio_id, definition_fingerprint, d)
JOIN (SELECT portfolio_id, definition_fingerprint, d, list(id) OVER (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS inputs FROM pri) USING (portfolio_id, definition_fingerprint, d)""",
        PARTS, ALIGNED, MATRIX, EULER, RETURN_IDS,
    ),
    "portfolio_return_ids": _rows(f"SELECT portfolio_id, definition_fingerprint, {_day('d * 86400000000')} AS day, id AS calculation_id FROM pri", PARTS, ALIGNED, RETURN_IDS),
    "view_latest_attribution": _rows("SELECT portfolio_id, epoch_us(ts_event) AS event_us, calculation_id, portfolio_volatility_annualized AS portfolio_volatility_annualized FROM la", ATTRIBUTED),
    "view_volatility_contributions": _rows(
        f"""SELECT calculation_id, k AS constituent_key, CAST(json_extract_string(component_contribution_share_json, '$."' || k || '"') AS DOUBLE) AS contribution_share FROM (SELECT *, unnest(json_keys(component_contribution_share_json)) AS k FROM la WHERE {_OBJ.format('component_contribution_share_json')})""",
        ATTRIBUTED,
    ),
    "view_breaches": _rows("SELECT calculation_id, metric_name, status, breach_excess AS breach_excess FROM lat WHERE is_breach", LATEST.replace(" WHERE ts_event IS NOT NULL", "")),
    "view_contributions": f"""SELECT calculation_id, k AS component, CAST(json_extract_string(contributions_json, '$."' || k || '"') AS DOUBLE) AS contribution FROM (
  SELECT *, unnest(json_keys(contributions_json)) AS k FROM (SELECT * FROM (SELECT DISTINCT * FROM portfolio_daily_returns) QUALIFY row_number() OVER (PARTITION BY portfolio_id, definition_fingerprint, model_version, weighting_method, ts_event ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1) WHERE {_OBJ.format('contributions_json')})""",
    "view_pending": _rows("SELECT DISTINCT event_id, transition_type FROM cob WHERE delivery_disposition = 'pending'", OUTBOX, LATEST, TRANSITIONS, CURRENT),
    "view_suppressed": _rows("SELECT DISTINCT event_id, suppression_reason FROM cob WHERE delivery_disposition = 'suppressed'", OUTBOX, LATEST, TRANSITIONS, CURRENT),
    "ops_health": "SELECT metric_id, total_events, deduped_events, duplicate_events, CAST(round(CAST(duplicate_rate AS DECIMAL(38, 12)) * 100, 2) AS DOUBLE) AS duplicate_rate_pct, late_events, CAST(round(CAST(late_rate AS DECIMAL(38, 12)) * 100, 2) AS DOUBLE) AS late_rate_pct, late_status, duplicate_status FROM (SELECT DISTINCT * FROM data_quality_metrics) ORDER BY ts_ingest DESC NULLS LAST, metric_id DESC LIMIT 1",
    "ops_incidents": "SELECT metric_id, epoch_us(ts_ingest) AS ingest_us FROM (SELECT DISTINCT * FROM data_quality_metrics) WHERE required_fields_status <> 'ok' OR null_rate_status <> 'ok' OR value_validity_status <> 'ok' OR late_status <> 'ok' OR duplicate_status <> 'ok' ORDER BY ts_ingest DESC NULLS LAST, metric_id DESC LIMIT 50",
    "contract_violations": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{name}' AS constraint_name, count(*) AS checked, count(*) FILTER (WHERE NOT ({c})) AS violations FROM {t}" for t, cs in CONTRACTS.items() for name, c in cs.items()),
    "checks_core": _rows(
        _suite(
            _check("core_deduped_ids_unique", _surplus("dd", "event_id")),
            _check("core_deduped_events_are_events", "SELECT count(*) FROM dd WHERE event_id NOT IN (SELECT event_id FROM ev)"),
            _check("core_late_not_above_deduped", "SELECT CASE WHEN count(*) FILTER (WHERE is_late) > count(*) THEN 1 ELSE 0 END FROM dd"),
            _check("core_total_splits", "SELECT count(*) FROM ev", "SELECT count(*) FROM ev"),
            _check("core_events_came_from_raw", "SELECT count(*) FROM ev WHERE delivery_id NOT IN (SELECT delivery_id FROM market_events_raw)"),
        ),
        EV, DD,
    ),
    "checks_daily": _rows(
        _suite(
            _check("daily_rows_present", "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM dn", "1"),
            _check("daily_ids_surplus", _surplus("dn")),
            _check("daily_latest_grain_repeated", "SELECT count(*) FROM (SELECT 1 FROM dl GROUP BY s, y, ts_event HAVING count(*) > 1)"),
            _check("daily_latest_is_stale", "SELECT count(*) FROM dl JOIN dn USING (s, y, ts_event) WHERE (dn.ts_ingest, dn.calculation_id) > (dl.ts_ingest, dl.calculation_id)"),
            _check("daily_return_not_above_minus_one", "SELECT count(*) FROM dn WHERE return_1d <= -1"),
        ),
        DAYS,
    ),
    "checks_portfolio": _rows(
        _suite(
            _check("portfolio_ids_surplus", _surplus("portfolio_daily_returns")),
            _check("portfolio_weights_do_not_sum_to_one", f"SELECT count(*) FROM pm WHERE w IS NOT NULL AND abs(list_sum({_NUM.format('w')}) - 1) > 0.00001"),
            _check("portfolio_key_sets_differ", "SELECT count(*) FROM pm WHERE list_sort(json_keys(w)) <> list_sort(json_keys(r)) OR list_sort(json_keys(w)) <> list_sort(json_keys(c))"),
            _check("portfolio_constituent_count_wrong", "SELECT count(*) FROM pm WHERE len(json_keys(w)) <> constituent_count"),
            _check("portfolio_contributions_do_not_sum", f"SELECT count(*) FROM pm WHERE c IS NOT NULL AND abs(list_sum({_NUM.format('c')}) - portfolio_return_1d) > 0.000001"),
            _check("portfolio_contribution_is_not_product", "SELECT count(*) FROM pe WHERE abs(wv * rv - cv) > 0.000001"),
        ),
        PMAPS,
    ),
    "checks_limits": _rows(
        _suite(
            _check("limits_ids_surplus", _surplus("st")),
            _check("limits_latest_is_stale", f"SELECT count(*) FROM lat JOIN st USING ({_SERIES}, ts_event) WHERE (st.ts_ingest, st.calculation_id) > (lat.ts_ingest, lat.calculation_id)"),
            _check("limits_more_than_two_metrics", f"SELECT count(*) FROM (SELECT 1 FROM lat GROUP BY {_SERIES.replace(', metric_name', '')}, ts_event HAVING count(DISTINCT metric_name) > 2)"),
            _check("limits_breach_flag_wrong", "SELECT count(*) FROM st WHERE is_breach <> (status <> 'ok') OR warning_threshold > critical_threshold"),
            _check("limits_excess_negative", "SELECT count(*) FROM st WHERE breach_excess < 0"),
            _check("limits_attribution_orphans", "SELECT count(*) FROM st WHERE attribution_calculation_id IS NOT NULL AND attribution_calculation_id NOT IN (SELECT calculation_id FROM portfolio_risk_attribution WHERE calculation_id IS NOT NULL)"),
        ),
        LATEST, "st AS (SELECT DISTINCT * FROM portfolio_risk_limit_evaluations WHERE ts_event IS NOT NULL)",
    ),
    "checks_outbox": _rows(
        _suite(
            _check("outbox_ids_surplus", _surplus("ob", "event_id")),
            _check("outbox_disposition_wrong", "SELECT count(*) FROM ob WHERE (delivery_disposition = 'suppressed') <> (transition_type = 'deescalated')"),
            _check("outbox_suppression_without_reason", "SELECT count(*) FROM ob WHERE delivery_disposition = 'suppressed' AND suppression_reason IS NULL"),
            _check("outbox_evaluation_orphans", "SELECT count(*) FROM ob WHERE source_evaluation_calculation_id IS NOT NULL AND source_evaluation_calculation_id NOT IN (SELECT calculation_id FROM portfolio_risk_limit_evaluations WHERE calculation_id IS NOT NULL)"),
            _check("outbox_current_not_stored", "SELECT 0"),
        ),
        OUTBOX,
    ),
    "checks_lifecycle": _rows(
        _suite(
            _check("lifecycle_transition_per_evaluation", "SELECT count(*) FROM tr", "SELECT count(*) FROM lat"),
            _check("lifecycle_episode_per_opening", "SELECT count(*) FROM ep", "SELECT count(*) FROM tr WHERE transition_type = 'opened'"),
            _check("lifecycle_open_episode_has_later_ok", f"SELECT count(*) FROM (SELECT DISTINCT {_SERIES}, episode_sequence FROM ep JOIN (SELECT {_SERIES}, epoch_us(ts_event) AS t FROM tr WHERE status = 'ok') k USING ({_SERIES}) WHERE resolution_id IS NULL AND t > last_us)"),
            _check("lifecycle_peak_below_opening", "SELECT count(*) FROM ep JOIN lat o ON o.calculation_id = opening_id JOIN lat p ON p.calculation_id = peak_id WHERE p.observed_value < o.observed_value AND p.status = o.status"),
            _check("lifecycle_counts_do_not_split", "SELECT count(*) FROM ep WHERE breach_observations <> warning_observations + critical_observations"),
        ),
        LATEST, TRANSITIONS, EPISODES,
    ),
    "checks_attribution": _rows(
        _suite(
            _check("attribution_matrix_asymmetric", "SELECT count(*) FROM mx a LEFT JOIN mx b ON a.portfolio_id = b.portfolio_id AND a.definition_fingerprint = b.definition_fingerprint AND a.d = b.d AND a.row_key = b.column_key AND a.column_key = b.row_key WHERE b.cov IS NULL OR abs(a.cov - b.cov) > 1e-9"),
            _check("attribution_correlation_out_of_bounds", "SELECT count(*) FROM mx WHERE abs(corr) > 1"),
            _check("attribution_diagonal_negative", "SELECT count(*) FROM mx WHERE row_key = column_key AND cov < 0"),
            _check("attribution_contributions_do_not_sum", "SELECT count(*) FROM (SELECT sum(contribution) AS c, any_value(vol) AS v FROM es GROUP BY portfolio_id, definition_fingerprint, d) WHERE abs(c - v) > 1e-9"),
            _check("attribution_shares_do_not_sum_to_one", "SELECT count(*) FROM (SELECT sum(share) AS s, any_value(vol) AS v FROM es GROUP BY portfolio_id, definition_fingerprint, d) WHERE abs(s - 1) > 1e-9 AND v > 1e-12"),
            _check("attribution_cells_missing", "SELECT count(*) FROM (SELECT portfolio_id, definition_fingerprint, d, count(*) AS n FROM es GROUP BY ALL) JOIN (SELECT portfolio_id, definition_fingerprint, d, count(*) AS c FROM mx GROUP BY ALL) USING (portfolio_id, definition_fingerprint, d) WHERE c <> n * n"),
        ),
        PARTS, ALIGNED, MATRIX, EULER,
    ),
}

_NEAR = "0.0000000001"
_SNAPSHOT = "policy_id, policy_fingerprint, portfolio_id, definition_fingerprint, attribution_calculation_id, ts_event"
STORED = "st AS (SELECT DISTINCT * FROM portfolio_risk_limit_evaluations WHERE ts_event IS NOT NULL)"
ATTRIBUTIONS = f"att AS (SELECT DISTINCT * FROM portfolio_risk_attribution),\nam AS (SELECT *, CASE WHEN {_OBJ.format('component_contribution_share_json')} THEN component_contribution_share_json END AS shares FROM att)"
ACKNOWLEDGED = f"""one AS (SELECT * FROM lat QUALIFY row_number() OVER (PARTITION BY calculation_id) = 1),
asked AS (SELECT {_id('source_evaluation_calculation_id')} AS id, unnest([event_id, event_id || '-again']) AS request, epoch_us(ts_ingest) + 3600000000 AS t FROM ob WHERE delivery_disposition = 'pending' AND ts_ingest IS NOT NULL),
ack AS (SELECT id, request, min(t) AS t FROM asked JOIN one ON one.calculation_id = id AND one.is_breach GROUP BY ALL HAVING min(t) >= min(epoch_us(one.ts_event))),
bs AS (SELECT calculation_id, count(id) AS n, max(t) AS t, CASE WHEN count(id) > 0 THEN 'acknowledged' ELSE 'open' END AS state FROM one LEFT JOIN ack ON id = calculation_id WHERE is_breach GROUP BY calculation_id)"""
ENDS = f"""ee AS (
  SELECT {_SERIES}, episode_sequence, min(ts_event) FILTER (WHERE is_breach) AS t0, max(ts_event) FILTER (WHERE is_breach) AS t1, min(ts_event) FILTER (WHERE status = 'ok') AS t2,
    count(*) FILTER (WHERE is_breach) AS n, count(*) FILTER (WHERE is_breach AND status = 'warning') AS nw, count(*) FILTER (WHERE is_breach AND status = 'critical') AS nc,
    arg_min({{'id': calculation_id, 'status': status}}, (ts_event, ts_ingest, calculation_id)) FILTER (WHERE is_breach) AS o,
    arg_max({{'id': calculation_id, 'status': status, 'excess': breach_excess}}, (ts_event, ts_ingest, calculation_id)) FILTER (WHERE is_breach) AS l,
    arg_min({{'id': calculation_id, 'status': status, 'excess': breach_excess}}, (-severity_rank, -breach_excess, -observed_value, ts_event, ts_ingest, calculation_id)) FILTER (WHERE is_breach) AS p,
    arg_min({{'id': calculation_id, 'ingest': ts_ingest}}, (ts_event, ts_ingest, calculation_id)) FILTER (WHERE status = 'ok') AS r
  FROM num WHERE episode_sequence > 0 GROUP BY ALL),
eo AS (SELECT *, lag(t2 IS NULL) OVER w AS was_open, lag(coalesce(t2, t1)) OVER w AS until FROM ee WINDOW w AS (PARTITION BY {_SERIES} ORDER BY t0, episode_sequence))"""
ACTS = "act AS (SELECT * FROM tr WHERE transition_type IN ('opened', 'escalated', 'deescalated', 'resolved'))"
_PAIRS = "FROM st e JOIN am a ON a.calculation_id = e.attribution_calculation_id"
_TOLD = "t.calculation_id = c.source_evaluation_calculation_id AND t.transition_type = c.transition_type"
_WHOLE = _TOLD + " AND t.previous_calculation_id IS NOT DISTINCT FROM c.source_previous_evaluation_calculation_id"
_PAYLOAD = f"(CASE WHEN {_OBJ.format('payload_json')} THEN payload_json END)"
_SAID = f"json_extract_string({_PAYLOAD}, '$.{{0}}')"


def _unlike(*columns: str, left: str = "e", right: str = "a") -> str:
    return " OR ".join(f"{left}.{c} <> {right}.{c}" for c in columns)


ORACLES |= {
    "checks_limits_evidence": _rows(
        _suite(
            _check("limits_attribution_missing", "SELECT count(*) FROM st WHERE NOT EXISTS (SELECT 1 FROM att WHERE att.calculation_id = st.attribution_calculation_id)"),
            _check("limits_attribution_metadata_differs", f"SELECT count(*) {_PAIRS} WHERE e.attribution_model_version <> a.model_version OR {_unlike('portfolio_id', 'base_currency', 'definition_fingerprint', 'weighting_method', 'covariance_method', 'correlation_method', 'covariance_window', 'annualization_days', 'ts_event')}"),
            _check("limits_attribution_ingest_differs", f"SELECT count(*) {_PAIRS} WHERE e.ts_ingest <> a.ts_ingest"),
            _check("limits_attribution_not_current", "SELECT count(*) FROM lat WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.calculation_id = lat.attribution_calculation_id)"),
            _check(
                "limits_observed_value_differs",
                f"SELECT count(*) {_PAIRS} WHERE (metric_name = 'portfolio_volatility_annualized' AND abs(observed_value - portfolio_volatility_annualized) > {_NEAR}) OR (metric_name = 'largest_absolute_component_contribution_share' AND (abs(observed_value - list_max([abs(v) FOR v IN {_NUM.format('shares')}])) > {_NEAR} OR abs(observed_signed_value - CAST(json_extract_string(shares, '$.\"' || subject_key || '\"') AS DOUBLE)) > {_NEAR}))",
            ),
            _check("limits_latest_grain_repeated", f"SELECT count(*) FROM (SELECT 1 FROM lat GROUP BY {_SERIES}, ts_event HAVING count(*) <> 1)"),
            _check("limits_snapshot_status_rows", f"SELECT count(*) FROM (SELECT 1 FROM lat GROUP BY {_SNAPSHOT})", f"SELECT count(*) FROM (SELECT DISTINCT {_SNAPSHOT} FROM lat)"),
            _check("limits_snapshot_status_wrong", f"SELECT count(*) FROM (SELECT {_SNAPSHOT}, CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'ok' END AS s FROM lat GROUP BY ALL) x WHERE s <> (SELECT CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END FROM lat WHERE ({_SNAPSHOT.replace('policy_id', 'lat.policy_id', 1)}) IS NOT DISTINCT FROM ({', '.join('x.' + c for c in _SNAPSHOT.split(', '))}))"),
            _check("limits_acknowledgement_orphans", "SELECT count(*) FROM ack WHERE id NOT IN (SELECT calculation_id FROM st WHERE calculation_id IS NOT NULL)"),
            _check("limits_acknowledgement_target_invalid", "SELECT count(*) FROM ack JOIN st ON calculation_id = id WHERE NOT is_breach OR t < epoch_us(ts_event)"),
            _check("limits_acknowledgement_request_repeated", "SELECT count(*) FROM (SELECT 1 FROM ack GROUP BY id, request HAVING count(*) > 1)"),
            _check("limits_acknowledgement_history_rows", "SELECT count(*) FROM ack WHERE id IN (SELECT calculation_id FROM st)", "SELECT count(*) FROM ack"),
            _check("limits_breach_status_rows", "SELECT count(*) FROM bs", "SELECT count(DISTINCT calculation_id) FROM one WHERE is_breach"),
            _check("limits_open_and_acknowledged_rows", "SELECT (SELECT count(*) FROM bs WHERE state = 'open') + (SELECT count(*) FROM bs WHERE state = 'acknowledged')", "SELECT count(DISTINCT calculation_id) FROM one WHERE is_breach"),
            _check("limits_breach_status_not_latest", "SELECT count(*) FROM bs WHERE n <> (SELECT count(*) FROM ack WHERE id = calculation_id) OR t IS DISTINCT FROM (SELECT max(ack.t) FROM ack WHERE id = calculation_id) OR (state = 'acknowledged') <> EXISTS (SELECT 1 FROM ack WHERE id = calculation_id)"),
        ),
        LATEST, OUTBOX, STORED, ATTRIBUTIONS, ATTRIBUTED, ACKNOWLEDGED,
    ),
    "checks_lifecycle_episodes": _rows(
        _suite(
            _check("lifecycle_transition_contract_broken", "SELECT count(*) FROM tr WHERE transition_type NOT IN ('initial_ok', 'opened', 'escalated', 'deescalated', 'resolved', 'unchanged') OR (status = 'ok' AND severity_rank <> 0) OR (status = 'warning' AND severity_rank <> 1) OR (status = 'critical' AND severity_rank <> 2) OR (transition_type = 'opened' AND NOT is_breach) OR (transition_type = 'resolved' AND (status <> 'ok' OR is_breach))"),
            _check("lifecycle_resolution_per_resolved_episode", "SELECT count(*) FROM ee WHERE t2 IS NOT NULL", "SELECT count(*) FROM tr WHERE transition_type = 'resolved'"),
            _check("lifecycle_episode_figures_wrong", "SELECT count(*) FROM ee WHERE n <= 0 OR n <> nw + nc OR o.status NOT IN ('warning', 'critical') OR l.status NOT IN ('warning', 'critical') OR p.status NOT IN ('warning', 'critical') OR t0 > t1 OR p.excess < 0 OR l.excess < 0"),
            _check("lifecycle_episode_resolution_wrong", "SELECT count(*) FROM ee WHERE r IS NOT NULL AND (r.id IS NULL OR r.ingest IS NULL OR t2 <= t1)"),
            _check("lifecycle_episode_boundary_wrong", "SELECT count(*) FROM ee LEFT JOIN tr a ON a.calculation_id = o.id LEFT JOIN tr b ON b.calculation_id = l.id LEFT JOIN tr c ON c.calculation_id = p.id LEFT JOIN tr d ON d.calculation_id = r.id WHERE a.calculation_id IS NULL OR a.transition_type <> 'opened' OR NOT a.is_breach OR b.calculation_id IS NULL OR NOT b.is_breach OR c.calculation_id IS NULL OR NOT c.is_breach OR (t2 IS NOT NULL AND (d.calculation_id IS NULL OR d.transition_type <> 'resolved' OR d.status <> 'ok' OR d.is_breach))"),
            _check("lifecycle_episode_keys_surplus", f"SELECT count(*) - count(DISTINCT ({_SERIES}, t0)) FROM ee"),
            _check("lifecycle_episodes_overlap", "SELECT count(*) FROM eo WHERE was_open OR t0 <= until"),
            _check("lifecycle_open_episode_is_stale", f"SELECT count(*) FROM (SELECT DISTINCT {_SERIES}, episode_sequence FROM ee JOIN (SELECT {_SERIES}, ts_event FROM tr) k USING ({_SERIES}) WHERE t2 IS NULL AND ts_event > t1)"),
        ),
        LATEST, TRANSITIONS, EPISODES, ENDS,
    ),
    "checks_outbox_candidates": _rows(
        _suite(
            _check("outbox_current_per_actionable_transition", "SELECT count(*) FROM cob", "SELECT count(*) FROM act"),
            _check("outbox_summary_reconciles", "SELECT sum(n) FROM (SELECT count(*) AS n FROM cob GROUP BY policy_id, portfolio_id, metric_name, event_type, delivery_disposition)", "SELECT count(*) FROM cob"),
            _check("outbox_previous_evaluation_orphans", "SELECT count(*) FROM ob WHERE source_previous_evaluation_calculation_id IS NOT NULL AND source_previous_evaluation_calculation_id NOT IN (SELECT calculation_id FROM st WHERE calculation_id IS NOT NULL)"),
            _check(
                "outbox_transition_metadata_differs",
                f"SELECT count(*) FROM cob c JOIN act t ON {_TOLD} WHERE {_unlike('policy_id', 'portfolio_id', 'ts_event', 'metric_name', 'subject_type', 'subject_key', 'severity_rank', left='c', right='t')} OR c.previous_status IS DISTINCT FROM t.previous_status OR c.current_status <> t.status OR abs(c.observed_value - t.observed_value) > {_NEAR} OR abs(c.warning_threshold - t.warning_threshold) > {_NEAR} OR abs(c.critical_threshold - t.critical_threshold) > {_NEAR}",
            ),
            _check("outbox_transition_ingest_differs", f"SELECT count(*) FROM cob c JOIN act t ON {_TOLD} WHERE c.ts_ingest <> t.ts_ingest"),
            _check("outbox_disposition_or_reason_wrong", "SELECT count(*) FROM ob WHERE (transition_type IN ('opened', 'escalated', 'resolved') AND (delivery_disposition <> 'pending' OR suppression_reason IS NOT NULL)) OR (transition_type = 'deescalated' AND (delivery_disposition <> 'suppressed' OR suppression_reason <> 'deescalation_not_routed'))"),
            _check("outbox_payload_identity_differs", f"SELECT count(*) FROM ob WHERE {_PAYLOAD} IS NULL OR {_SAID.format('metric')} <> metric_name OR {_SAID.format('status')} <> current_status OR {_SAID.format('portfolio')} <> portfolio_id OR abs(TRY_CAST({_SAID.format('value')} AS DOUBLE) - observed_value) > {_NEAR}"),
            _check("outbox_candidate_missing", f"SELECT count(*) FROM act t WHERE NOT EXISTS (SELECT 1 FROM cob c WHERE {_WHOLE})"),
            _check("outbox_current_is_stale", f"SELECT count(*) FROM cob c WHERE NOT EXISTS (SELECT 1 FROM act t WHERE {_WHOLE})"),
        ),
        LATEST, TRANSITIONS, OUTBOX, CURRENT, ACTS, STORED,
    ),
}

_KEYED = f"{_id('source')} AS s, {_sym('symbol')} AS y"
_PGRAIN = "portfolio_id, definition_fingerprint, ts_event, model_version, weighting_method"
_AGRAIN = "portfolio_id, definition_fingerprint, ts_event, model_version, weighting_method, covariance_method, correlation_method, covariance_window, annualization_days"
_JSONS = {"w": "weights_json", "i": "component_calculation_ids_json", "r": "component_returns_json", "c": "contributions_json"}
_READ = ", ".join(f"CASE WHEN {_OBJ.format(c)} THEN {c} END AS {k}" for k, c in _JSONS.items())
PORTFOLIO_STORED = f"""ps AS (SELECT DISTINCT * FROM portfolio_daily_returns WHERE ts_event IS NOT NULL),
pj AS (SELECT *, {_READ} FROM ps),
pl AS (SELECT * FROM pj QUALIFY row_number() OVER (PARTITION BY {_PGRAIN} ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1),
pk AS (SELECT CAST(json_extract_string(w, '$."' || k || '"') AS DOUBLE) AS wv, CAST(json_extract_string(r, '$."' || k || '"') AS DOUBLE) AS rv, CAST(json_extract_string(c, '$."' || k || '"') AS DOUBLE) AS cv FROM (SELECT *, unnest(json_keys(c)) AS k FROM pj WHERE w IS NOT NULL AND r IS NOT NULL AND c IS NOT NULL)),
pc AS (SELECT json_extract_string(i, '$."' || k || '"') AS id FROM (SELECT *, unnest(json_keys(i)) AS k FROM pj WHERE i IS NOT NULL)),
px2 AS (
  SELECT portfolio_id, definition_fingerprint, d, row_number() OVER k AS n, count(*) OVER q AS nq, count(*) OVER v AS nv FROM pr
  WINDOW k AS (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d), v AS (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), q AS (PARTITION BY portfolio_id, definition_fingerprint ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
ATTRIBUTION_STORED = f"""att AS (SELECT DISTINCT * FROM portfolio_risk_attribution WHERE ts_event IS NOT NULL),
al2 AS (SELECT *, CASE WHEN {_OBJ.format('component_contribution_share_json')} THEN component_contribution_share_json END AS sh FROM att QUALIFY row_number() OVER (PARTITION BY {_AGRAIN} ORDER BY ts_ingest DESC NULLS LAST, calculation_id DESC NULLS LAST) = 1),
sn AS (SELECT portfolio_id, definition_fingerprint, d, sum(weight * m) AS variance, any_value(vol) AS vol FROM es GROUP BY ALL),
mn AS (SELECT portfolio_id, definition_fingerprint, d, count(*) FILTER (WHERE corr IS NULL) AS nulls, count(*) AS cells, count(corr) AS defined FROM mx GROUP BY ALL)"""
_KEYS = " OR ".join([*(f"{k} IS NULL OR len(json_keys({k})) <> constituent_count" for k in _JSONS), *(f"list_sort(json_keys(w)) <> list_sort(json_keys({k}))" for k in "irc")])

ORACLES |= {
    "checks_daily_history": _rows(
        _suite(
            _check("core_finance_rows", "SELECT count(*) FROM summary LEFT JOIN symbol_grid USING (symbol)", "SELECT count(*) FROM summary"),
            _check("daily_return_event_orphans", "SELECT count(*) FROM dn WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.event_id = dn.source_event_id AND rk.s = dn.s AND rk.y = dn.y AND rk.ts_event = dn.ts_event)"),
            _check("daily_summary_event_orphans", "SELECT count(*) FROM daily WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM dd WHERE dd.event_id = daily.event_id AND dd.source = daily.source AND dd.symbol = daily.symbol AND dd.e // 86400000000 = daily.d)"),
            _check("daily_summary_grain_repeated", "SELECT count(*) FROM (SELECT 1 FROM daily WHERE n > 1 GROUP BY source, symbol, d HAVING count(*) > 1)"),
            _check("daily_ready_history_too_short", "SELECT count(*) FROM daily WHERE n - 1 >= 10 AND (nq < 10 OR nv <> 5 OR vol IS NULL)"),
            _check("daily_semantic_rows", "SELECT count(*) FROM daily LEFT JOIN symbol_grid USING (symbol) WHERE n > 1", "SELECT count(*) FROM daily WHERE n > 1"),
        ),
        EV, DD, MOVES, SUMMARY, CLOSES, DAILY, DAYS, f"rk AS (SELECT event_id, {_KEYED}, ts_event FROM market_events_raw)",
    ),
    "checks_portfolio_history": _rows(
        _suite(
            _check("portfolio_component_return_orphans", "SELECT count(*) FROM pc WHERE NOT EXISTS (SELECT 1 FROM daily_returns r WHERE r.calculation_id = pc.id)"),
            _check("portfolio_component_keys_wrong", f"SELECT count(*) FROM pj WHERE {_KEYS}"),
            _check("portfolio_weights_off_one", f"SELECT count(*) FROM pj WHERE abs(list_sum({_NUM.format('w')}) - 1) > 0.000000001"),
            _check("portfolio_contributions_off_return", f"SELECT count(*) FROM pj WHERE abs(list_sum({_NUM.format('c')}) - portfolio_return_1d) > 0.000000000001"),
            _check("portfolio_contributions_off_product", "SELECT count(*) FROM pk WHERE abs(cv - wv * rv) > 0.000000000001"),
            _check("portfolio_latest_grain_repeated", f"SELECT count(*) FROM (SELECT 1 FROM pl GROUP BY {_PGRAIN} HAVING count(*) > 1)"),
            _check("portfolio_latest_is_stale", f"SELECT count(*) FROM pl JOIN ps USING ({_PGRAIN}) WHERE (ps.ts_ingest, ps.calculation_id) > (pl.ts_ingest, pl.calculation_id)"),
            _check("portfolio_contribution_rows", "SELECT coalesce(sum(len(json_keys(c))), 0) FROM pl", "SELECT sum(constituent_count) FROM pl"),
            _check("portfolio_summary_grain_repeated", "SELECT count(*) FROM (SELECT 1 FROM pr GROUP BY portfolio_id, definition_fingerprint, d HAVING count(*) > 1)"),
            _check("portfolio_ready_history_too_short", "SELECT count(*) FROM px2 WHERE n >= 10 AND (nq < 10 OR nv < 5)"),
        ),
        PARTS, ALIGNED, PORTFOLIO_STORED,
    ),
    "checks_attribution_history": _rows(
        _suite(
            _check("attribution_ids_surplus", _surplus("att")),
            _check("attribution_latest_grain_repeated", f"SELECT count(*) FROM (SELECT 1 FROM al2 GROUP BY {_AGRAIN} HAVING count(*) > 1)"),
            _check("attribution_latest_is_stale", f"SELECT count(*) FROM al2 JOIN att USING ({_AGRAIN}) WHERE (att.ts_ingest, att.calculation_id) > (al2.ts_ingest, al2.calculation_id)"),
            _check("attribution_stored_shares_wrong", f"SELECT count(*) FROM al2 WHERE sh IS NULL OR len(json_keys(sh)) <> constituent_count OR (volatility_status = 'positive' AND abs(list_sum({_NUM.format('sh')}) - 1) > 0.000000001) OR (volatility_status = 'zero' AND abs(list_sum({_NUM.format('sh')})) > 0.000000001)"),
            _check("attribution_contribution_rows", "SELECT coalesce(sum(len(json_keys(sh))), 0) FROM al2", "SELECT sum(constituent_count) FROM al2"),
            _check("attribution_variance_is_not_squared_volatility", f"SELECT count(*) FROM sn WHERE abs(variance - vol * vol) > {_NEAR}"),
            _check("attribution_null_count_wrong", "SELECT count(*) FROM mn WHERE nulls <> cells - defined"),
            _check("attribution_correlation_wrong", f"SELECT count(*) FROM mx a LEFT JOIN mx b ON a.portfolio_id = b.portfolio_id AND a.definition_fingerprint = b.definition_fingerprint AND a.d = b.d AND a.row_key = b.column_key AND a.column_key = b.row_key WHERE b.d IS NULL OR (a.corr IS NULL) <> (b.corr IS NULL) OR abs(a.corr - b.corr) > {_NEAR} OR abs(a.corr) > 1 + {_NEAR} OR (a.row_key = a.column_key AND abs(a.corr - 1) > {_NEAR})"),
        ),
        PARTS, ALIGNED, MATRIX, EULER, ATTRIBUTION_STORED,
    ),
}

ORACLES |= {
    "checks_limits_snapshots": _rows(_suite(_check("limits_snapshot_has_not_two_metrics", f"SELECT count(*) FROM (SELECT 1 FROM lat GROUP BY {_SNAPSHOT} HAVING count(*) <> 2 OR count(DISTINCT metric_name) <> 2)")), LATEST),
}
