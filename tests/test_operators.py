"""Analytics operators against values computed by hand or by a plain loop."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.ids import content_id, driver_id
from tidegrid.functions.quantiles import exact_quantile
from tidegrid.functions.scan import carry_in, offset
from tidegrid.operators import checks, daily, limits, market, portfolio, quality, versions

EVENT = "delivery_id bigint, event_id string, symbol string, price double, volume bigint, ts_event timestamp, ts_ingest timestamp, source string"


def closes(spark, prices):
    rows = [("s", "A", datetime.date(2025, 1, d), p, f"e{d}", datetime.datetime(2025, 1, d)) for d, p in prices.items()]
    return spark.createDataFrame(rows, "source string, symbol string, day date, price double, event_id string, ts_ingest timestamp")


def test_daily_risk(spark):
    out = daily.daily_risk(closes(spark, {1: 100.0, 2: 110.0, 3: 99.0, 4: 108.9}), volatility_window=2, var_window=2).orderBy("day").collect()
    assert [r.return_1d for r in out] == pytest.approx([0.1, -0.1, 0.1])
    assert sum(r.volatility_annualized is not None for r in out) == 2
    assert out[-1].historical_var_loss == pytest.approx(0.09)
    assert out[-1].maximum_drawdown == pytest.approx(-0.1)
    assert out[-1].history_status == "ready" and out[0].history_status == "partial"


def test_backfill_makes_a_new_version(spark):
    before = daily.daily_risk(closes(spark, {1: 100.0, 3: 121.0}), volatility_window=2, var_window=2).first()
    after = daily.daily_risk(closes(spark, {1: 100.0, 2: 110.0, 3: 121.0}), volatility_window=2, var_window=2).orderBy("day").collect()[-1]
    assert before.return_1d == pytest.approx(0.21) and after.return_1d == pytest.approx(0.1)
    assert before.return_id != after.return_id and before.summary_id != after.summary_id


def test_ids_equal_the_drivers(spark):
    row = spark.range(1).select(content_id("x-", 24, ids=F.array(F.lit("a"), F.lit("b")), n=F.lit(3), w=F.lit(0.95), none=F.lit(None).cast("string"))).first()
    assert row[0] == driver_id("x-", {"ids": ["a", "b"], "n": 3, "w": 0.95, "none": None})


def test_minute_path(spark, at):
    rows = [(i, f"e{i}", s, p, 1, at(f"2025-01-20T10:0{m}:00"), at(f"2025-01-20T10:0{m}:01") if i != 5 else at("2025-01-20T10:07:00.000001"), "d") for i, (s, p, m) in enumerate([("aapl", 100.0, 1), (" AAPL", 101.0, 2), ("AAPL", 102.0, 3), ("MSFT", 240.0, 1), ("MSFT", 242.0, 2), ("MSFT", 241.0, 3)])]
    rows += [(9, "E5 ", "MSFT", 241.0, 1, at("2025-01-20T10:03:00"), at("2025-01-20T10:09:00"), "d"), (10, "x", "MSFT", -1.0, 1, at("2025-01-20T10:03:00"), at("2025-01-20T10:09:00"), "d")]
    events = market.normalise(spark.createDataFrame(rows, EVENT), late_seconds=239)
    kept = market.first_arrivals(events)
    assert kept.count() == 6
    rates = quality.batch_rates(events).first()
    assert (rates.total_events, rates.deduped_events, rates.late_events) == (7, 6, 1) and rates.duplicate_rate == pytest.approx(1 / 7)
    moves = market.returns_and_volatility(kept, 2).orderBy("symbol", "ts_event").collect()
    assert [m.return_1m for m in moves] == pytest.approx([0.010000000000000009, 0.00990099009900991, 0.008333333333333304, -0.004132231404958664])
    vols = {m.symbol: m.volatility_5m for m in moves if m.volatility_5m is not None}
    assert vols == pytest.approx({"AAPL": 0.00007001057239470774, "MSFT": 0.00881448535776616})
    var = {r.symbol: r.value_at_risk for r in market.value_at_risk(market.returns_and_volatility(kept, 2), ["symbol"]).collect()}
    assert var == pytest.approx({"AAPL": 0.009905940594059415, "MSFT": -0.003508953168044065})


def test_sharded_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(i, f"e{i:04d}", rng.choice(["HOT", "HOT", "HOT", "B"]), rng.uniform(1, 2), 1, start + datetime.timedelta(seconds=rng.randrange(86400 * 9)), start, "d") for i in range(400)]
    events = market.normalise(spark.createDataFrame(rows, EVENT))
    got = {r.event_id: (r.return_1m, r.volatility_5m) for r in market.returns_and_volatility(events, 4).collect()}
    for symbol in ("HOT", "B"):
        line = sorted((r for r in rows if r[2] == symbol), key=lambda r: (r[5], r[1]))
        rets = [b[3] / a[3] - 1 for a, b in zip(line, line[1:])]
        for k, r in enumerate(line[1:]):
            window = rets[max(0, k - 3) : k + 1]
            mean = sum(window) / len(window)
            vol = math.sqrt(sum((x - mean) ** 2 for x in window) / 3) if len(window) == 4 else None
            assert got[r[1]] == (pytest.approx(rets[k]), pytest.approx(vol) if vol else None)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.973, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(4)
    data = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [1.0], "c": [rng.choice([1.0, 2.0]) for _ in range(40)], "d": [float(i) for i in range(7)]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in [*vs, None]], "k string, v double")
    for r in exact_quantile(df, ["k"], "v", q, "x").collect():
        vs = sorted(data[r.k])
        at = q * (len(vs) - 1)
        lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
        assert r.n == len(vs) and r.x == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))


def test_prefix_scans(spark):
    rng = random.Random(6)
    rows = [(k, i * 1500, rng.choice([None, i]), rng.randrange(5)) for k in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "k string, o bigint, s int, n bigint")
    carried = {(r.k, r.o): r.c for r in carry_in(df, ["k"], "o", "s", "c").collect()}
    summed = {(r.k, r.o): r.t for r in offset(df, ["k"], "o", "n", "t").collect()}
    for k in "ab":
        last, total = None, 0
        for _, o, s, n in [r for r in rows if r[0] == k]:
            assert carried[k, o] == last and summed[k, o] == total
            last, total = s if s is not None else last, total + n


def aligned(spark):
    rows = [("p", "f", "USD", 2, datetime.date(2025, 1, 2 + i), [("A", 0.5, a, f"a{i}"), ("M", 0.5, m, f"m{i}")], datetime.datetime(2025, 1, 3 + i)) for i, (a, m) in enumerate([(0.10, 0.02), (-0.04, 0.0), (0.06, 0.02)])]
    return spark.createDataFrame(rows, "portfolio_id string, definition_fingerprint string, base_currency string, size int, day date, components array<struct<component:string,weight:double,return_1d:double,calculation_id:string>>, ts_ingest timestamp")


def test_portfolio_risk(spark):
    out = portfolio.portfolio_risk(portfolio.portfolio_returns(aligned(spark)), 2, 2).orderBy("day").collect()
    assert [r.portfolio_return_1d for r in out] == pytest.approx([0.06, -0.02, 0.04])
    assert out[-1].historical_var_loss == pytest.approx(0.017) and out[-1].maximum_drawdown == pytest.approx(-0.02) and out[-1].history_status == "ready"


def test_attribution(spark):
    matrix = portfolio.rolling_matrix(aligned(spark), 3)
    cells = {(r.row_key, r.column_key): r for r in matrix.collect()}
    assert cells["A", "A"].covariance_annualized == pytest.approx(1.3104) and cells["A", "M"].covariance_annualized == pytest.approx(0.2016)
    assert cells["A", "M"].correlation == pytest.approx(0.9607689228305227)
    parts = {r.component: r for r in portfolio.euler_attribution(matrix).collect()}
    assert parts["A"].portfolio_variance == pytest.approx(0.4368) and parts["A"].portfolio_volatility == pytest.approx(0.6609084656743323)
    assert parts["A"].component_contribution == pytest.approx(0.5719400183720182) and sum(p.contribution_share for p in parts.values()) == pytest.approx(1)
    snap = portfolio.attribution_snapshots(aligned(spark), matrix, 3)
    both = {r.metric_name: r for r in limits.evaluate(snap, (0.30, 0.45), (0.65, 0.80), "fp").collect()}
    assert both[limits.VOLATILITY].status == "critical" and both[limits.CONCENTRATION].subject_key == "A"


def test_zero_variance(spark):
    flat = aligned(spark).withColumn("components", F.transform("components", lambda c: c.withField("return_1d", F.lit(0.01))))
    matrix = portfolio.rolling_matrix(flat, 3)
    assert {r.correlation for r in matrix.collect()} == {None}
    assert {(r.volatility_status, r.contribution_share) for r in portfolio.euler_attribution(matrix).collect()} == {("zero", 0.0)}


SERIES_ROWS = {
    "vol": [("ok", 0.20), ("warning", 0.35), ("critical", 0.50), ("warning", 0.34), ("ok", 0.25), ("warning", 0.32)],
    "share": [("critical", 0.90), ("critical", 0.85), ("ok", 0.50), ("ok", 0.40), ("warning", 0.70), ("critical", 0.81)],
}


def evaluations(spark):
    rows = [("p", m, f"{m}{d}", datetime.datetime(2025, 1, d), datetime.datetime(2025, 1, d), s, s != "ok", "B" if (m, d) == ("share", 2) else "A", v, v, max(0.0, v - 0.3)) for m, line in SERIES_ROWS.items() for d, (s, v) in enumerate(line, 1)]
    return spark.createDataFrame(rows, "portfolio_id string, metric_name string, calculation_id string, ts_event timestamp, ts_ingest timestamp, status string, is_breach boolean, subject_key string, observed_value double, observed_signed_value double, breach_excess double")


def test_transitions_and_episodes(spark):
    moves = limits.transitions(evaluations(spark), ["portfolio_id", "metric_name"])
    kinds = [r.transition_type for r in moves.where("metric_name = 'vol'").orderBy("ts_event").collect()]
    assert kinds == ["initial_ok", "opened", "escalated", "deescalated", "resolved", "opened"]
    assert limits.actionable(moves).count() == 9
    found = {(r.metric_name, r.episode_sequence): r for r in limits.episodes(moves, ["portfolio_id", "metric_name"]).collect()}
    assert len(found) == 4 and sorted(r.episode_status for r in found.values()) == ["open", "open", "resolved", "resolved"]
    one = found["vol", 1]
    assert (one.breach_observations, one.critical_observations, one.peak.calculation_id, one.resolution.calculation_id) == (3, 1, "vol3", "vol5")
    assert found["share", 1].subject_changes == 1


def test_versions(spark):
    t = lambda d: datetime.datetime(2025, 1, d)
    stored = spark.createDataFrame([("a", t(2), 1), ("b", t(2), 1)], "k string, ts_ingest timestamp, v int")
    new = spark.createDataFrame([("a", t(1), 2), ("b", t(2), 2), ("c", t(1), 2)], "k string, ts_ingest timestamp, v int")
    read = lambda df: {r.k: r.v for r in df.collect()}
    assert read(versions.upsert(stored, new, ["k"])) == {"a": 2, "b": 2, "c": 2}
    assert read(versions.upsert_newer(stored, new, ["k"])) == {"a": 1, "b": 2, "c": 2}
    assert read(versions.insert_new(stored, new, ["k"])) == {"c": 2}
    assert read(versions.conflicts(new, stored, "k", ["v"]).withColumn("v", F.lit(0))) == {"a": 0, "b": 0}
    history = versions.effective_intervals(spark.createDataFrame([("a", t(1), "x"), ("a", t(5), "y")], "k string, effective_from timestamp, name string"), ["k"])
    facts = spark.createDataFrame([("a", t(1)), ("a", t(4)), ("a", t(5)), ("b", t(1))], "k string, at timestamp")
    assert sorted((r.k, r.at.day, r.name) for r in versions.as_of(facts, history, ["k"], "at").na.fill("-").collect()) == [("a", 1, "x"), ("a", 4, "x"), ("a", 5, "y"), ("b", 1, "-")]


def test_quality(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}', 1.0), ('{"a": null}', float("nan")), ("[]", -1.0), (None, None)], "j string, x double")
    m = quality.json_field_metrics(df, "j", ["a", "b"]).first()
    assert (m.rows, m.missing_a, m.null_a, m.missing_b, m.null_b) == (4, 2, 1, 3, 1)
    r = quality.range_metrics(df, {"x": (0.0, None, False)}).first()
    assert (r.checked, r.invalid) == (3, 2)
    with pytest.raises(quality.QualityError, match="positive"):
        quality.gate(df, {"positive": F.col("x") > 0})
    assert quality.gate(df, {"known": F.col("x").isNotNull() | F.col("x").isNull()}) is df


def test_checks_report(spark):
    df = spark.createDataFrame([("a",), ("a",)], "calculation_id string")
    out = checks.suite([checks.measure("surplus", df, checks.surplus_ids(df)), checks.check("none", df.where("false"))])
    assert [(r.check_name, r.actual, r.status) for r in out.collect()] == [("none", 0, "pass"), ("surplus", 1, "fail")]
    with pytest.raises(AssertionError, match="surplus"):
        checks.require(out)


def test_views(spark):
    t = lambda d: datetime.datetime(2025, 1, d)
    from tidegrid.operators.serving import Warehouse

    dims = spark.createDataFrame([("A", "s2", "equity", "USD", "tech", True), ("A", "s1", "equity", "EUR", "tech", True), ("A", "s1", "equity", "EUR", "old", False)], "symbol string, source string, asset_class string, reporting_currency string, sector string, is_current boolean")
    risk = spark.createDataFrame([("A", t(1), "ok"), ("A", t(2), "warn"), ("B", t(1), "ok")], "symbol string, ts_ingest timestamp, volatility_status string")
    dq = spark.createDataFrame([(1, t(1), "ok", "ok", "ok"), (2, t(2), "ok", "critical", "ok")], "metric_id bigint, ts_ingest timestamp, required_fields_status string, null_rate_status string, value_validity_status string")
    grain = "portfolio_id string, definition_fingerprint string, model_version string, weighting_method string, covariance_method string, correlation_method string, covariance_window int, annualization_days int, ts_event timestamp"
    attribution = spark.createDataFrame(
        [("p", "f", "v", "w", "c", "r", 3, 252, t(3), t(4), c, t(1), t(3), '{"A": {"A": 1.5, "B": 0.5}}', '{"A": {"A": 1.0, "B": null}}') for c in ("c1", "c2")],
        grain + ", ts_ingest timestamp, calculation_id string, window_start timestamp, window_end timestamp, covariance_annualized_json string, correlation_json string",
    )
    w = Warehouse({"symbol_dimension_history": dims, "risk_summary": risk, "data_quality_metrics": dq, "portfolio_risk_attribution": attribution})
    rows = {r.symbol: r for r in w.finance_risk_semantic_model().collect()}
    assert (rows["A"].source, rows["A"].volatility_status, rows["A"].null_rate_status) == ("s1", "warn", "critical") and rows["B"].source is None
    assert sorted((r.calculation_id, r.column_constituent_key, r.covariance_annualized) for r in w.portfolio_covariance_model().collect()) == [("c2", "A", 1.5), ("c2", "B", 0.5)]
    assert [(r.column_constituent_key, r.correlation, r.correlation_undefined) for r in w.portfolio_correlation_model().orderBy("column_constituent_key").collect()] == [("A", 1.0, False), ("B", None, True)]
    assert [r.symbol for r in w.elevated_symbols("2025-01-02 12:00:00").collect()] == ["A"]
    made = w.register(spark, "v_")
    assert "v_latest_risk_summary" in made and spark.sql("select * from v_latest_risk_summary").count() == 2
    assert len(w.names()) == 33


def test_governance(spark):
    from tidegrid.operators import governance as g

    d = datetime.date.fromisoformat
    parts = [{"source": "s", "symbol": "msft", "weight": 0.4}, {"source": "s", "symbol": "AAPL", "weight": 0.6}]
    entry = lambda name, a, b: {"mandate_id": name, "effective_from": a, "effective_to": b, "base_currency": "USD", "constituents": parts}
    rule = lambda name, a, b: {"policy_version_id": name, "effective_from": a, "effective_to": b, "portfolio_id": "p", "covariance_window": 20, "annualization_days": 252, "limits": {limits.VOLATILITY: {"warning": 0.3, "critical": 0.45}, limits.CONCENTRATION: {"warning": 0.65, "critical": 0.8}}}
    mandates = g.timeline([g.mandate("p", entry("b", "2026-02-01", None)), g.mandate("p", entry("a", "2026-01-01", "2026-02-01"))])
    policies = g.timeline([g.policy("q", rule("a", "2026-01-01", "2026-01-15")), g.policy("q", rule("b", "2026-01-15", None))])
    segments, identity = g.plan(mandates, policies, d("2026-01-10"), d("2026-02-10"))
    assert [(s.start, s.end, s.mandate.name, s.policy.name) for s in segments] == [(d("2026-01-10"), d("2026-01-14"), "a", "a"), (d("2026-01-15"), d("2026-01-31"), "a", "b"), (d("2026-02-01"), d("2026-02-10"), "b", "b")]
    assert sum((s.end - s.start).days + 1 for s in segments) == 32 and identity.startswith("governed-plan-")
    assert g.as_of(mandates, d("2026-02-01")).name == "b" and g.frame(spark, mandates).count() == 2
    assert g.definition("p", "USD", parts) == g.definition("p", "USD", parts[::-1])
    for broken in (
        lambda: g.plan(mandates, policies, d("2025-12-31"), d("2026-01-02")),
        lambda: g.timeline([*mandates, g.mandate("p", entry("c", "2026-03-01", None))]),
        lambda: g.definition("p", "USD", parts[:1]),
        lambda: g.definition("p", "USD", [parts[0], parts[0] | {"weight": 0.6}]),
        lambda: g.definition("p", "USD", [parts[0], parts[1] | {"weight": 0.7}]),
        lambda: g.mandate("p", entry("a", "yesterday", None)),
    ):
        with pytest.raises(g.ConfigError):
            broken()


def test_staged_tables_are_shared_and_released(spark):
    from tidegrid import session

    df = session.stage(spark.range(5), "some")
    assert df.count() == 5 and session.shared_dir(spark).rsplit("/", 1)[-1] in df.inputFiles()[0]
    assert session.is_small(df, 5) and not session.is_small(df, 4)
    assert session.release(spark) >= 1


def test_floor_div_is_exact(spark):
    from tidegrid.functions.times import floor_div

    big = (1 << 62) + 12345
    rows = [-1, -7, 0, 6, 7, big, -big, -(1 << 62)]
    got = spark.createDataFrame([(x,) for x in rows], "x bigint").select("x", floor_div(F.col("x"), 7).alias("q")).collect()
    assert all(r.q == r.x // 7 for r in got)


def test_daily_events_are_validated(spark, at):
    from tidegrid.operators.quality import QualityError

    schema = "event_id string, source string, symbol string, price double, volume bigint, ts_event timestamp"
    good = [("a", "s", "X", 1.0, 1, at("2024-01-01T00:00:00")), ("b", "s", "X", 2.0, 1, at("2024-01-02T00:00:00"))]
    assert daily.validated(spark.createDataFrame(good, schema)).count() == 2
    bad = [("a", "s", "X", float("nan"), -1, at("2024-01-02T00:00:01")), (" ", "s", "Y", 1.0, 1, at("2024-01-03T00:00:00"))]
    found = {r.problem: r.rows for r in daily.event_problems(spark.createDataFrame(good + bad, schema)).collect()}
    assert found == {"not_midnight": 1, "blank_identity": 1, "price_not_positive": 1, "volume_negative": 1, "repeated_event_id": 1, "more_than_one_close": 1}
    for rows in (good + bad, good[:1]):
        with pytest.raises(QualityError):
            daily.validated(spark.createDataFrame(rows, schema))


def test_one_row_per_key_is_defined(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q")], "k string, ts_ingest int, v string")
    assert sorted((r.k, r.v) for r in versions.one_per(rows, ["k"]).collect()) == [("a", "y"), ("b", "q")]


def test_dimension_history(spark):
    schema = "k string, effective_from int, color string"
    first = versions.upsert_dimension(spark.createDataFrame([], schema), spark.createDataFrame([("a", 1, "red"), ("b", 1, "blue")], schema), ["k"], ["color"])
    then = versions.upsert_dimension(first, spark.createDataFrame([("a", 5, "red"), ("a", 7, "green"), ("b", 1, "black")], schema), ["k"], ["color"])
    assert sorted((r.k, r.effective_from, r.effective_to, r.color, r.is_current) for r in then.collect()) == [("a", 1, 7, "red", False), ("a", 7, None, "green", True), ("b", 1, None, "black", True)]
    assert versions.dimension_problems(then, ["k"]).count() == 0
    broken = spark.createDataFrame([("a", 1, 9, True), ("a", 5, None, True), ("b", 3, 2, False)], "k string, effective_from int, effective_to int, is_current boolean")
    assert {r.problem: r["keys"] for r in versions.dimension_problems(broken, ["k"]).collect()} == {"not_one_current": 2, "overlap": 1, "reversed": 1}
