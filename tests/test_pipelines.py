"""Pipelines end to end on the reference's deterministic inputs."""

from __future__ import annotations

import datetime
import json
import math

import pytest

from tests.test_sources import BODY
from tidegrid.operators import governance, limits, quality
from tidegrid.plans import pipelines


def demo():
    rows = [("AAPL", 1, 100), ("AAPL", 2, 101), ("AAPL", 3, 102), ("MSFT", 1, 240), ("MSFT", 2, 242), ("MSFT", 3, 241)]
    events = [{"event_id": f"evt-{i}", "symbol": s, "price": p, "volume": 10, "ts_event": f"2025-01-20T10:0{m}:00Z", "ts_ingest": f"2025-01-20T10:0{m + 5 * (i == 5)}:00Z", "source": "demo"} for i, (s, m, p) in enumerate(rows, 1)]
    return [*events, events[-1]]


def test_minute_pipeline(spark, tmp_path):
    (tmp_path / "demo.json").write_text(json.dumps(demo()))
    (tmp_path / "signals.csv").write_text("indicator,reading,timestamp\nVIX,20,2025-01-20T09:00:00Z\nvix,21,2025-01-20T10:00:00Z\n")
    run = lambda: pipelines.run_minute(spark, str(tmp_path / "demo.json"), str(tmp_path / "out"), signals_path=str(tmp_path / "signals.csv"), late_seconds=60, window=2)
    first = run()
    assert first["outputs"] == {"market_events": 6, "returns_1m": 4, "data_quality_metrics": 1, "risk_summary": 2, "external_signal_summary": 1}
    assert set(run()["outputs"].values()) == {0}
    dq = spark.read.parquet(str(tmp_path / "out/data_quality_metrics")).first()
    assert dq.late_rate == pytest.approx(1 / 6) and dq.duplicate_rate == pytest.approx(1 / 7) and (dq.late_status, dq.duplicate_status) == ("critical", "critical")
    moves = spark.read.parquet(str(tmp_path / "out/returns_1m"))
    assert moves.where("volatility_5m is not null").count() == 2


def test_a_bad_batch_writes_nothing(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps([*demo(), demo()[0] | {"price": -1}]))
    with pytest.raises(quality.QualityError):
        pipelines.run_minute(spark, str(tmp_path / "bad.json"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


@pytest.fixture(scope="module")
def closes(spark):
    rows = []
    for i in range(26):
        day = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=i)
        for k, (symbol, price) in enumerate((("AAPL", round(100 + 0.55 * i + 1.4 * math.sin(i / 2), 6)), ("MSFT", round(220 + 0.42 * i + 1.8 * math.cos(i / 3), 6)))):
            rows.append((f"{symbol}-{i}", symbol, price, 1_000_000 + 1_000 * i + k, day, day + datetime.timedelta(hours=18, minutes=i + k), "bars"))
    return spark.createDataFrame(rows, "event_id string, symbol string, price double, volume bigint, ts_event timestamp, ts_ingest timestamp, source string")


PARTS = [{"source": "bars", "symbol": "AAPL", "weight": 0.5}, {"source": "bars", "symbol": "MSFT", "weight": 0.5}]
RULE = {"policy_version_id": "v", "effective_from": "2020-01-01", "portfolio_id": "p", "covariance_window": 20, "annualization_days": 252, "limits": {limits.VOLATILITY: {"warning": 0.30, "critical": 0.45}, limits.CONCENTRATION: {"warning": 0.65, "critical": 0.80}}}


def mandate(name="m", start="2020-01-01", end=None):
    return governance.mandate("p", {"mandate_id": name, "effective_from": start, "effective_to": end, "base_currency": "USD", "constituents": PARTS})


def test_chain(spark, closes, tmp_path):
    days = pipelines.daily_tables(closes, 5, 10)
    assert days["daily_returns"].groupBy("symbol").count().collect() == [("AAPL", 25), ("MSFT", 25)] or {r["count"] for r in days["daily_returns"].groupBy("symbol").count().collect()} == {25}
    tables = pipelines.portfolio_tables(days["daily_returns"], governance.constituent_frame(spark, [mandate()]), governance.policy("q", RULE), 5, 10)
    counts = {n: t.count() for n, t in tables.items()}
    assert (counts["portfolio_daily_returns"], counts["portfolio_daily_risk_summary"], counts["portfolio_risk_attribution"], counts["portfolio_risk_limit_evaluations"]) == (25, 25, 6, 12)
    assert tables["portfolio_risk_attribution"].where("abs(euler_residual) > 1e-10").count() == 0
    late = pipelines.portfolio_tables(days["daily_returns"], governance.constituent_frame(spark, [mandate()]), governance.policy("q", RULE), 5, 10, start=datetime.date(2026, 1, 25), end=datetime.date(2026, 1, 25))
    one = late["portfolio_risk_attribution"].first()
    assert late["portfolio_risk_attribution"].count() == 1
    assert one.calculation_id in {r.calculation_id for r in tables["portfolio_risk_attribution"].collect()}
    kept = {n: tables[n] for n in ("portfolio_daily_returns", "portfolio_risk_limit_evaluations")}
    assert pipelines.write(kept, str(tmp_path), "chain", {})["outputs"] == {"portfolio_daily_returns": 25, "portfolio_risk_limit_evaluations": 12}
    assert set(pipelines.write(kept, str(tmp_path), "chain", {})["outputs"].values()) == {0}


def test_governed_segments_stay_within_their_mandates(spark, closes):
    days = pipelines.daily_tables(closes, 5, 10)["daily_returns"]
    mandates = governance.timeline([mandate("a", "2026-01-01", "2026-01-26"), mandate("b", "2026-01-26", None)])
    runs = pipelines.governed(spark, days, mandates, [governance.policy("q", RULE)], datetime.date(2026, 1, 20), datetime.date(2026, 1, 26))
    counts = [(s.mandate.name, t["portfolio_risk_attribution"].count(), t["portfolio_daily_returns"].count()) for s, t in runs]
    assert counts == [("a", 5, 6), ("b", 0, 1)]


def test_provider_ingest(spark, tmp_path):
    body = json.dumps(BODY).encode()
    assert pipelines.ingest_provider(spark, body, "IBM", "bars", str(tmp_path / "raw")) == 5
    assert pipelines.ingest_provider(spark, body, "IBM", "bars", str(tmp_path / "raw")) == 0


def test_ranges_and_caps(spark, closes):
    end, start = datetime.date(2026, 1, 20), datetime.date(2026, 1, 15)
    whole, part = (pipelines.daily_tables(closes, 5, 10, strict=True, **kw)["daily_risk_summary"] for kw in ({}, {"start": start, "end": end}))
    assert part.agg({"day": "min"}).first()[0] == start and part.agg({"day": "max"}).first()[0] == end
    # figures do not depend on where the output begins
    cols = ["symbol", "day", "volatility_annualized", "historical_var_loss"]
    assert part.select(cols).exceptAll(whole.select(cols)).count() == 0
    with pytest.raises(quality.QualityError):
        pipelines.daily_tables(closes.unionByName(closes.limit(1)), 5, 10, strict=True)
    returns, parts = pipelines.daily_tables(closes, 5, 10)["daily_returns"], governance.constituent_frame(spark, [mandate()])
    rule = governance.policy("p", RULE)
    assert pipelines.portfolio_tables(returns, parts, rule, 5, 10, most={"portfolio_risk_limit_evaluations": 1000})["portfolio_risk_limit_evaluations"].count() > 2
    with pytest.raises(pipelines.stores.CapExceeded):
        pipelines.portfolio_tables(returns, parts, rule, 5, 10, most={"portfolio_risk_limit_evaluations": 2})
