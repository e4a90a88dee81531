"""Landed files, the provider, stores and streams."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.text import json_object, strict_json_object
from tidegrid.operators import lateness
from tidegrid.sources import landed, provider, stores
from tidegrid.sources.io_bench import run_io_benchmark
from tidegrid.streaming import panes, replay


def test_landed_csv_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ticker,close,Volume,timestamp\naapl,10.5,100,2025-01-20T10:00:00Z\nmsft,x,1,2025-01-20\ngoog,1,1.5,20/01/2025\n")
    good, bad = landed.market_events(landed.read_landed(spark, str(tmp_path / "a.csv")), "desk", F.lit("2025-01-21").cast("timestamp"))
    row = good.first()
    assert (row.symbol, row.price, row.volume, row.source) == ("AAPL", 10.5, 100, "desk") and row.event_id.startswith("market-") and len(row.event_id) == 23
    assert sorted(r.problems for r in bad.collect()) == [["price"], ["volume"]]
    (tmp_path / "b.jsonl").write_text('{"indicator": " fed funds", "reading": 4.5, "timestamp": "2025-01-20T10:00:00+02:00"}\n{"name": "vix", "value": null, "ts_event": "2025-01-20"}\n')
    good, bad = landed.signals(landed.read_landed(spark, str(tmp_path / "b.jsonl")), "lab")
    assert [(r.name, r.value, r.ts_event.hour) for r in good.collect()] == [("FED_FUNDS", 4.5, 8)] and bad.count() == 1
    (tmp_path / "c.json").write_text('[{"id": "e1", "symbol": "a", "price": 1, "volume": 2, "ts_event": "2025-01-20", "provider": "p"}]')
    good, _ = landed.market_events(landed.read_landed(spark, str(tmp_path / "c.json")), "desk")
    assert (good.first().event_id, good.first().source) == ("e1", "p")
    with pytest.raises(landed.UnsupportedFormat):
        landed.read_landed(spark, "x.xml")


def test_nested_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"event": {"id": "e", "quote": {"price": 1.5}}, "source": {"name": "s"}}')
    out = landed.nested_documents(spark.read.json(str(tmp_path / "d.json")), {"event_id": "event.id", "price": "event.quote.price", "absent": "event.none.x"}).first()
    assert (out.event_id, out.price, out.absent) == ("e", 1.5, None)


BODY = {"Meta Data": {"2. Symbol": "IBM"}, "Time Series (Daily)": {f"2025-01-0{d}": {"1. open": "10", "2. high": "12", "3. low": "9", "4. close": str(10 + d / 10), "5. volume": "5"} for d in range(1, 6)}}


def test_provider(spark):
    got = provider.parse_daily(spark, json.dumps(BODY).encode(), "ibm", "bars", start="2025-01-02", most=3).collect()
    assert [(r.ts_event.day, r.price) for r in got] == [(3, 10.3), (4, 10.4), (5, 10.5)] and len({r.event_id for r in got}) == 3
    broken = json.loads(json.dumps(BODY))
    broken["Time Series (Daily)"]["2025-01-01"]["2. high"] = "1"
    for body, symbol in ((b"{", "ibm"), (b'{"Note": "slow down"}', "ibm"), (json.dumps(BODY).encode(), "msft"), (json.dumps(broken).encode(), "ibm"), (b'{"a": 1, "a": 2}', "ibm")):
        with pytest.raises(provider.ProviderError):
            provider.parse_daily(spark, body, symbol, "bars")


def test_fetch_retries():
    answers, pauses = iter([(500, b""), (429, b""), (200, b"ok")]), []
    assert provider.fetch(lambda: next(answers), sleep=pauses.append) == b"ok" and pauses == [0.25, 0.5]
    with pytest.raises(provider.ProviderError, match="404"):
        provider.fetch(lambda: (404, b""), sleep=pauses.append)


def event(spark, rows):
    return spark.createDataFrame([(i, "A", float(p), 1, datetime.datetime(2025, 1, 20, 9), datetime.datetime(2025, 1, 20, h), "s") for i, p, h in rows], landed.EVENT_SCHEMA)


def test_raw_store(spark, tmp_path):
    path = str(tmp_path / "raw")
    assert stores.append_raw(event(spark, [("a", 1, 12), ("a", 1, 10), ("b", 2, 11)]), path, landed.EVENT_SCHEMA) == 2
    assert stores.append_raw(event(spark, [("a", 1, 13), ("c", 3, 11)]), path, landed.EVENT_SCHEMA) == 1
    with pytest.raises(stores.ConflictError):
        stores.append_raw(event(spark, [("d", 1, 13), ("a", 9, 13)]), path, landed.EVENT_SCHEMA)
    stored = stores.read_store(spark, path, landed.EVENT_SCHEMA)
    assert sorted((r.event_id, r.ts_ingest.hour) for r in stored.collect()) == [("a", 10), ("b", 11), ("c", 11)]
    assert [r.event_id for r in stores.hour_partition(spark, path, "2025", "01", "20", "11").collect()] == ["b", "c"]
    assert {r.problem: r.rows for r in stores.inventory_problems(spark, path, landed.EVENT_SCHEMA).collect()} == {"wrong_partition": 0, "repeated_id": 0, "missing_field": 0}
    done = replay.backfill(spark, path, datetime.datetime(2025, 1, 20, 9), datetime.datetime(2025, 1, 20, 13), lambda df, _: df.count(), str(tmp_path / "done.json"))
    assert list(done.values()) == [1, 2]
    again = replay.backfill(spark, path, datetime.datetime(2025, 1, 20, 9), datetime.datetime(2025, 1, 20, 13), lambda *_: pytest.fail("ran again"), str(tmp_path / "done.json"))
    assert again == done


def test_curated_tables_and_locks(spark, tmp_path):
    path = str(tmp_path / "curated")
    rows = event(spark, [("a", 1, 12), ("b", 1, 12)])
    assert (stores.append_curated(rows, path, ["event_id"]), stores.append_curated(rows, path, ["event_id"])) == (2, 0)
    stores.replace_table(rows, str(tmp_path / "t"))
    stores.replace_table(rows.where("event_id = 'a'"), str(tmp_path / "t"))
    assert stores.current_table(spark, str(tmp_path / "t")).count() == 1
    with stores.RunLock(str(tmp_path / "lock")), pytest.raises(RuntimeError), stores.RunLock(str(tmp_path / "lock")):
        pass
    body = stores.manifest("r", {"in": "x"}, {"out": 1}, {"w": 5})
    assert body["manifest_id"] == stores.manifest("r", {"in": "x"}, {"out": 1}, {"w": 5})["manifest_id"]


def test_scan_benchmark_formats_agree(spark, tmp_path):
    out = run_io_benchmark(spark, f"file://{tmp_path}", 1000, 5, 2, 1)
    assert out["csv_ms"] > 0 and out["parquet_ms"] > 0
    first, again = (stores.synthetic_events(spark, 100).orderBy("event_id").collect() for _ in range(2))
    assert first == again


@pytest.mark.parametrize("hours", [1, 3])
def test_streamed_panes(spark, tmp_path, folder, hours):
    """Fed in several batches, the stream ends where the batch operator does, also for windows of several panes."""
    raw = spark.read.parquet(f"{folder}/market_events_raw.parquet").limit(600)
    source, window = tmp_path / "in", hours * lateness.HOUR
    for k in range(3):
        raw.where(F.col("delivery_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    panes.run_panes(stream, str(tmp_path / "store"), str(tmp_path / "cp"), window_seconds=window).awaitTermination(120)
    cols = ["symbol", "window_start", "events_published", "events_final", "corrections", "rejected"]
    want = lateness.compose(lateness.panes(lateness.usable(raw), window_seconds=window), window_seconds=window).select(cols)
    got = panes.current_windows(spark, str(tmp_path / "store")).select(cols)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    panes.compact(spark, str(tmp_path / "store"), str(tmp_path / "small"))
    assert panes.current_panes(spark, str(tmp_path / "small")).exceptAll(panes.current_panes(spark, str(tmp_path / "store"))).count() == 0


def test_streams(spark, tmp_path, folder):
    """The stream's copies of an event are stored once."""
    raw = spark.read.parquet(f"{folder}/market_events_raw.parquet").limit(600)
    source = tmp_path / "in"
    for k in range(3):
        raw.where(F.col("delivery_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(source))
    events = spark.readStream.schema(landed.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)).where("event_id is not null and ts_ingest is not null").withColumn("event_id", F.concat("event_id", F.lit("-"), F.col("ts_ingest").cast("string"), F.lit("-"), F.xxhash64("symbol", "price", "volume", "ts_event", "source").cast("string")))
    replay.ingest(events, str(tmp_path / "raw"), landed.EVENT_SCHEMA, str(tmp_path / "cp2")).awaitTermination(120)
    stored = stores.read_store(spark, str(tmp_path / "raw"), landed.EVENT_SCHEMA)
    assert stored.count() == stored.select("event_id").distinct().count() > 500


def test_caps_raise_and_small_files_are_replaced(spark, tmp_path):
    rows = spark.range(5)
    assert stores.capped(rows, 5).count() == 5
    with pytest.raises(stores.CapExceeded):
        stores.capped(rows, 4)
    path = str(tmp_path / "note.json")
    assert stores.read_text(spark, path) is None
    for text in ("one", "two\nlines"):
        stores.write_text(spark, path, text)
        assert stores.read_text(spark, path) == text


def test_raw_reader_filters(spark, tmp_path):
    stores.append_raw(stores.synthetic_events(spark, 400, 4, 3).select(*landed.EVENT_SCHEMA.fieldNames()), str(tmp_path / "raw"), landed.EVENT_SCHEMA)
    got = stores.read_raw(spark, str(tmp_path / "raw"), landed.EVENT_SCHEMA, source="benchmark", symbol="SYM001", end=datetime.date(2025, 1, 2))
    assert {r.symbol for r in got.collect()} == {"SYM001"} and max(r.ts_event for r in got.collect()).date() <= datetime.date(2025, 1, 2)
    with pytest.raises(stores.CapExceeded):
        stores.read_raw(spark, str(tmp_path / "raw"), landed.EVENT_SCHEMA, most=10)


def test_replay_leaves_out_daily_events(spark):
    rows = spark.createDataFrame([("a", "feed"), ("daily-1", "feed"), ("b", "daily_feed"), (None, None)], "event_id string, source string")
    assert sorted(str(r.event_id) for r in replay.minute_eligible(rows, "daily_feed", "daily-").collect()) == ["None", "a"]


def test_tables_are_loaded_by_key(spark, tmp_path, at):
    rows = spark.createDataFrame([("a", at("2024-01-01T00:00:00"), 1.0), ("a", at("2024-01-02T00:00:00"), 2.0), ("b", None, 3.0)], "calculation_id string, ts_ingest timestamp, return_1d double")
    folder = str(tmp_path / "warehouse")
    assert stores.load_tables({"daily_returns": rows}, folder, dry_run=True) == {"daily_returns": 2}
    assert not stores.exists(spark, folder)
    stores.load_tables({"daily_returns": rows}, folder)
    stores.load_tables({"daily_returns": rows.where("calculation_id = 'b'").withColumn("return_1d", F.lit(9.0))}, folder)
    got = stores.current_table(spark, f"{folder}/daily_returns")
    assert sorted((r.calculation_id, r.return_1d) for r in got.collect()) == [("a", 2.0), ("b", 9.0)]
    with pytest.raises(ValueError):
        stores.load_tables({"other": rows}, folder)


def test_fetch_ends_in_time():
    now = [0.0]
    waits: list[float] = []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    with pytest.raises(provider.ProviderError, match="within"):
        provider.fetch(lambda: (503, b""), retries=50, pause=1.0, sleep=sleep, total_seconds=10, clock=lambda: now[0])
    assert sum(waits) < 10


def test_configuration_of_symbols_and_storage():
    row = {"symbol": "A", "source": "s", "asset_class": "equity", "reporting_currency": "USD", "effective_from": "2024-01-01"}
    assert stores.symbol_versions({"symbols": {"equities": [row], "fx": None}}) == [row]
    for bad in ([row, dict(row)], [{"symbol": "A"}]):
        with pytest.raises(ValueError):
            stores.symbol_versions({"symbols": {"equities": bad}})
    config = {"storage": {"raw": {"base_path": "data/raw", "dataset": "events"}, "curated": {"base_path": "data/curated", "datasets": {"returns_1m": "r"}}}}
    assert stores.storage_paths(config, "/x/") == {"events": "/x/data/raw/events", "returns_1m": "/x/data/curated/r"}
    with pytest.raises(ValueError):
        stores.storage_paths({"storage": {"format": "csv"}})


def test_inventory_of_types_and_sizes(spark, tmp_path):
    path = str(tmp_path / "raw")
    stores.append_raw(stores.synthetic_events(spark, 50, 4, 3).select(*landed.EVENT_SCHEMA.fieldNames()), path, landed.EVENT_SCHEMA)
    assert stores.inventory_schema_problems(spark, path, landed.EVENT_SCHEMA, 1 << 30) == []
    assert {r.problem: r["rows"] for r in stores.inventory_problems(spark, path, landed.EVENT_SCHEMA).collect()}["number_not_finite"] == 0
    other = T.StructType([T.StructField("price", T.StringType()), T.StructField("lot", T.LongType())])
    assert len(stores.inventory_schema_problems(spark, path, other, 1)) == 3


def test_strict_objects(spark):
    rows = spark.createDataFrame([('{"a": 1, "a": 2}',), ('{"a": 1}',), ("[]",), (None,)], "j string")
    got = [tuple(r) for r in rows.select(strict_json_object(F.col("j"), "double"), json_object(F.col("j"), "double")).collect()]
    assert got == [(None, {"a": 2.0}), ({"a": 1.0}, {"a": 1.0}), (None, None), (None, None)]
