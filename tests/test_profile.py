"""The profile of every column of a load, with ranges."""

from __future__ import annotations

from tidegrid.operators import drift


def test_every_column_has_its_range(spark, at):
    rows = [
        (1, "b", "A", 2.0, 5, at("2024-01-01T00:00:00"), None, "s", "L", at("2024-01-02T00:00:00")),
        (9, "a", " ", float("nan"), -7, at("2024-01-03T00:00:00"), None, "s", "L", None),
        (4, None, "B", -3.0, None, None, None, "s", None, None),
    ]
    df = spark.createDataFrame(rows, "delivery_id bigint, event_id string, symbol string, price double, volume bigint, ts_event timestamp, ts_ingest timestamp, source string, batch_id string, loaded_at timestamp")
    got = {(r.load, r.field): r for r in drift.column_profile(df).collect()}
    assert {f for _, f in got} == set(df.columns) and len(got) == 20
    span = lambda load, f: (got[load, f].low_value, got[load, f].high_value)
    assert span("L", "delivery_id") == (1, 9) and span("L", "price") == (2, 2) and span("L", "volume") == (-7, 5) and span("L", "ts_ingest") == (None, None)
    assert span("L", "ts_event") == tuple(at(f"2024-01-0{d}T00:00:00").timestamp() * 1e6 for d in (1, 3))
    assert (got["L", "event_id"].low_text, got["L", "event_id"].high_text) == ("a", "b")
    assert (got["L", "symbol"].blanks, got["L", "price"].invalid, got["L", "volume"].invalid, got["L", "loaded_at"].nulls) == (1, 1, 1, 1)
    assert (got[None, "batch_id"].nulls, got[None, "delivery_id"].distinct_values, got["L", "batch_id"].distinct_values) == (1, 1, 1)
