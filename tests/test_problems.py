"""The core problems against brute force on small hand-made tables, and their edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import drift, gridfill, lateness, orphans, redelivery, rolling

DELIVERY = "delivery_id bigint, event_id string, symbol string, price double, volume bigint, ts_event timestamp, ts_ingest timestamp, source string, batch_id string, loaded_at timestamp, slot int, day int"


def delivery(spark, rows):
    """Deliveries from (delivery_id, event_id, symbol, price, volume, ts_event, ts_ingest); with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "feed", "load-1", None, 7, 8) for r in rows], DELIVERY)


def sets(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- 1: regular grid ------------------------------------------------------------
GRID = "symbol string, period_seconds int, open_second int, close_second int"


def test_grid_marks_and_fills(spark, at):
    grid = spark.createDataFrame([("A", 600, 3600, 7200), ("B", 1800, 0, 3600)], GRID)
    raw = delivery(
        spark,
        [
            (1, "a", " a ", 10.0, 1, at("2024-01-01T01:05:00"), at("2024-01-01T01:05:01")),
            (2, "a", "A", 11.0, 1, at("2024-01-01T01:09:59.999999"), None),
            (3, "b", "A", 12.0, 1, at("2024-01-01T01:50:00"), None),
            (4, "c", "A", float("nan"), 1, at("2024-01-01T01:20:00"), None),
            (5, "d", "A", -1.0, 1, at("2024-01-01T01:20:00"), None),
            (6, "e", "A", None, 1, at("2024-01-01T01:20:00"), None),
            (7, "f", "Z", 5.0, 1, at("2024-01-05T01:20:00"), None),
            (8, None, "A", 9.0, 1, at("2024-01-03T00:00:00"), None),
            (9, None, None, 9.0, 1, None, None),
        ],
    )
    rows = {(r.symbol, r.slot_start): r for r in gridfill.regularize(raw, grid).collect()}
    day1, day3 = int(at("2024-01-01T00:00:00").timestamp()), int(at("2024-01-03T00:00:00").timestamp())
    assert len(rows) == 2 * 6 + 2 * 2
    first = rows["A", day1 + 3600]
    assert (first.readings, first.first_price, first.last_price, first.is_missing) == (2, 10.0, 11.0, False)
    assert rows["A", day1 + 4200].price == 11.0 and rows["A", day1 + 4200].is_missing
    # the carry crosses the idle day; a reading outside all slots carries nothing
    assert rows["A", day3 + 3600].price == 12.0
    assert rows["B", day1].price is None and rows["B", day1].is_missing
    missing = sets(gridfill.missing_slots(raw, grid), "symbol", "slot_start")
    assert missing == sorted(k for k, r in rows.items() if r.is_missing)


def test_grid_empty(spark):
    none = delivery(spark, [])
    assert gridfill.missing_slots(none, spark.createDataFrame([("A", 600, 0, 3600)], GRID)).count() == 0
    assert gridfill.regularize(none, spark.createDataFrame([], GRID)).count() == 0


def test_grid_before_1970(spark, at):
    grid = spark.createDataFrame([("A", 43200, 0, 86400)], GRID)
    raw = delivery(spark, [(1, "a", "A", 1.0, 1, at("1969-12-31T13:00:00"), None)])
    assert sets(gridfill.missing_slots(raw, grid), "symbol", "slot_start") == [("A", -86400)]


# ---- 2: rolling totals ----------------------------------------------------------
def test_rolling_against_brute_force(spark):
    rng = random.Random(5)
    daily = {(e, d): round(rng.random(), 3) for e in "xy" for d in rng.sample(range(120), 25)}
    df = spark.createDataFrame([(e, d, v, 1) for (e, d), v in daily.items()], "entity string, day int, total double, active bigint")
    got = {(r.entity, r.day): r for r in rolling.rolling_totals(df, ["entity"]).collect()}
    for e in "xy":
        days = [d for k, d in daily if k == e]
        assert {d for k, d in got if k == e} == set(range(min(days), max(days) + 1))
        for d in range(min(days), max(days) + 1):
            r = got[e, d]
            assert r.total == pytest.approx(daily.get((e, d), 0.0))
            assert r.active == ((e, d) in daily)
            for n in (7, 30):
                want = sum(daily.get((e, x), 0.0) for x in range(d - n + 1, d + 1))
                assert r[f"total_{n}"] == pytest.approx(want) and r[f"average_{n}"] == pytest.approx(want / n)


def test_rolling_versions_and_nulls(spark, at):
    rows = spark.createDataFrame(
        [
            ("A", at("2024-01-01T00:01:00"), at("2024-01-01T00:02:00"), None, 1.0),
            ("A", at("2024-01-01T00:01:00"), at("2024-01-01T00:03:00"), None, None),  # the later version has no value
            ("A", at("2024-01-02T00:01:00"), None, None, 5.0),
            ("A", at("2024-01-02T00:01:00"), at("2024-01-01T00:00:00"), None, 2.0),
            ("A", at("2024-01-03T00:01:00"), at("2024-01-03T00:00:00"), None, float("nan")),
        ],
        "symbol string, ts_event timestamp, ts_ingest timestamp, loaded_at timestamp, v double",
    )
    now = rolling.current_rows(rows, ["symbol", "ts_event"], ["ts_ingest", "loaded_at"], "v").withColumn("day", rolling.day_number(F.col("ts_event")))
    daily = rolling.daily_totals(now, ["symbol"])
    assert sets(daily, "symbol", "total", "active") == [("A", 2.0, 1)]
    assert rolling.rolling_totals(daily.where("false"), ["symbol"]).count() == 0


# ---- 3: profiles ----------------------------------------------------------------
METRIC = "metric_id bigint, batch_id string, null_rates_by_name string, missing_required_fields_by_name string, invalid_values_by_name string"
BASE = [("event_id", 0.001, None), ("symbol", 0.001, None), ("price", 0.004, 1.9), ("volume", 0.006, 3.0), ("ts_event", 0.0015, None), ("ts_ingest", 0.002, None), ("source", 0.005, None)]


def loads(spark, at):
    rng = random.Random(1)
    rows, n = [], 0
    for load in range(8):
        for _ in range(150):
            n += 1
            price = 10 ** rng.gauss(1.9, 0.2)
            if load == 3:
                price *= 10
            if load == 5 and rng.random() < 0.1:
                price = None
            rows.append((n, f"e{n}", "A", price, int(10 ** rng.gauss(3, 0.2)), at("2024-01-01T00:00:00"), at("2024-01-01T00:00:01"), " " if load == 2 and n % 50 == 0 else "s", f"L{load}", None, 1, 2))
    return spark.createDataFrame(rows, DELIVERY)


def test_profile_findings(spark, at):
    rows = loads(spark, at)
    nulls = rows.where("batch_id = 'L5' and price is null").count()
    zero = '{"event_id": 0}'
    good5 = f'{{" PRICE ": "{nulls / 150}"}}'
    metrics = spark.createDataFrame(
        [(1, "L0", zero, zero, zero), (2, "L1", '{"price": 0.5}', "", "n/a"), (3, "L2", None, zero, "[]"), (4, "L3", zero, zero, '{"price": 1}'), (5, "L5", good5, zero, zero), (5, "L5", good5, zero, zero), (6, "none", zero, zero, zero)],
        METRIC,
    )
    found = sets(drift.findings(metrics, rows, spark.createDataFrame(BASE, "field string, usual_null_rate double, usual_log10_mean double")), "metric_id", "field", "finding")
    assert found == [(2, "price", "null_rate_wrong"), (3, "source", "missing_wrong"), (4, "price", "invalid_wrong"), (4, "price", "level_shift"), (5, "price", "null_rate_shift")]


def test_classifier_names_the_changed_column(spark, at):
    tests = {(r.load, r.field): r for r in drift.load_discrimination(drift.cells(loads(spark, at))).collect()}
    alike = max(tests[f"L{i}", "price"].discrimination for i in (0, 1, 4, 6, 7))
    assert tests["L3", "price"].discrimination > 5 * alike
    assert max(drift.FIELDS, key=lambda f: tests["L3", f].level_ablation) == "price" and tests["L3", "price"].level_ablation > drift.NOMINATE_LEVEL
    assert max(drift.FIELDS, key=lambda f: tests["L5", f].null_ablation) == "price" and tests["L5", "price"].null_ablation > 0.01


def test_the_classifier_decides_and_loses_no_change(spark, at):
    """Every change that the rules confirm on given data is one that the classifier names; without it there are none."""
    from tidegrid.sources.tables import table

    folder = "/root/testdata/sf0.01"
    profile = drift.profile_loads(table(spark, folder, "market_events_raw"), table(spark, folder, "field_baseline")).cache()
    every = profile.withColumn("by_classifier", F.lit(True))
    assert sets(drift.changes(profile), "load", "field", "finding") == sets(drift.changes(every), "load", "field", "finding") != []
    assert drift.changes(profile.withColumn("by_classifier", F.lit(False)).withColumn("untested", F.lit(False))).count() == 0
    named, all_columns = profile.where("by_classifier").count(), profile.count()
    assert named < all_columns / 3
    profile.unpersist()


def test_cells_give_the_exact_figures(spark, at):
    rows = loads(spark, at)
    of_cells = {(r.load, r.field): r for r in drift.cell_profile(drift.cells(rows)).collect()}
    for r in drift.base_profile(rows).collect():
        cell = of_cells[r.load, r.field]
        assert (r.rows, r.nulls, r.blanks, r.invalid) == (cell.rows, cell.nulls, cell.blanks, cell.invalid)
        assert r.level_mean is None and cell.level_mean is None or abs(r.level_mean - cell.level_mean) < 1e-9


def test_small_loads_are_left_to_the_rules(spark, at):
    few = loads(spark, at).where("delivery_id % 10 = 0")
    base = spark.createDataFrame(BASE, "field string, usual_null_rate double, usual_log10_mean double")
    profile = drift.profile_loads(few, base)
    assert profile.where("untested").count() == profile.count()
    assert ("L3", "price", "level_shift") in sets(drift.changes(profile), "load", "field", "finding")


def test_profile_of_nothing(spark):
    none = spark.createDataFrame([], DELIVERY)
    base = spark.createDataFrame(BASE, "field string, usual_null_rate double, usual_log10_mean double")
    assert drift.findings(spark.createDataFrame([(1, "L", "{}", "{}", "{}")], METRIC), none, base).count() == 0
    assert drift.distinct_values(none).count() == 0


# ---- 4: redelivery --------------------------------------------------------------
def brute_surplus(rows):
    groups = {}
    for d, e, *_, ts in rows:
        key = (e or "").strip(" \t").lower()
        if key:
            groups.setdefault(key, []).append((ts is None, ts.timestamp() if ts else 0, d))
    return sorted((k, d) for k, g in groups.items() for _, _, d in sorted(g)[1:])


def test_redelivery_against_brute_force(spark, at):
    rng = random.Random(2)
    rows = []
    for d in range(3000):
        e = rng.choice([f"E{rng.randrange(2500)}", f" e{rng.randrange(60)}\t", "HOT", None, "  "])
        day = rng.randrange(1, 29)
        ts = None if rng.random() < 0.03 else at(f"2024-0{rng.randrange(1, 7)}-{day:02d}T00:00:{rng.randrange(60):02d}")
        rows.append((d, e, "A", 1.0, 1, None, ts))
    df = delivery(spark, rows)
    want = brute_surplus([(r[0], r[1], r[6]) for r in rows])
    assert sets(redelivery.surplus(df), "event_id", "delivery_id") == want
    kept = redelivery.keep_one(df)
    assert kept.columns == [df.columns[0], *df.columns[1:]] and kept.count() == len(rows) - len(want)


def test_redelivery_empty(spark):
    assert redelivery.surplus(delivery(spark, [])).count() == 0


# ---- 5: orphans -----------------------------------------------------------------
def test_orphans(spark, at):
    t1, t2, t3 = at("2024-01-01T00:00:00"), at("2024-01-02T00:00:00"), at("2024-02-03T00:00:00")
    parents = spark.createDataFrame([("P1", t1), ("p2", t3), ("p2", t3), ("p3", t3), ("p3", None), ("p4", t1), (None, t1)], "calculation_id string, ts_ingest timestamp")
    text = '{"a": "p1", "b": " P2 ", "c": "p3", "d": "p4", "e": "gone", "f": null, "g": "  ", "h": "nope"}'
    child = spark.createDataFrame([("r1", t2, t2, text), ("r1", t2, t2, text), ("r2", None, None, '{"a": "p2", "b": "gone"}'), ("r3", t2, t2, '{"a": "p1"'), ("r4", t2, t2, "[]"), ("r5", t2, t2, None), ("r6", t2, t2, '{"a": "gone"} x'), ("r7", t2, t2, '{"a": "gone", "a": "p1"}'), ("r8", t2, t2, '"text"')], "calculation_id string, ts_event timestamp, ts_ingest timestamp, ids string")
    gone = spark.createDataFrame([("P4", "t", t1), ("gone", "t", t3), ("gone", "other", t1)], "calculation_id string, table_name string, deleted_at timestamp")
    refs = [orphans.Reference("c", child, "calculation_id", orphans.json_object_values("ids"), "t", parents)]
    got = sets(orphans.orphan_references(refs, gone).na.fill("-"), "period", "record_id", "missing_id", "state")
    assert got == [("-", "r2", "gone", "missing"), ("2024-01", "r1", "gone", "missing"), ("2024-01", "r1", "nope", "missing"), ("2024-01", "r1", "p2", "late"), ("2024-01", "r1", "p4", "deleted")]
    assert orphans.orphan_references([orphans.Reference("c", child.where("false"), "calculation_id", orphans.json_object_values("ids"), "t", parents)], gone).count() == 0
    alone = [orphans.Reference("c", child.limit(1), "calculation_id", orphans.json_object_values("ids"), "t", parents.where("false"))]
    assert {r.state for r in orphans.orphan_references(alone, gone.where("false")).collect()} == {"missing"}


# ---- 6: late events -------------------------------------------------------------
def late_rows(at):
    return [
        (1, "a", "A", 10.0, 1, at("2024-01-01T00:10:00"), at("2024-01-01T00:11:00")),
        (2, "b", "A", 12.0, 2, at("2024-01-01T00:20:00"), at("2024-01-01T01:05:00")),  # just in time
        (3, "c", "a ", 11.0, 3, at("2024-01-01T00:05:00"), at("2024-01-01T01:05:00.000001")),
        (4, "d", "A", 99.0, 4, at("2024-01-01T00:06:00"), at("2024-01-02T01:00:00.000001")),
        (5, "e", "A", 13.0, None, at("2024-01-01T02:06:00"), at("2024-01-02T02:06:00")),
        (6, "f", " ", 13.0, 1, at("2024-01-01T02:06:00"), at("2024-01-02T02:06:00")),
        (7, "g", "A", None, 1, None, None),
    ]


def test_late_events(spark, at):
    windows = lateness.compose(lateness.panes(lateness.usable(delivery(spark, late_rows(at)))))
    t0 = int(at("2024-01-01T00:00:00").timestamp())
    assert sets(lateness.outcomes(windows), "hour_start", "outcome") == [(t0, "corrected"), (t0, "rejected"), (t0 + 7200, "corrected")]
    rows = {(r.window_start, r.revision): r for r in lateness.emissions(windows).collect()}
    assert set(rows) == {(t0, 0), (t0, 1), (t0 + 7200, 1)}
    assert (rows[t0, 0].events, rows[t0, 0].average_price, rows[t0, 0].open_price) == (2, 11.0, 10.0)
    assert (rows[t0, 1].events, rows[t0, 1].average_price, rows[t0, 1].open_price, rows[t0, 1].rejected) == (3, 11.0, 11.0, 1)


def test_sliding_windows_share_panes(spark, at):
    """Against brute force: every event is judged against the end of each window that covers it."""
    hour, rows = lateness.HOUR, late_rows(at)
    parts = lateness.panes(lateness.usable(delivery(spark, rows)), window_seconds=3 * hour)
    wide = lateness.compose(parts, window_seconds=3 * hour).collect()
    want: dict[int, list[int]] = {}
    for r in lateness.usable(delivery(spark, rows)).collect():
        for k in range(3):
            start = (r.event_us // 10**6 // hour - k) * hour
            after = r.ingest_us - (start + 3 * hour) * 10**6
            kind = 0 if after <= lateness.PUBLISH_AFTER * 10**6 else 1 if after <= lateness.CUT_OFF * 10**6 else 2
            want.setdefault(start, [0, 0, 0])[kind] += 1
    assert {r.window_start: [r.events_published, r.corrections, r.rejected] for r in wide} == want
    assert all(r.events_final == r.events_published + r.corrections for r in wide)


def test_an_event_late_for_its_pane_is_in_time_for_a_window_that_ends_later(spark, at):
    rows = [(1, "a", "A", 10.0, 1, at("2024-01-01T00:10:00"), at("2024-01-01T01:30:00")), (2, "b", "A", 12.0, 1, at("2024-01-01T00:20:00"), at("2024-01-02T02:00:00"))]
    parts = lateness.panes(lateness.usable(delivery(spark, rows)), window_seconds=3 * lateness.HOUR)
    got = {r.window_start: (r.events_published, r.corrections, r.rejected) for r in lateness.compose(parts, window_seconds=3 * lateness.HOUR).collect()}
    t0 = int(at("2024-01-01T00:00:00").timestamp())
    # published 300 s after the end of the window, cut off a day after it
    assert got == {t0 - 7200: (0, 1, 1), t0 - 3600: (1, 1, 0), t0: (1, 1, 0)}


def test_extreme_figures(spark, at):
    big = (1 << 63) - 1
    rows = delivery(spark, [(i, f"e{i}", "A", float("inf"), big, at("2024-01-01T00:10:00"), at("2024-01-01T00:11:00")) for i in range(3)])
    window = lateness.compose(lateness.panes(lateness.usable(rows))).first()
    assert window.events_final == 3 and window.volume_final is None
    assert {r.field for r in drift.load_discrimination(drift.cells(rows)).collect()} == set(drift.FIELDS)
    assert gridfill.regularize(rows, spark.createDataFrame([("A", 600, 0, 3600)], GRID)).where("not is_missing").first().price == float("inf")
