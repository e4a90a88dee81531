"""Market events: normalisation, first arrival, returns, rolling volatility and value at risk per symbol."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.quantiles import exact_quantile
from tidegrid.functions.shards import with_context
from tidegrid.functions.text import id_key, is_number, signal_name, symbol_key
from tidegrid.functions.times import SECOND, floor_div
from tidegrid.operators.versions import first_by, latest_by

LATE_SECONDS = 300
BAR_MINUTES = 5
VOLATILITY_WINDOW = 5
CONFIDENCE = 0.95


def normalise(raw: DataFrame, late_seconds: int = LATE_SECONDS, bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """Valid events in canonical form; arrival order is kept in ``delivery_id``.

    Valid: event_id, symbol and source not blank, both times known, price finite
    and above 0, volume 0 or more. ``is_late``: ingested more than late_seconds
    after the event. ``window_start``: the start of the event's bar.
    """
    price = F.col("price")
    rows = raw.select(
        "delivery_id",
        id_key(F.col("event_id")).alias("event_id"),
        symbol_key(F.col("symbol")).alias("symbol"),
        "price",
        "volume",
        "ts_event",
        "ts_ingest",
        id_key(F.col("source")).alias("source"),
    ).where("event_id is not null and symbol is not null and source is not null and ts_event is not null and ts_ingest is not null and volume >= 0")
    rows = rows.where(is_number(price) & (price > 0) & (price < F.lit(math.inf)))
    bar = bar_minutes * 60
    return rows.withColumn("is_late", F.unix_micros("ts_ingest") - F.unix_micros("ts_event") > late_seconds * 1_000_000).withColumn(
        "window_start", F.timestamp_seconds(floor_div(F.unix_micros("ts_event"), bar * SECOND) * bar)
    )


def first_arrivals(events: DataFrame) -> DataFrame:
    """The first arrival of each event_id."""
    return first_by(events, ["event_id"], ["delivery_id"])


def earliest_ingested(events: DataFrame) -> DataFrame:
    """The earliest ingested copy of each event_id (the rule of the immutable raw store)."""
    return first_by(events, ["event_id"], ["ts_ingest", "delivery_id"])


def returns_and_volatility(events: DataFrame, window: int = VOLATILITY_WINDOW) -> DataFrame:
    """Observation-to-observation returns and the rolling sample deviation of the last ``window`` of them.

    One row per event but the first of its symbol, in the order (ts_event,
    event_id); volatility is null until the window is full. Symbols are cut into
    days with ``window`` rows of context, so a hot symbol is spread over its days.
    """
    rows = events.select("symbol", "ts_event", "event_id", "price", "ts_ingest", "window_start").withColumn("_day", F.to_date("ts_event"))
    sharded = with_context(rows, ["symbol"], "_day", ["ts_event", "event_id"], window, ["price"])
    line = Window.partitionBy("symbol", "_day").orderBy("ts_event", "event_id")
    back = sharded.withColumn("return_1m", F.col("price") / F.lag("price").over(line) - 1)
    frame = line.rowsBetween(-(window - 1), 0)
    full = F.count("return_1m").over(frame) == window
    rolled = back.withColumn("volatility_5m", F.when(full, F.stddev_samp("return_1m").over(frame)))
    return rolled.where(~F.col("_context") & F.col("return_1m").isNotNull()).select("symbol", "ts_event", "event_id", "window_start", "return_1m", "volatility_5m", "ts_ingest")


def value_at_risk(returns: DataFrame, key: list[str], confidence: float = CONFIDENCE, value: str = "return_1m") -> DataFrame:
    """(key, observations, value_at_risk): the signed (1 - confidence) quantile of all returns of a key."""
    return exact_quantile(returns, key, value, 1 - confidence, "value_at_risk").withColumnRenamed("n", "observations")


def threshold_status(value, warning: float, critical: float):
    """ok, warn or critical, thresholds included; no_data for null."""
    return F.when(value.isNull(), "no_data").when(value >= critical, "critical").when(value >= warning, "warn").otherwise("ok")


def risk_summary(moves: DataFrame, warning: float, critical: float, confidence: float = CONFIDENCE) -> DataFrame:
    """Per symbol: value at risk, the last volatility with its status, observations and freshness."""
    last = latest_by(moves.select("symbol", "ts_event", "event_id", "volatility_5m"), ["symbol"], ["ts_event", "event_id"])
    fresh = moves.groupBy("symbol").agg(F.max("ts_ingest").alias("ts_ingest"))
    out = value_at_risk(moves, ["symbol"], confidence).join(last.select("symbol", "volatility_5m"), "symbol").join(fresh, "symbol")
    return out.withColumn("volatility_status", threshold_status(F.col("volatility_5m"), warning, critical))


def lateness(events: DataFrame) -> DataFrame:
    """Per symbol: events, late events and late rate (late events are counted, never dropped)."""
    return events.groupBy("symbol").agg(F.count("*").alias("events"), F.count_if("is_late").alias("late_events")).withColumn("late_rate", F.col("late_events") / F.col("events"))


def latest_signals(signals: DataFrame) -> DataFrame:
    """The latest reading of each (name, source) by (ts_event, ts_ingest, signal_id); names normalised."""
    named = signals.withColumn("name", signal_name(F.col("name")))
    return latest_by(named, ["name", "source"], ["ts_event", "ts_ingest", "signal_id"])


def freshness(tables: dict[str, DataFrame], stamp: str = "ts_ingest") -> DataFrame:
    """(table_name, latest): the greatest stamp of each table; empty tables come first."""
    parts = None
    for name, df in tables.items():
        row = df.agg(F.max(stamp).alias("latest")).select(F.lit(name).alias("table_name"), "latest")
        parts = row if parts is None else parts.unionByName(row)
    return parts.orderBy(F.col("latest").asc_nulls_first(), "table_name")
