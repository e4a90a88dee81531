"""Daily closes and their risk figures: returns, annualised volatility, historical value at risk, drawdown."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.ids import content_id
from tidegrid.operators.quality import QualityError

#: The version and the number of trading days of a year.
MODEL_VERSION = "daily-risk-v2"
TRADING_DAYS = 252


def daily_closes(events: DataFrame, key: Sequence[str] = ("source", "symbol")) -> DataFrame:
    """The last event of each key and UTC day by (ts_event, event_id): (key, day, price, event_id, ts_ingest).

    Reduced with map-side combine; afterwards a key has one row per day.
    """
    last = F.max(F.struct("ts_event", "event_id", "price", "ts_ingest")).alias("_c")
    closes = events.groupBy(*key, F.to_date("ts_event").alias("day")).agg(last)
    return closes.select(*key, "day", F.col("_c.price").alias("price"), F.col("_c.event_id").alias("event_id"), F.col("_c.ts_ingest").alias("ts_ingest"))


def event_problems(events: DataFrame) -> DataFrame:
    """(problem, rows): what keeps events from being daily closes; no rows if nothing does.

    Stamps must be UTC midnight, identity fields not blank, prices finite and above 0,
    volumes not below 0, identifiers unique, and a source has one close per symbol
    and day.
    """
    c = F.col
    blank = F.coalesce(F.trim("event_id") == "", F.lit(True)) | F.coalesce(F.trim("symbol") == "", F.lit(True)) | F.coalesce(F.trim("source") == "", F.lit(True))
    rules = {
        "not_midnight": ~F.coalesce(F.unix_micros("ts_event") % 86_400_000_000 == 0, F.lit(False)),
        "blank_identity": blank,
        "price_not_positive": ~F.coalesce((c("price") > 0) & (c("price") < float("inf")) & ~F.isnan("price"), F.lit(False)),
        "volume_negative": F.coalesce(c("volume") < 0, F.lit(True)),
    }
    rows = events.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))
    twice = lambda name, *key: events.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias(name))
    both = [rows.select(F.lit(name).alias("problem"), F.col(name).alias("rows")) for name in rules]
    both += [twice(name, *key).select(F.lit(name).alias("problem"), F.col(name).alias("rows")) for name, key in {"repeated_event_id": ["event_id"], "more_than_one_close": ["source", "symbol", F.to_date("ts_event")]}.items()]
    out = both[0]
    for part in both[1:]:
        out = out.unionByName(part)
    return out.where("rows > 0")


def validated(events: DataFrame, end: date | None = None) -> DataFrame:
    """``events`` up to ``end``, if they are daily closes; else QualityError with the problems."""
    known = events.where(F.to_date("ts_event") <= F.lit(end)) if end else events
    problems = {r.problem: r.rows for r in event_problems(known).collect()}  # a row per rule
    if problems:
        raise QualityError(f"not daily closes: {problems}")
    if known.limit(2).count() < 2:
        raise QualityError("daily risk needs at least two observations")
    return known


def daily_risk(closes: DataFrame, key: Sequence[str] = ("source", "symbol"), volatility_window: int = 20, var_window: int = 252, confidence: float = 0.95) -> DataFrame:
    """One row per close but the first of its key.

    volatility_annualized needs a full window of returns, historical_var_loss two
    returns of the last var_window; maximum_drawdown is the worst so far (0 or
    less). history_status is ready once both windows are full. Identifiers cover
    the events that enter a figure; that of the summary covers the whole history
    by its ends, its length and the combined hash of its events.
    """
    line = Window.partitionBy(*key).orderBy("day")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    vol, var = line.rowsBetween(-(volatility_window - 1), 0), line.rowsBetween(-(var_window - 1), 0)
    rows = closes.withColumn("return_1d", F.col("price") / F.lag("price").over(line) - 1).withColumn("previous_event_id", F.lag("event_id").over(line))
    rows = rows.withColumn("_previous_ingest", F.lag("ts_ingest").over(line))
    full = F.count("return_1d").over(vol) == volatility_window
    loss = F.greatest(F.lit(0.0), -F.percentile("return_1d", F.lit(1 - confidence)).over(var))
    rows = (
        rows.withColumn("price_observations", F.row_number().over(line).cast("bigint"))
        .withColumn("volatility_annualized", F.when(full, F.stddev_samp("return_1d").over(vol) * math.sqrt(TRADING_DAYS)))
        .withColumn("var_observations", F.count("return_1d").over(var))
        .withColumn("historical_var_loss", F.when(F.col("var_observations") >= 2, loss))
        .withColumn("_drawdown", F.col("price") / F.max("price").over(so_far) - 1)
        .withColumn("maximum_drawdown", F.min("_drawdown").over(so_far))
        .withColumn("volatility_events", F.collect_list("event_id").over(line.rowsBetween(-volatility_window, 0)))
        .withColumn("history_ingest", F.max("ts_ingest").over(so_far))
        .withColumn("first_event_id", F.first("event_id").over(so_far))
        .withColumn("history_hash", F.hex(F.bit_xor(F.xxhash64("event_id")).over(so_far)))
    )
    empty = F.create_map().cast("map<string,string>")
    version = F.lit(MODEL_VERSION)
    return (
        rows.withColumn("return_observations", F.col("price_observations") - 1)
        .withColumn("history_status", F.when(F.col("return_observations") >= max(volatility_window, var_window), "ready").otherwise("partial"))
        .where("return_observations > 0")
        .withColumn("return_id", content_id(f"{MODEL_VERSION}-return-", event_ids=F.array("previous_event_id", "event_id"), metric=F.lit("return"), model_version=version, parameters=empty))
        .withColumn(
            "volatility_id",
            F.when(
                F.col("volatility_annualized").isNotNull(),
                content_id(f"{MODEL_VERSION}-volatility-", event_ids=F.col("volatility_events"), metric=F.lit("volatility"), model_version=version, parameters=F.struct(F.lit(TRADING_DAYS).alias("annualization_days"), F.lit(volatility_window).alias("window"))),
            ),
        )
        .withColumn("summary_id", content_id(f"{MODEL_VERSION}-summary-", first=F.col("first_event_id"), last=F.col("event_id"), events=F.col("price_observations"), history=F.col("history_hash"), windows=F.array(F.lit(volatility_window), F.lit(var_window)), confidence=F.lit(confidence)))
        .withColumn("return_ingest", F.greatest("ts_ingest", "_previous_ingest"))
        .drop("_drawdown", "_previous_ingest", "volatility_events", "history_hash")
    )
