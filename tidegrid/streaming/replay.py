"""Replay and ingestion: exactly-once appends from a stream, and hourly backfills that resume."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegrid.sources.stores import append_raw, exists, hour_partition, read_text, write_text


def ingest(events: DataFrame, path: str, schema: T.StructType, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the immutable raw store; the first copy of an id wins over all batches.

    At-least-once delivery becomes exactly-once, as a batch only appends ids the
    store does not hold; unlike a watermark this has no horizon.
    """
    return events.writeStream.foreachBatch(lambda batch, _: append_raw(batch, path, schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_duplicates_dropped(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """A stream without repetitions that come within the horizon of ts_event; bounded state."""
    return events.withWatermark("ts_event", horizon).dropDuplicatesWithinWatermark(["event_id"])


def minute_eligible(events: DataFrame, daily_source: str, daily_prefix: str) -> DataFrame:
    """The events that minute figures are replayed from: none of the daily source, and none with its prefix of event ids."""
    return events.where(~F.coalesce(F.col("source") == daily_source, F.lit(False)) & ~F.coalesce(F.startswith("event_id", F.lit(daily_prefix)), F.lit(False)))


def backfill(spark: SparkSession, path: str, start: datetime, end: datetime, run: Callable[[DataFrame, datetime], int], checkpoint: str) -> dict[str, int]:
    """Run ``run`` for each hour of [start, end) that has a partition; hours done before are skipped.

    The checkpoint, a file of the shared store like the data, records each hour
    after its run. If a run was lost while it was written, the new file counts.
    """
    told = read_text(spark, checkpoint) or read_text(spark, checkpoint + ".new")
    done: dict[str, int] = json.loads(told) if told else {}
    hour = start.replace(minute=0, second=0, microsecond=0)
    while hour < end:
        name, parts = hour.isoformat(), (f"{hour:%Y}", f"{hour:%m}", f"{hour:%d}", f"{hour:%H}")
        if name not in done and exists(spark, f"{path}/year={parts[0]}/month={parts[1]}/day={parts[2]}/hour={parts[3]}"):
            done[name] = run(hour_partition(spark, path, *parts), hour)
            write_text(spark, checkpoint, json.dumps(done, sort_keys=True))
        hour += timedelta(hours=1)
    return done
