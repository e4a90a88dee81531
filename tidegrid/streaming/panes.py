"""Late events as a stream: panes are kept in the state store, changed windows are emitted again.

The stream is sliced into panes of the windows' step. Spark keeps the panes'
partial aggregates in update mode, so each micro-batch yields only the panes that
changed; ``foreachBatch`` writes those and composes again only the windows that
cover them. Of the pane store a batch reads only the days these windows lie in,
and of these only their panes. Events past the cut-off change no window: their
lateness is a property of the row (ts_ingest against the window's end), so the
result does not depend on how the stream is cut into batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.functions.times import floor_div
from tidegrid.operators.lateness import CUT_OFF, HOUR, PANE, PUBLISH_AFTER, compose, in_panes, partials, usable
from tidegrid.operators.versions import latest_by


def changed_panes(events: DataFrame, pane_seconds: int = HOUR, window_seconds: int = HOUR, publish_after: int = PUBLISH_AFTER, cut_off: int = CUT_OFF) -> DataFrame:
    """Streaming aggregate of the panes; in update mode a batch yields the panes it changed."""
    return in_panes(events, pane_seconds, window_seconds, publish_after, cut_off).groupBy(*PANE).agg(*partials())


def run_panes(deliveries: DataFrame, store: str, checkpoint: str, pane_seconds: int = HOUR, window_seconds: int = HOUR, available_now: bool = True) -> StreamingQuery:
    """Start the stream: ``store``/panes holds pane versions by batch and day, ``store``/windows the emissions by batch.

    A batch that is run again replaces its own output, so the sinks are exact. State
    is kept without a horizon, as corrections count up to the cut-off of any window
    whenever the stream delivers them; ``compact`` drops replaced pane versions.
    """
    steps = window_seconds // pane_seconds

    def emit(panes: DataFrame, batch: int) -> None:
        spark = panes.sparkSession
        home = f"{store}/panes/batch={batch:09d}"
        panes.withColumn("day", _day(F.col("pane_start"))).write.mode("overwrite").partitionBy("day").parquet(home)
        if not panes.limit(1).count():
            return
        mine = spark.read.parquet(home)
        around = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: c - i * pane_seconds))
        touched = mine.select("symbol", around(F.col("pane_start")).alias("window_start")).distinct()
        # the panes of the touched windows: a window holds the panes from its start on
        needed = touched.select("symbol", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("window_start") + i * pane_seconds)).alias("pane_start")).distinct()
        lo, hi = needed.agg(_day(F.min("pane_start")), _day(F.max("pane_start"))).first()
        known = _versions(spark, store, batch).where(F.col("day").between(lo, hi)).join(needed, ["symbol", "pane_start"], "left_semi")
        composed = compose(_newest(known), pane_seconds, window_seconds).join(touched, ["symbol", "window_start"], "left_semi")
        composed.write.mode("overwrite").parquet(f"{store}/windows/batch={batch:09d}")

    writer = changed_panes(usable(deliveries), pane_seconds, window_seconds).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(emit)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def _day(seconds: Column) -> Column:
    return floor_div(seconds, 86_400)


def _versions(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    versions = spark.read.option("basePath", f"{store}/panes").parquet(f"{store}/panes").withColumn("batch", F.col("batch").cast("bigint"))
    return versions.where(F.col("batch") <= upto) if upto is not None else versions


def _newest(versions: DataFrame) -> DataFrame:
    return latest_by(versions, list(PANE), ["batch"]).drop("batch", "day")


def current_panes(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """The newest version of every pane."""
    return _newest(_versions(spark, store, upto))


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write the newest version of every pane to ``target`` as batch 0 of a new store; between runs of the stream."""
    current_panes(spark, store).withColumn("day", _day(F.col("pane_start"))).write.mode("overwrite").partitionBy("day").parquet(f"{target}/panes/batch={0:09d}")


def current_windows(spark: SparkSession, store: str) -> DataFrame:
    """The newest emission of every window."""
    versions = spark.read.option("basePath", f"{store}/windows").parquet(f"{store}/windows").withColumn("batch", F.col("batch").cast("bigint"))
    return latest_by(versions, ["symbol", "window_start"], ["batch"]).drop("batch")
