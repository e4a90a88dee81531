"""The scan benchmark: one filtered aggregate over CSV and over Parquet partitioned by symbol and day."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources.stores import scan_benchmark, synthetic_events


def files_size(spark: SparkSession, path: str) -> int:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()


def run_io_benchmark(spark: SparkSession, folder: str, rows: int = 50_000, symbols: int = 20, days: int = 10, repetitions: int = 3) -> dict[str, float]:
    """Write both layouts under ``folder`` and time the same query on each; medians in milliseconds.

    Both answers must agree. Partition pruning leaves one directory of the Parquet
    layout to read; the CSV is read with an explicit schema.
    """
    events = synthetic_events(spark, rows, symbols, days)
    events.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    events.repartition("symbol", "trade_date").write.mode("overwrite").partitionBy("symbol", "trade_date").parquet(f"{folder}/parquet")
    day = events.agg(F.min("trade_date")).first()[0]
    # both are opened once, as tables of a catalogue are: files are listed and partitions found outside the timing
    csv = spark.read.schema(events.schema).csv(f"{folder}/csv", header=True)
    parquet = spark.read.schema(events.schema).parquet(f"{folder}/parquet")

    def timed(opened: DataFrame) -> tuple[float, tuple]:
        seconds, answer = [], None
        for _ in range(repetitions):
            t0 = time.perf_counter()
            row = scan_benchmark(opened, "SYM000", day).first()
            seconds.append(time.perf_counter() - t0)
            answer = (row.rows, round(row.average_price, 9), row.volume)
        return statistics.median(seconds) * 1000, answer

    (csv_ms, a), (parquet_ms, b) = timed(csv), timed(parquet)
    if a != b:
        raise AssertionError(f"the layouts disagree: {a} and {b}")
    return {"csv_ms": round(csv_ms, 1), "parquet_ms": round(parquet_ms, 1), "parquet_speedup_ratio": round(csv_ms / parquet_ms, 3), "parquet_storage_reduction_ratio": round(1 - files_size(spark, f"{folder}/parquet") / files_size(spark, f"{folder}/csv"), 3)}
