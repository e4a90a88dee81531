"""Daily bars of an HTTP provider: fetch with bounded retries, and parsing in Spark.

The transport is a function; nothing here opens a connection by itself, so the
parser and the retry rules work offline.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Statuses worth another attempt, and the prefixes of bar fields.
RETRYABLE = frozenset((408, 429, *range(500, 600)))
BAR = "struct<`1. open`:string,`2. high`:string,`3. low`:string,`4. close`:string,`5. volume`:string>"
SERIES_KEY = "Time Series (Daily)"


class ProviderError(RuntimeError):
    """The provider's answer is an error, or cannot be trusted."""


def fetch(transport: Callable[[], tuple[int, bytes]], retries: int = 3, pause: float = 0.25, most_bytes: int = 8 << 20, sleep: Callable[[float], None] = time.sleep, total_seconds: float = 60.0, clock: Callable[[], float] = time.monotonic) -> bytes:
    """The body of a successful answer; retryable statuses are tried again after pause * 2 ** n seconds.

    No attempt and no pause begins that would end past ``total_seconds`` from the start.
    """
    until = clock() + total_seconds
    for attempt in range(retries + 1):
        code, body = transport()
        if code == 200:
            if len(body) > most_bytes:
                raise ProviderError("the answer is too large")
            return body
        if code not in RETRYABLE or attempt == retries:
            raise ProviderError(f"the provider answered {code}")
        if clock() + pause * 2**attempt >= until:
            raise ProviderError(f"no answer within {total_seconds} seconds, the last was {code}")
        sleep(pause * 2**attempt)
    raise ProviderError("no attempt was made")


def parse_daily(spark: SparkSession, body: bytes, symbol: str, source: str, start: str | None = None, end: str | None = None, most: int = 100) -> DataFrame:
    """Bars as market events: the newest ``most`` within [start, end], ascending, the close as price.

    Rejected as a whole (ProviderError): text that is no JSON object or repeats a
    key, an error envelope, another symbol, an inconsistent bar.
    """
    text = body.decode()
    doc = spark.createDataFrame([(text,)], "body string").withColumn("v", F.try_parse_json("body"))
    doc = doc.withColumn("told", F.get_json_object("body", "$['Meta Data']['2. Symbol']")).withColumn("series", F.from_json(F.get_json_object("body", f"$['{SERIES_KEY}']"), f"map<string,{BAR}>"))
    head = doc.select(F.col("v").isNull().alias("bad"), "told", F.col("series").isNull().alias("none"), F.json_object_keys("body").alias("keys")).first()
    if head.bad:
        raise ProviderError("not JSON, or a key is repeated")
    if head.none:
        raise ProviderError("no daily series: " + ", ".join(head["keys"] or []))
    if (head.told or "").strip().upper() != symbol.strip().upper():
        raise ProviderError("the answer is about another symbol")
    bars = doc.select(F.explode("series").alias("day", "bar"))
    number = lambda i, n: F.col("bar").getField(f"{i}. {n}").try_cast("decimal(38,10)")
    rows = bars.select(F.col("day").try_cast("date").alias("day"), *(number(i, n).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)))
    wrong = F.col("day").isNull() | F.col("close").isNull() | (F.col("close") <= 0) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")) | (F.col("volume") < 0) | (F.col("volume") != F.floor("volume"))
    if rows.where(F.coalesce(wrong, F.lit(True))).limit(1).count():
        raise ProviderError("a bar is inconsistent")
    if start:
        rows = rows.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("day") <= F.lit(end).cast("date"))
    newest = rows.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("day").desc()))).where(F.col("_r") <= most)
    plain = F.concat_ws("|", F.lit(source), F.lit("TIME_SERIES_DAILY"), F.lit(symbol.strip().upper()), F.date_format("day", "yyyy-MM-dd"))
    return newest.orderBy("day").select(
        F.concat(F.lit("av-daily-"), F.substring(F.sha2(plain, 256), 1, 20)).alias("event_id"),
        F.lit(symbol.strip().upper()).alias("symbol"),
        F.col("close").cast("double").alias("price"),
        F.col("volume").cast("bigint").alias("volume"),
        F.to_timestamp("day").alias("ts_event"),
        F.current_timestamp().alias("ts_ingest"),
        F.lit(source).alias("source"),
    )
