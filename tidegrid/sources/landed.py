"""Landed files: CSV, JSON arrays and JSON lines with varying field names -> typed rows.

Field names are normalised (trimmed, lower case, blanks and dashes as
underscores) and resolved by aliases; the first alias with a value wins, row by
row. Rows that cannot be completed come out separately with what is wrong.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.ids import canonical
from tidegrid.functions.text import signal_name, symbol_key

#: Names under which a field may arrive.
EVENT_ALIASES: Mapping[str, Sequence[str]] = {
    "event_id": ("event_id", "id"),
    "symbol": ("symbol", "ticker", "instrument"),
    "price": ("price", "close", "last", "last_price"),
    "volume": ("volume", "trade_volume"),
    "ts_event": ("ts_event", "event_time", "timestamp", "datetime", "date"),
    "ts_ingest": ("ts_ingest", "ingest_time", "ingested_at"),
    "source": ("source", "provider"),
}
SIGNAL_ALIASES: Mapping[str, Sequence[str]] = {
    "signal_id": ("signal_id", "event_id", "id"),
    "name": ("name", "signal", "indicator", "metric"),
    "value": ("value", "reading", "level", "score"),
    "ts_event": ("ts_event", "event_time", "timestamp", "datetime", "date"),
    "ts_ingest": ("ts_ingest", "ingest_time", "ingested_at"),
    "source": ("source", "provider"),
}

EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.LongType()), T.StructField("ts_event", T.TimestampType()), T.StructField("ts_ingest", T.TimestampType()), T.StructField("source", T.StringType())])


class UnsupportedFormat(ValueError):
    """A landed file has a suffix that no reader handles."""


def normal_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a landed file as strings, by its suffix: .csv, .json (array or object), .jsonl, .ndjson."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        df = spark.read.csv(path, header=True, mode="FAILFAST")
    elif suffix in ("json", "jsonl", "ndjson"):
        df = spark.read.json(path, multiLine=suffix == "json", primitivesAsString=True, mode="FAILFAST")
    else:
        raise UnsupportedFormat(f"no reader for .{suffix}")
    return df.toDF(*(normal_name(c) for c in df.columns))


def resolve(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """One string column per field: the first alias that is there and not blank."""
    def pick(names: Sequence[str]) -> Column:
        have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    return df.select(*(pick(names).alias(field) for field, names in aliases.items()))


def instant(text: Column) -> Column:
    """ISO-8601 text (Z, offsets, or none, taken as UTC) or DD/MM/YYYY as a timestamp; null if neither."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))


def market_events(df: DataFrame, default_source: str, ingested_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejected): typed market events, and the rows that lack a required field with ``problems``.

    A missing ts_ingest is ``ingested_at`` (now, if not given), a missing source
    the default; a missing event_id is derived from the content.
    """
    raw = resolve(df, EVENT_ALIASES)
    whole = F.col("volume").try_cast("decimal(38,6)")
    typed = raw.select(
        "event_id",
        symbol_key(F.col("symbol")).alias("symbol"),
        F.col("price").try_cast("double").alias("price"),
        F.when(whole == F.floor(whole), whole.try_cast("bigint")).alias("volume"),
        instant(F.col("ts_event")).alias("ts_event"),
        F.coalesce(instant(F.col("ts_ingest")), ingested_at if ingested_at is not None else F.current_timestamp()).alias("ts_ingest"),
        F.coalesce("source", F.lit(default_source)).alias("source"),
    )
    need = ("symbol", "price", "volume", "ts_event")
    typed = typed.withColumn("problems", F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in need))))
    stamp = F.date_format("ts_event", "yyyy-MM-dd'T'HH:mm:ssXXX")
    derived = F.concat(F.lit("market-"), F.substring(F.sha2(canonical(price=F.col("price"), source=F.col("source"), symbol=F.col("symbol"), ts_event=F.regexp_replace(stamp, "Z$", "+00:00"), volume=F.col("volume")), 256), 1, 16))
    good = typed.where(F.size("problems") == 0).withColumn("event_id", F.coalesce("event_id", derived)).drop("problems")
    return good, typed.where(F.size("problems") > 0)


def signals(df: DataFrame, default_source: str, ingested_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, rejected): external readings with normalised names; ids derived where missing."""
    raw = resolve(df, SIGNAL_ALIASES)
    typed = raw.select(
        "signal_id",
        signal_name(F.col("name")).alias("name"),
        F.col("value").try_cast("double").alias("value"),
        instant(F.col("ts_event")).alias("ts_event"),
        F.coalesce(instant(F.col("ts_ingest")), ingested_at if ingested_at is not None else F.current_timestamp()).alias("ts_ingest"),
        F.coalesce("source", F.lit(default_source)).alias("source"),
    )
    typed = typed.withColumn("problems", F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("name", "value", "ts_event")))))
    stamp = F.regexp_replace(F.date_format("ts_event", "yyyy-MM-dd'T'HH:mm:ssXXX"), "Z$", "+00:00")
    derived = F.concat(F.lit("signal-"), F.substring(F.sha2(canonical(name=F.col("name"), source=F.col("source"), ts_event=stamp, value=F.col("value")), 256), 1, 16))
    good = typed.where(F.size("problems") == 0).withColumn("signal_id", F.coalesce("signal_id", derived)).drop("problems")
    return good, typed.where(F.size("problems") > 0)


def event_row(spark: SparkSession, symbol: str, price: float, volume: int, event_id: str, source: str = "manual") -> DataFrame:
    """A single event of this moment."""
    one = spark.createDataFrame([(event_id, symbol, float(price), int(volume), source)], "event_id string, symbol string, price double, volume bigint, source string")
    return one.select("event_id", symbol_key(F.col("symbol")).alias("symbol"), "price", "volume", F.current_timestamp().alias("ts_event"), F.current_timestamp().alias("ts_ingest"), "source")


def nested_documents(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Nested source documents flattened: output column -> path in the document (``a.b.c``); absent paths are null."""
    def path(p: str) -> Column:
        kind: T.DataType = df.schema
        for part in p.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                return F.lit(None).cast("string")
            kind = kind[part].dataType
        return F.col(p)

    return df.select(*(path(p).alias(out) for out, p in mapping.items()))
