"""Stores: the immutable raw store, curated datasets, upserts, config and synthetic events.

All writes are idempotent: a repeated run appends nothing. Parquet is written
under partitions year/month/day/hour of ts_ingest by Spark's commit protocol.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.quality import QualityError
from tidegrid.operators.versions import conflicts, content_conflicts, first_by, latest_by, one_per, upsert
from tidegrid.session import bounded_broadcast, stage

HOUR = ("year", "month", "day", "hour")
CONTENT = ("symbol", "price", "volume", "ts_event", "source")


class ConflictError(QualityError):
    """An identifier that is stored already arrives with other content."""


def by_hour(df: DataFrame, stamp: str = "ts_ingest") -> DataFrame:
    """Adds the partition columns year, month, day and hour (UTC, zero-padded); rows without a stamp get nulls."""
    if clash := [c for c in HOUR if c in df.columns]:
        raise ValueError("columns named like partitions: " + ", ".join(clash))
    part = lambda p: F.date_format(stamp, p)
    return df.withColumns({"year": part("yyyy"), "month": part("MM"), "day": part("dd"), "hour": part("HH")})


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of the shared store; None if there is none."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if exists(spark, path) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file of the shared store; readers see the old or the new one."""
    fresh, jpath = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path + ".new", path))
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(jpath, False)
    fs.rename(fresh, jpath)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A dataset with an explicit schema: absent columns are null, an absent dataset is empty; NaN is read as null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double")) for f in schema if isinstance(f.dataType, T.DoubleType)})


def hour_partition(spark: SparkSession, path: str, year: str, month: str, day: str, hour: str) -> DataFrame:
    """Rows of one hour in the order of (ts_ingest, event_id); only its directory is read."""
    df = spark.read.option("basePath", path).parquet(f"{path}/year={year}/month={month}/day={day}/hour={hour}")
    return df.drop(*HOUR).orderBy("ts_ingest", "event_id")


class CapExceeded(ValueError):
    """More rows match than the caller allows; nothing is cut off."""


def capped(df: DataFrame, most: int) -> DataFrame:
    """``df``, if it has at most ``most`` rows; else CapExceeded. One row beyond the cap is looked for, not all counted."""
    if df.limit(most + 1).count() > most:
        raise CapExceeded(f"more than {most} rows")
    return df


def read_raw(spark: SparkSession, path: str, schema: T.StructType, source: str | None = None, symbol: str | None = None, end: Any = None, most: int | None = None) -> DataFrame:
    """Events of a raw store of one source and symbol up to the day ``end``; CapExceeded beyond ``most`` rows."""
    df = read_store(spark, path, schema)
    for column, value in (("source", source), ("symbol", symbol)):
        df = df.where(F.col(column) == value) if value is not None else df
    df = df.where(F.to_date("ts_event") <= F.lit(end)) if end is not None else df
    return capped(df, most) if most is not None else df


def append_raw(incoming: DataFrame, path: str, schema: T.StructType, key: str = "event_id", content: Sequence[str] = CONTENT) -> int:
    """Append unseen events to the immutable raw store; the number of rows written.

    Of copies within the batch the earliest ingested is kept. All or nothing: an
    event whose content differs within the batch or from the store raises
    ConflictError before anything is written.
    """
    spark = incoming.sparkSession
    batch = stage(incoming.select(*schema.fieldNames()), "raw-batch")
    # of the store only what the batch names; a batch of a checked size goes to the store's tasks, which then need no shuffle
    stored = read_store(spark, path, schema).join(bounded_broadcast(batch.select(key).distinct()), key, "left_semi")
    clash = content_conflicts(batch, key, content).select(key).unionByName(conflicts(batch, stored, key, content)).limit(5).collect()
    if clash:
        raise ConflictError("other content under known ids: " + ", ".join(str(r[0]) for r in clash))
    new = stage(first_by(batch, [key], ["ts_ingest"]).join(stored.select(key), key, "left_anti"), "raw-new")
    n = new.count()
    if n:
        by_hour(new).repartition(*HOUR).sortWithinPartitions(key).write.partitionBy(*HOUR).mode("append").parquet(path)
    return n


def append_curated(records: DataFrame, path: str, key: Sequence[str], stamp: str = "ts_ingest") -> int:
    """Append the records whose key is not in the dataset yet, by hour of ``stamp``; the number written."""
    spark = records.sparkSession
    stored = read_store(spark, path, by_hour(records, stamp).drop(*HOUR).schema)
    new = stage(one_per(records, key, (stamp,)).join(stored.select(*key), list(key), "left_anti"), "curated-new")
    n = new.count()
    if n:
        by_hour(new, stamp).repartition(*HOUR).write.partitionBy(*HOUR).mode("append").parquet(path)
    return n


def append_acknowledgements(new: DataFrame, path: str, key: Sequence[str] = ("calculation_id", "request_id"), content: Sequence[str] = ("acknowledged_by",)) -> int:
    """Append-only: a request repeated with the same content writes nothing, with other content raises ConflictError."""
    spark = new.sparkSession
    stored = read_store(spark, path, new.schema)
    changed = new.join(stored.select(*key, *(F.col(c).alias(f"_s_{c}") for c in content)), list(key))
    differs = F.lit(False)
    for c in content:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    if changed.where(differs).limit(1).count():
        raise ConflictError("a request is stored with other content")
    fresh = stage(one_per(new, key, ("acknowledged_at",)).join(stored.select(*key), list(key), "left_anti"), "acknowledgements")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version of a table next to the old one and make it current; readers never see a half-written table."""
    version = f"{path}/v{len(_versions(df.sparkSession, path)):06d}"
    df.write.mode("errorifexists").parquet(version)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{max(_versions(spark, path))}")


#: The key by which each dataset is loaded into its table.
LOAD_KEYS: Mapping[str, tuple[str, ...]] = {
    "market_events_raw": ("event_id",),
    "returns_1m": ("symbol", "ts_event"),
    "volatility_5m": ("symbol", "ts_event"),
    "data_quality_metrics": ("ts_ingest",),
    "risk_summary": ("symbol", "ts_ingest"),
    "external_signal_summary": ("name", "source", "latest_signal_id"),
    "daily_returns": ("calculation_id",),
    "daily_volatility": ("calculation_id",),
    "daily_risk_summary": ("calculation_id",),
    "portfolio_daily_returns": ("calculation_id",),
    "portfolio_daily_risk_summary": ("calculation_id",),
}


def load_tables(datasets: Mapping[str, DataFrame], folder: str, dry_run: bool = False) -> dict[str, int]:
    """Load each dataset into its table under ``folder`` by its key; the number of incoming rows by table.

    Rows of a known key are replaced, of rows of one key in the batch the last by
    ts_ingest counts; loaded_at is the time of the load. A dry run only counts.
    """
    if unknown := sorted(set(datasets) - set(LOAD_KEYS)):
        raise ValueError(f"no key for {unknown}")
    counts = {}
    for name, rows in datasets.items():
        key = LOAD_KEYS[name]
        once = stage(latest_by(rows, list(key), [c for c in ("ts_ingest",) if c in rows.columns] or list(key)), f"load-{name}")
        counts[name] = once.count()
        if not dry_run and counts[name]:
            path, incoming = f"{folder}/{name}", once.withColumn("loaded_at", F.current_timestamp())
            have = _versions(rows.sparkSession, path)
            replace_table(upsert(current_table(rows.sparkSession, path), incoming, key) if have else incoming, path)
    return counts


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a table (those with a success mark)."""
    if not exists(spark, path):
        return []
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def inventory_problems(spark: SparkSession, path: str, schema: T.StructType, key: str = "event_id") -> DataFrame:
    """(problem, rows) of a raw store: wrong partition, repeated id, missing required field."""
    df = spark.read.schema(T.StructType([*schema.fields, *(T.StructField(p, T.StringType()) for p in HOUR)])).parquet(path)
    expect = F.concat_ws("/", *(F.date_format("ts_ingest", p) for p in ("yyyy", "MM", "dd", "HH")))
    wrong = df.where(F.concat_ws("/", *HOUR) != expect).agg(F.count("*").alias("rows")).select(F.lit("wrong_partition").alias("problem"), "rows")
    twice = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("rows")).select(F.lit("repeated_id").alias("problem"), "rows")
    none = df.where(F.greatest(*(F.col(c).isNull() for c in schema.fieldNames()))).agg(F.count("*").alias("rows")).select(F.lit("missing_field").alias("problem"), "rows")
    numbers = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
    odd = df.where(F.greatest(F.lit(False), F.lit(False), *(F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)) for c in numbers))).agg(F.count("*").alias("rows")).select(F.lit("number_not_finite").alias("problem"), "rows")
    return wrong.unionByName(twice).unionByName(none).unionByName(odd)


def inventory_schema_problems(spark: SparkSession, path: str, schema: T.StructType, most_bytes: int | None = None) -> list[str]:
    """What in the files of a raw store differs from the schema: missing columns, other types, a size beyond ``most_bytes``."""
    stored = {f.name: f.dataType for f in spark.read.option("mergeSchema", "true").parquet(path).schema}
    problems = [f"no column {f.name}" for f in schema if f.name not in stored]
    problems += [f"{f.name} is {stored[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema if f.name in stored and stored[f.name] != f.dataType]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()
    return problems + ([f"{size} bytes, more than {most_bytes}"] if most_bytes is not None and size > most_bytes else [])


def load_config(path: str) -> dict[str, Any]:
    """A YAML or JSON configuration file."""
    with open(path) as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs PyYAML") from e
        return yaml.safe_load(f) or {}


def symbol_versions(config: Mapping[str, Any]) -> list[dict[str, Any]]:
    """The symbol versions of a configuration (``symbols``: lists by class of assets), with no two that start together."""
    rows = [dict(row) for group in (config.get("symbols") or {}).values() for row in group or []]
    seen = set()
    for row in rows:
        if missing := [k for k in ("symbol", "source", "asset_class", "reporting_currency", "effective_from") if not row.get(k)]:
            raise ValueError(f"a symbol lacks {missing}")
        at = (str(row["symbol"]).strip().upper(), row["source"], str(row["effective_from"]))
        if at in seen:
            raise ValueError(f"two versions of {at}")
        seen.add(at)
    return rows


def storage_paths(config: Mapping[str, Any], root: str = "") -> dict[str, str]:
    """Dataset -> folder of a storage configuration: the raw one by its name, the curated ones by theirs."""
    storage = config.get("storage") or {}
    if storage.get("format", "parquet") != "parquet":
        raise ValueError("only parquet stores are supported")
    raw, curated = storage.get("raw") or {}, storage.get("curated") or {}
    join = lambda *parts: "/".join(p.rstrip("/") for p in parts if p)
    paths = {raw["dataset"]: join(root, raw["base_path"], raw["dataset"])} if raw.get("dataset") else {}
    return paths | {name: join(root, curated["base_path"], folder) for name, folder in (curated.get("datasets") or {}).items()}


def synthetic_events(spark: SparkSession, rows: int, symbols: int = 20, days: int = 10, seed: int = 42) -> DataFrame:
    """Market events made of a seed, the same on every run: prices walk around a level of each symbol."""
    i = F.col("id")
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), i), F.lit(1_000_003)) / 1_000_003.0)
    base = spark.range(rows).withColumn("s", (i % symbols).cast("int")).withColumn("d", (F.floor(i / symbols) % days).cast("int"))
    ts = F.timestamp_seconds(F.lit(1_735_689_600) + F.col("d") * 86_400 + F.floor(u(1) * 23_400) + 48_600)
    return base.select(
        F.concat(F.lit("bench-"), F.lpad(i.cast("string"), 9, "0")).alias("event_id"),
        F.concat(F.lit("SYM"), F.lpad(F.col("s").cast("string"), 3, "0")).alias("symbol"),
        F.round(F.lit(50.0) + F.col("s") * 10 + u(2) * 5, 4).alias("price"),
        (F.floor(u(3) * 9_900) + 100).cast("bigint").alias("volume"),
        F.to_date(ts).alias("trade_date"),
        ts.alias("ts_event"),
        (ts + F.make_dt_interval(secs=F.round(u(4) * 5, 3).cast("decimal(18,6)"))).alias("ts_ingest"),
        F.lit("benchmark").alias("source"),
    )


def scan_benchmark(df: DataFrame, symbol: str, trade_date: Any) -> DataFrame:
    """The scan benchmark's query: rows, average price and volume of one symbol and day."""
    return df.where((F.col("symbol") == symbol) & (F.col("trade_date") == trade_date)).agg(F.count("*").alias("rows"), F.avg("price").alias("average_price"), F.sum("volume").alias("volume"))


def manifest(run: str, inputs: Mapping[str, str], outputs: Mapping[str, int], parameters: Mapping[str, Any]) -> dict[str, Any]:
    """Lineage of a run: what it read, what it wrote, with which parameters; identified by its content."""
    from tidegrid.functions.ids import driver_id

    body = {"run": run, "inputs": dict(sorted(inputs.items())), "outputs": dict(sorted(outputs.items())), "parameters": dict(sorted(parameters.items()))}
    return body | {"manifest_id": driver_id("lineage-", body, 16)}


class RunLock:
    """A lock file made exclusively; a lock older than ``stale_seconds`` is replaced."""

    def __init__(self, path: str, stale_seconds: float = 3600):
        self.path, self.stale_seconds = path, stale_seconds

    def __enter__(self) -> RunLock:
        import time

        for _ in range(2):
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return self
            except FileExistsError:
                if time.time() - os.stat(self.path).st_mtime < self.stale_seconds:
                    break
                os.unlink(self.path)
        raise RuntimeError(f"{self.path} is locked by another run")

    def __exit__(self, *_: object) -> None:
        os.unlink(self.path)
