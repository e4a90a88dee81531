"""Session factory and the two run-time services every operator shares.

``stage`` cuts a lineage through the shared folder of the session, and
``bounded_broadcast`` hints a broadcast only after the size was checked.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured and holds no more rows and, written as text, no more bytes than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
_staged: list[str] = []


def make_session(app: str = "tidegrid", master: str | None = None, shuffle: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if shuffle:
        settings["spark.sql.shuffle.partitions"] = str(shuffle)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset a temporary folder is made, recorded in the session and
    removed at exit; but only on one machine. On a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="tidegrid-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result survives the loss of executors, has row counts in its footers
    and can be scanned several times with column pruning. The tables stay, as
    frames may still read them; ``release`` removes those of this process.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``stage``, and the number of rows written, counted on the way: no second scan.

    Tasks that had to run again may count twice, so take the number as a size.
    """
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return staged, seen.get["rows"]


def release(spark: SparkSession) -> int:
    """Remove the staged tables of this process, once no frame made of them is needed; returns their number."""
    n = len(_staged)
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes as JSON text; it is read up to rows + 1."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return seen["n"] <= rows and (seen["bytes"] or 0) <= size


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else as it is.

    Use it on staged or small tables. Beyond the bound the join is left to AQE
    (sort-merge with skew splitting).
    """
    return F.broadcast(df) if is_small(df, rows) else df
