"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
and the master is local, as in tests, a temporary folder takes its place.  A
written table cuts the lineage, so a lost executor costs one stage and not the
whole history.  The shuffle files behind a table go as soon as it is written,
a table goes with ``drop`` where nothing reads it any more, and what is left
goes when the application ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []
_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tracewright-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    if home not in _homes:
        system, at = _file_system(spark, home)
        system.mkdirs(at)
        system.deleteOnExit(at)
        _homes.add(home)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._table_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove tables written by ``materialize`` that no later plan reads."""
    for table in tables:
        system, at = _file_system(table.sparkSession, table._table_path)
        system.delete(at, True)


def if_small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``rows`` rows.

    Beyond that the join shuffles, and adaptive execution splits its hot keys.
    For tables whose rows are short.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
