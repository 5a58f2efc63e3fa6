"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "gridtide") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites of column expressions in error messages cost more than wide plans take to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on: calendar fields are taken in UTC
    after an explicit shift, so the session zone must be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``.  Where it is unset, a local session uses its warehouse
    folder; on a cluster the setting must be there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that ``release`` deletes like the written tables."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "step", narrow: bool = False) -> DataFrame:
    """Write a frame that several jobs will read as a table in the shared folder and
    return a scan of it.  Lost executors cost a re-read, not the whole plan, and later
    jobs still prune columns.  ``narrow``: the rows are far smaller than what they are made
    of, so they are gathered into files of the advisory size, not a tiny one per task.
    ``release`` deletes what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables ``materialize`` wrote in this session after the first ``keep``.
    Call it when no frame built on them will be read again; the end of the process
    does so for all that is left."""
    mine = [m for m in _made if m[0] is spark]
    for _, path in mine[keep:]:
        _delete(spark, path)
    _made[:] = [m for m in _made if m[0] is not spark] + mine[:keep]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what ``materialize`` wrote inside the block."""
    before = sum(m[0] is spark for m in _made)
    try:
        yield
    finally:
        release(spark, before)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _release_all() -> None:
    for spark in {id(m[0]): m[0] for m in _made}.values():
        with suppress(Exception):  # the session may have ended already
            release(spark)


atexit.register(_release_all)
