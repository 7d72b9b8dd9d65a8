"""Session set-up, lineage cuts and shipping of Python code to executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None
_WRITTEN: dict[SparkSession, set[str]] = {}


def get_spark(app: str = "tidemark", cpus: str | int | None = None) -> SparkSession:
    """A local session with the settings that the engine expects (UTC, AQE)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(max(8, os.cpu_count() or 8 if cpus == "*" else int(cpus))))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return f"file://{_OWN_DIR}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back: later uses neither recompute it nor
    depend on any executor that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if spark not in _WRITTEN:
        _WRITTEN[spark] = set()
        atexit.register(_remove_all, spark)
    _WRITTEN[spark].add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def materialize_rounds(spark: SparkSession, step: Callable[[int], DataFrame], n: int, name: str = "step") -> DataFrame:
    """step(0) .. step(n - 1) as one table, written one after the other: disk holds the shuffle files of one of them at a time."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark, set()) or atexit.register(_remove_all, spark)
    _WRITTEN[spark].add(path)
    for i in range(n):
        if n > 1:
            release(spark)
        df = step(i)
        schema = df.schema
        df.write.mode("append").parquet(path)
        del df
    if n > 1:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished queries, which it keeps until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*dfs: DataFrame) -> None:
    """Delete tables that materialize wrote and that no later plan reads; anything else is left alone."""
    for df in dfs:
        path = getattr(df, "_written_to", None)
        if path:
            _remove(df.sparkSession, path)
            _WRITTEN.get(df.sparkSession, set()).discard(path)


def _remove_all(spark: SparkSession) -> None:
    for path in _WRITTEN.pop(spark, set()):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass


def ship(module) -> None:
    """Pickle the functions of a module's package by value, so that executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module.__name__.partition(".")[0]])

