"""Shared scratch space: tables that cut lineage or carry a run's intermediate state.

Everything goes to the folder named by ``spark.checkpoint.dir``, which the driver and all executors share; only where
that setting is missing and all runs on one machine (a local master) a temporary folder is set up once per session; elsewhere its
absence is an error. Tables are written by Spark's own
writer, so a lost executor or a repeated task never leaves a half-written table behind. A table that nothing reads any more is
released by its maker; what a returned DataFrame still reads goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, for scratch tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex[:12]}"
    _MADE[path] = spark
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later plans start from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_scratch = path
    return out


def release(*tables: DataFrame | Broadcast) -> None:
    """Deletes scratch tables that no DataFrame reads any more, and broadcast values that no job will ask for again."""
    for t in tables:
        if isinstance(t, Broadcast):
            t.destroy()
            continue
        path = getattr(t, "_textloom_scratch", None)
        if path in _MADE:
            drop(_MADE.pop(path), path)


def sweep(spark: SparkSession) -> None:
    """Lets go of what finished jobs left with the executors: their shuffle files, broadcast tables and configurations are removed when
    the driver collects its garbage, which it hardly does while many small jobs run."""
    gc.collect()
    for _ in range(2):  # what Python held is free for the driver's JVM a moment later
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file system, so it works for any kind of shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _MADE:
        path, spark = _MADE.popitem()
        with contextlib.suppress(Exception):  # the session may have ended already
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
