"""The folder that driver and executors share, for cut lineage and for tables that a query writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset and all runs on one machine (a local master), a temporary one is
    set; elsewhere its absence is an error, for machines don't see each other's folders."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="textloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{folder(spark)}/textloom-{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()
