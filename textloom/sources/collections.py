"""Collections of strings from files, Python and Arrow, their layout figures, and writing them back."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators.collection import with_positions


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """path, content BINARY: whole files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """s: whole files as text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "s")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """s: one row for each line."""
    return spark.read.text(path).withColumnRenamed("value", "s")


def from_values(spark: SparkSession, values) -> DataFrame:
    """idx, s from Python strings or bytes, in order."""
    values = list(values)
    kind = "binary" if values and isinstance(next((v for v in values if v is not None), ""), bytes | bytearray) else "string"
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"idx long, s {kind}")


def from_column(df: DataFrame, text: str, order: str, null_as_empty: bool = False) -> DataFrame:
    """idx, s from a column of a table, in the order of another. null_as_empty: as copying from Arrow does."""
    s = F.coalesce(F.col(text), F.lit("")) if null_as_empty else F.col(text)
    return with_positions(df.select(s.alias("s"), F.col(order).alias("_o")), F.col("_o"), name="idx").select("idx", "s")


#: Bytes that a row group of a Parquet file usually has at most; a row group is read by one task.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the session's cores, if it is so small that its files can hold fewer row groups than there are cores.
    Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df if size >= cores * ROW_GROUP else df.repartition(cores)


def append(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """The elements of a, then those of b, with b's indexes counted on from a's."""
    after = a.agg(F.coalesce(F.max(idx) + 1, F.lit(0)).alias("_after"))
    return a.unionByName(b.crossJoin(F.broadcast(after)).withColumn(idx, F.col(idx) + F.col("_after")).drop("_after"))


def layout(df: DataFrame, text: str = "s") -> DataFrame:
    """What an Arrow tape of the collection would take: bytes, offsets, and whether offsets need 64 bits."""
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")
    return df.agg(size.alias("tape_nbytes"), (F.count(F.lit(1)) + 1).alias("offsets"), (size > F.lit((1 << 32) - 1)).alias("offsets_are_large"))


def write_texts(df: DataFrame, path: str, text: str = "s") -> None:
    """Writes texts, one a line, as Spark's text files."""
    if "\0" in path:
        raise ValueError("a path has no NUL")
    df.select(text).write.text(path)


def write_bytes(df: DataFrame, path: str, text: str = "s", key: str = "idx") -> None:
    """Writes values of any bytes, with their index, as Parquet; text files would break them at line ends."""
    if "\0" in path:
        raise ValueError("a path has no NUL")
    df.select(key, F.col(text).cast("binary").alias(text)).write.parquet(path)


def write_file(df: DataFrame, path: str) -> None:
    """Writes the one value of a table of one row and one column as a file of just its bytes, through Hadoop's file systems."""
    if "\0" in path:
        raise ValueError("a path has no NUL")
    values = df.select(df[df.columns[0]].cast("binary")).limit(2).collect()
    if len(values) != 1:
        raise ValueError("one value makes a file")
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(values[0][0] or b""))
    finally:
        out.close()
