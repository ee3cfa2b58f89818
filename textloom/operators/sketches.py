"""Sketches over the seeded hash: Count-Min counts, and Bloom filters, as tables that are combined before the shuffle."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.hashing import hash_multiseed


def _places(df: DataFrame, text: str, cells: int, seeds: list[int]) -> DataFrame:
    """df with row and cell: one row for each seed. cells is a power of two, so the low bits of the hash are the place."""
    if cells < 1 or cells & (cells - 1):
        raise ValueError("the number of cells is a power of two")
    hashed = df.where(F.col(text).isNotNull()).withColumn("_h", hash_multiseed(text, seeds))
    return hashed.select("*", F.posexplode("_h").alias("row", "_x")).withColumn("cell", F.col("_x").bitwiseAND(F.lit(cells - 1))).drop("_h", "_x")


def count_min(df: DataFrame, text: str, cells: int, seeds: list[int]) -> DataFrame:
    """row, cell, n: how many values fall into each cell, one row of cells for each seed. Equal values are counted first."""
    few = df.groupBy(text).agg(F.count("*").alias("_n"))
    return _places(few, text, cells, seeds).groupBy("row", "cell").agg(F.sum("_n").alias("n"))


def estimate(df: DataFrame, text: str, sketch: DataFrame, cells: int, seeds: list[int]) -> DataFrame:
    """The distinct values of df, and the sketch's estimate of how often each was counted: the least of its cells."""
    placed = _places(df.select(text).distinct(), text, cells, seeds)
    return placed.join(sketch, ["row", "cell"], "left").groupBy(text).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def bloom(df: DataFrame, text: str, cells: int, seeds: list[int]) -> DataFrame:
    """word, bits: the words of 64 bits of a filter of so many cells that aren't empty."""
    placed = _places(df.select(text).distinct(), text, cells, seeds)
    bit = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    return placed.select(F.shiftright("cell", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def might_contain(df: DataFrame, text: str, filter_: DataFrame, cells: int, seeds: list[int]) -> DataFrame:
    """The distinct values of df, and whether the filter may hold them: never false for one that it holds."""
    placed = _places(df.select(text).distinct(), text, cells, seeds).withColumn("word", F.shiftright("cell", 6))
    hit = F.expr("coalesce((shiftright(bits, CAST(cell & 63 AS INT)) & 1) = 1, false)")
    return placed.join(filter_, "word", "left").groupBy(text).agg(F.min(hit).alias("found"))
