"""Operators on collections of strings: a collection is a table with an index and a text.

Global order is a range-partitioned sort; dense positions come from the sizes of the sorted partitions, never from a window
over all rows in one task.
"""

from __future__ import annotations

import itertools

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import unicode
from ..sources.shared import checkpoint

JOINS = ("inner_strict", "inner", "left", "right", "full", "cross")


def _keys(text: str | Column, reverse: bool, uncased: bool, idx: str) -> list[Column]:
    key = F.col(text) if isinstance(text, str) else text
    if uncased:
        key = unicode.fold(key)
    return [key.desc() if reverse else key.asc(), F.col(idx).asc()]


def sort(df: DataFrame, text: str | Column = "s", idx: str = "idx", reverse: bool = False, uncased: bool = False, top: int = 0) -> DataFrame:
    """Stable sort by bytes (or by folded text); equal texts stay in the order of the index, also in reverse. top: the first
    so many rows only, 0 for all."""
    ordered = df.orderBy(*_keys(text, reverse, uncased, idx))
    return ordered.limit(top) if top else ordered


def with_positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """df in the given order, with positions from 0 without gaps."""
    ordered = checkpoint(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).cast("long")
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).count().collect())  # a row for each partition
    starts = list(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0), strict=False))
    before = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    placed = ordered.withColumn("_part", part).join(F.broadcast(before), "_part")  # as many rows as there are partitions
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def argsort(df: DataFrame, text: str | Column = "s", idx: str = "idx", reverse: bool = False, uncased: bool = False, top: int = 0) -> DataFrame:
    """position, idx: which element stands at each position of the sorted collection."""
    if top:
        keys = _keys(text, reverse, uncased, idx)
        from pyspark.sql.window import Window

        few = df.orderBy(*keys).limit(top)
        return few.select((F.row_number().over(Window.orderBy(*keys)) - 1).cast("long").alias("position"), F.col(idx))
    return with_positions(df, *_keys(text, reverse, uncased, idx)).select("position", F.col(idx))


def sort_numbers(df: DataFrame, key: str, idx: str = "idx") -> DataFrame:
    """Stable sort by an unsigned 64-bit key held in a BIGINT."""
    return df.orderBy(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), idx)


def _drawn(idx: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), idx.cast("string")).cast("binary"))


def shuffled(df: DataFrame, seed: int = 0, idx: str = "idx", position: str | None = None) -> DataFrame:
    """A permutation that depends on seed and index only, whatever the partitioning. position: name of a column for the places."""
    order = _drawn(F.col(idx), seed)
    return with_positions(df, order, F.col(idx), name=position) if position else df.orderBy(order, idx)


def sample(df: DataFrame, size: int, seed: int = 0, idx: str = "idx") -> DataFrame:
    """Exactly ``size`` draws with replacement: draw, and the columns of df. idx must be dense from 0."""
    n = df.count()
    if not n or not size:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), "*")
    number = F.conv(F.substring(_drawn(F.col("id"), seed), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(number, F.lit(n)).alias("_at"))
    return draws.join(df, F.col("_at") == F.col(idx)).drop("_at")


def rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None, idx: str = "idx") -> DataFrame:
    """The rows that a Python slice picks, with their place; idx must be dense from 0."""
    first, last, by = slice(start, stop, step).indices(df.count())
    i = F.col(idx)
    inside = ((i >= first) & (i < last)) if by > 0 else ((i <= first) & (i > last))
    return df.where(inside & (F.pmod(i - first, F.lit(abs(by))) == 0)).withColumn("place", F.floor((i - first) / by).cast("long"))


def intersect(a: DataFrame, b: DataFrame, text: str = "s", idx: str = "idx", key=None) -> DataFrame:
    """ours, theirs, s: positions of every distinct shared value, the first on each side. key: a function of the text."""
    value = key or (lambda c: c)
    side = lambda d, name: d.where(F.col(text).isNotNull()).groupBy(value(F.col(text)).alias(text)).agg(F.min(idx).alias(name))
    return side(a, "ours").join(side(b, "theirs"), text).select("ours", "theirs", text)


def join_strings(a: DataFrame, b: DataFrame, how: str = "inner", text: str = "s", idx: str = "idx") -> DataFrame:
    """ours, theirs: pairs of positions with equal texts. inner_strict: an error if a side has duplicates."""
    if how not in JOINS:
        raise ValueError(f"how is one of {JOINS}")
    x, y = a.select(F.col(idx).alias("ours"), F.col(text).alias("_a")), b.select(F.col(idx).alias("theirs"), F.col(text).alias("_b"))
    if how == "cross":
        return x.crossJoin(y).select("ours", "theirs")
    if how == "inner_strict":
        for d, t in ((x, "_a"), (y, "_b")):
            if not d.where(F.col(t).isNotNull()).groupBy(t).count().where("count > 1").isEmpty():
                raise ValueError("a strict join takes no duplicates")
    kind = {"inner_strict": "inner", "full": "full_outer"}.get(how, how)
    return x.join(y, F.col("_a") == F.col("_b"), kind).select("ours", "theirs")


def contains(df: DataFrame, values: list[str], text: str = "s") -> DataFrame:
    """Which of the values the collection holds."""
    asked = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    hit = df.where(F.col(text).isin(values)).select(F.col(text).alias("value")).distinct().withColumn("found", F.lit(True))
    return asked.join(hit, "value", "left").select("value", F.coalesce("found", F.lit(False)).alias("found"))


def equal(a: DataFrame, b: DataFrame, text: str = "s", idx: str = "idx") -> bool:
    """Whether two collections have the same texts at the same places."""
    x, y = a.select(idx, text), b.select(idx, text)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def compare(a: DataFrame, b: DataFrame, text: str = "s", idx: str = "idx") -> int:
    """-1, 0 or 1: lexicographic order of two collections, by the first place where they differ."""
    x, y = a.select(F.col(idx).alias("i"), F.col(text).alias("p"), F.lit(1).alias("l")), b.select(F.col(idx).alias("i"), F.col(text).alias("q"), F.lit(1).alias("r"))
    first = x.join(y, "i", "full_outer").where(~(F.col("p").eqNullSafe(F.col("q")) & F.col("l").isNotNull() & F.col("r").isNotNull())).orderBy("i").limit(1).collect()
    if not first:
        return 0
    r = first[0]
    if r.l is None or r.r is None:
        return -1 if r.l is None else 1
    return -1 if (r.p or "").encode() < (r.q or "").encode() else 1


def union_numbers(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()
