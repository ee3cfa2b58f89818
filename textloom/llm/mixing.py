"""Mixing sources to target weights by systematic sampling.

A source's documents stand in a row, each as long as its expected number of copies; the row is shifted by one random offset,
and a document is emitted once for each whole number it crosses. Documents stand in the order of their size (in steps of STEP
words), so what is taken comes near its target even if sizes differ much.

The place of a document in its source's row is found without putting a source into one task: rows are counted in cells
(source, size step, hash bucket), the counts are summed along buckets and steps, and only a document's rank in its
cell is found by sorting. Everything is DataFrame operations.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1, and again; they share SHARE of all words by
weight; no target exceeds MOST times the source's words, and the excess goes to the others by weight until none is above.

Defined cases: a null text has no words; documents without words keep their place and take nothing; a source without words
has target 0; the offset depends on seed and source only, and ties stand in the order of id, so reruns agree; repeated rows
stand side by side; rows without an id are dealt to buckets by their size; an empty table gives an empty table; further columns are kept if named.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.window import Window

from . import scratch

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
STEP, STEPS = 32, 4096
_KEY = ["s0", "s"]
_CELL = [*_KEY, "step", "bucket"]


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to sizes (s0, s, source_size), one row for each source."""
    cycle = F.array(*map(F.lit, weights))
    every = Window.orderBy(*_KEY)
    x = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    x = x.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), *_KEY)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("at", F.row_number().over(by_cap))
    x = x.withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("rest", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.col("capped")) / F.col("rest"))
    x = x.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("at"))).over(whole))
    x = x.withColumn("level", F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(whole))
    return x.select(*_KEY, "source_size", F.when(F.col("at") < F.col("first"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _hex(text, digits: int):
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def mix(df: DataFrame, size, key: str = "doc_id", source: str = "source", keep: list[str] | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """key, size, source_size, target, copies, and the columns named in keep. size: a column of whole numbers."""
    keep = [c for c in keep or [] if c != key]
    rows = df.select(F.col(key).alias("k"), size.cast("long").alias("size"), F.col(source).isNull().alias("s0"), F.coalesce(F.col(source), F.lit("")).alias("s"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    rows = rows.withColumn("step", F.least(F.floor(F.col("size") / STEP), F.lit(STEPS)).cast("long")).withColumn("bucket", _hex(F.coalesce(F.col("k").cast("string"), F.concat(F.lit("size "), F.col("size"))), 2))
    # A few thousand rows for each source, read twice below; so sizes are counted twice, not three times.
    cells = scratch.table(rows.groupBy(*_CELL).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    steps = cells.groupBy(*_KEY, "step").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = steps.groupBy(*_KEY).agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, share, most).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("offset", _hex(F.concat(F.lit(seed + ":"), "s"), 8) / F.lit(4294967296.0))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("start", F.coalesce(F.sum("n").over(before(_KEY, "step")), F.lit(0))).drop("n", "words").join(goal, _KEY)
    cells = cells.withColumn("into", F.coalesce(F.sum("n").over(before([*_KEY, "step"], "bucket")), F.lit(0))).drop("n", "words").join(steps, [*_KEY, "step"])
    cells = cells.withColumn("start", F.col("start") + F.col("into")).drop("into")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*_CELL).orderBy("size", "k")))
    placed = ranked.join(cells, _CELL).withColumn("place", F.col("start") + F.col("rank"))
    crossed = F.floor(F.col("place") * F.col("ratio") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("ratio") + F.col("offset"))
    return placed.select(F.col("k").alias(key), "size", "source_size", "target", crossed.cast("long").alias("copies"), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, count_words(F.col("text"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, source IS NULL AS s0, coalesce(source, '') AS s FROM documents),
z AS (SELECT s0, s, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY s0, s) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM z),
o AS (SELECT *, row_number() OVER b AS nth, coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped, sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, s0, s)),
l AS (SELECT *, (goal - capped) / rest AS lv FROM o),
f AS (SELECT *, min(CASE WHEN lv * weight <= cap THEN nth END) OVER () AS head FROM l),
t AS (SELECT s0, s, source_size, CASE WHEN nth < head THEN cap::DOUBLE ELSE weight * (max(CASE WHEN nth = head THEN lv END) OVER ()) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio, ('0x' || substr(md5('mix:' || s), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t),
r AS (SELECT d.*, row_number() OVER (PARTITION BY s0, s ORDER BY least(size // 32, 4096), ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'size ' || size)), 1, 2))::BIGINT, size, doc_id) AS place FROM d)
SELECT doc_id, size, source_size, target, ((floor(place * ratio + u) - floor((place - 1) * ratio + u)) * size)::BIGINT AS taken FROM r JOIN g USING (s0, s)
"""
