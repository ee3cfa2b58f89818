"""The training-data pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

All stages but the last return the columns of ``documents``. Toxicity judges every row by its text, so rows that share an id but not a text
can be parted there; near duplicates judge ids, so rows that share an id stay or go together. Null and empty texts pass every filter and are encoded as no tokens.
"""

from __future__ import annotations

from fractions import Fraction

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, jaccard, mixing, scratch, substring, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go."""
    docs = docs.select(*COLUMNS)
    return toxicity.reject(docs, toxicity.fit_on_labels(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays."""
    docs = docs.select(*COLUMNS)
    placed = jaccard.join(docs, k=5, threshold=Fraction(4, 5))
    gone = scratch.table(placed.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut out of the texts."""
    kept = substring.dedup(docs.select(*COLUMNS), keep=["lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: each document stays as often as it is drawn."""
    drawn = mixing.mix(docs.select(*COLUMNS), mixing.count_words(F.col("text")), keep=["text", "lang", "source", "n_chars"])
    return drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the bytes that they decode to."""
    return bpe.encode_and_check(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_substrings),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL expresses none of the stages' models and automata; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        scratch.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
