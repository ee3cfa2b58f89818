"""Edit distances and alignment scores: of two columns, and of all pairs of two tables.

Unit costs are Spark's own ``levenshtein``, over code points or over the byte view; other costs are Arrow kernels.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.arrow import per_batch
from ..functions.bytesview import Text, col, view
from ..functions.kernels import Classes, Costs, alignments, edit_distances

UNIT = Costs()


def _scores(x: Text, y: Text, prepare, score) -> Column:
    def run(a, b):
        there = [i for i, (p, q) in enumerate(zip(a, b, strict=True)) if p is not None and q is not None]
        out: list[int | None] = [None] * len(a)
        if there:
            for i, s in zip(there, score([prepare(a[i]) for i in there], [prepare(b[i]) for i in there]).tolist(), strict=True):
                out[i] = s
        return out

    return per_batch(run, "bigint", x, y)


def levenshtein_bytes(a: Text, b: Text, costs: Costs = UNIT) -> Column:
    """Edit distance of bytes."""
    if costs.unit:
        return F.levenshtein(view(a), view(b)).cast("long")
    return _scores(col(a).cast("binary"), col(b).cast("binary"), lambda t: np.frombuffer(t, np.uint8), lambda p, q: edit_distances(p, q, costs))


def levenshtein_utf8(a: Text, b: Text, costs: Costs = UNIT) -> Column:
    """Edit distance of code points."""
    if costs.unit:
        return F.levenshtein(col(a), col(b)).cast("long")
    return _scores(a, b, lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32), lambda p, q: edit_distances(p, q, costs))


def needleman_wunsch(a: Text, b: Text, classes: Classes) -> Column:
    """Best score of a global alignment of bytes."""
    return _scores(col(a).cast("binary"), col(b).cast("binary"), bytes, lambda p, q: alignments(p, q, classes, False))


def smith_waterman(a: Text, b: Text, classes: Classes) -> Column:
    """Best score of a local alignment of bytes, at least 0."""
    return _scores(col(a).cast("binary"), col(b).cast("binary"), bytes, lambda p, q: alignments(p, q, classes, True))


def cross_scores(queries: DataFrame, candidates: DataFrame | None, score, text: str = "s", key: str = "idx", at_most: int | None = None) -> DataFrame:
    """qi, ci, score for all pairs of two tables, or of one with itself (computed for ci <= qi and mirrored).

    score: a function of two columns. at_most: keep only pairs up to this unit-cost distance; pairs whose byte lengths alone
    differ by more are never scored."""
    q = queries.select(F.col(key).alias("qi"), F.col(text).alias("q"))
    symmetric = candidates is None
    c = (queries if symmetric else candidates).select(F.col(key).alias("ci"), F.col(text).alias("c"))
    pairs = q.crossJoin(c)
    if symmetric:
        pairs = pairs.where("ci <= qi")
    if at_most is not None:
        pairs = pairs.where(F.abs(F.octet_length("q") - F.octet_length("c")) <= 4 * at_most)
    out = pairs.select("qi", "ci", score("q", "c").alias("score"))
    if at_most is not None:
        out = out.where(F.col("score") <= at_most)
    if symmetric:  # both halves from one computation
        both = F.when(F.col("qi") == F.col("ci"), F.array(F.struct("qi", "ci"))).otherwise(F.array(F.struct("qi", "ci"), F.struct(F.col("ci").alias("qi"), F.col("qi").alias("ci"))))
        out = out.select(F.explode(both).alias("p"), "score").select("p.qi", "p.ci", "score")
    return out


def matrix(scores: DataFrame) -> DataFrame:
    """One row for each query: its scores in the order of the candidates."""
    return scores.groupBy("qi").agg(F.transform(F.array_sort(F.collect_list(F.struct("ci", "score"))), lambda p: p.score).alias("scores"))
