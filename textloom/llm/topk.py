"""Exact top-k search by inner product with the three-phase uniform threshold algorithm (Cao and Wang, 2004).

The lists are slices of the dimensions: a row's score in a slice is the inner product over that slice's components, and
its total is the sum over the slices. For each query:

1. every partition reports, for each slice, the k rows with the highest local scores, and the slice's lowest score;
2. the k-th highest total among all reported rows is a total that the answer's last row can't fall below. Less the sum
   of the lowest scores and divided by the number of slices, it is the uniform threshold: a row whose local scores, each
   above its slice's lowest, all stay below it can't be in the answer. The cutoffs are broadcast;
3. partitions collect the rows with an entry at or above the threshold, drop those whose known entries plus thresholds
   for the rest stay below the cutoff, and resolve the remaining totals exactly. Each reports its k best.

All slices of a row lie in the same partition, so phases 2 and 3 share a pass over the table and nothing but entries of
candidate rows is shuffled. Queries are handled in blocks of about ``BLOCK``, one after another: what is broadcast, and what
a partition reports, is bounded by a block, whatever the number of rows. Each block's answer is a part of one table of the shared folder. Scores are integers; sums that can exceed 2**53
are computed with Python's integers and saturate at the limits of a long.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without id;
vectors are compared with those of the same length only; ties go to the smaller id; repeated rows are rows of their
own, so an id can occur twice; an id with several vectors queries with the smallest of them; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.window import Window

from . import scratch
from .workers import mapped

K, SLICES, BLOCK = 10, 4, 2048
#: Rows that are multiplied with a block of queries at once.
PIECE = 1024
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of whole doubles floor(1024 x)) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor of a double gives a long, which can overflow; the kernel floors instead.
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors by length, in pieces: (rows, matrix)."""
    at = column.offsets.to_numpy()
    flat = np.floor(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] * 1024.0)
    sizes = np.diff(at)
    out = []
    for d in np.unique(sizes):
        every = np.flatnonzero(sizes == d)
        for rows in np.array_split(every, -(-len(every) // PIECE)):
            out.append((rows, flat[at[rows][:, None] - at[0] + np.arange(d)]))
    return out


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers or, where those may not hold them, as Python's."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2.0**53:
        return (x @ q.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return exact(x).dot(exact(q).T)


def _saturated(total: np.ndarray) -> np.ndarray:
    return np.clip(total, _LOW, _HIGH).astype(np.int64) if total.dtype == object else total


def _slices(d: int, n: int) -> list[slice]:
    cuts = np.linspace(0, d, min(n, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _by_length(ids: list[int], vectors: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        a, b = out.setdefault(len(v), ([], []))
        a.append(i)
        b.append(v)
    return {d: (np.array(a, np.int64), np.floor(np.array(b) * 1024.0)) for d, (a, b) in out.items()}


def _local_lists(block, k: int, n_slices: int):
    """Phase 1: (query, id, total) of the best rows, and (query, slice, low), the slice's lowest score in this partition."""

    def run(batches):
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in _matrix(batch.column(1)):
                if x.shape[1] not in block.value:
                    continue
                q_ids, q = block.value[x.shape[1]]
                parts = [_products(x[:, s], q[:, s]) for s in _slices(x.shape[1], n_slices)]
                total, own = _saturated(sum(parts)), ids[rows]
                for j, part in enumerate(parts):
                    for c in range(len(q_ids)):
                        other = own != q_ids[c]
                        if not other.any():
                            continue
                        score, t, who = part[other, c], total[other, c], own[other]
                        top = np.argpartition(-score, k - 1)[:k] if len(score) > k else np.arange(len(score))
                        old = best.get((int(q_ids[c]), j))
                        entries = [*zip(score[top].tolist(), who[top].tolist(), t[top].tolist(), strict=True), *(old[0] if old else [])]
                        entries.sort(key=lambda e: (-e[0], e[1]))
                        best[int(q_ids[c]), j] = [entries[:k], max(_LOW, min(int(score.min()), old[1] if old else _HIGH))]
        # A row that is among the best in several slices is reported once; so partitions report rows of their own only.
        rows = {(q, None, e[1], e[2], None) for (q, _), (entries, _) in best.items() for e in entries}
        out = [*rows, *((q, j, None, None, low) for (q, j), (_, low) in best.items())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["q", "slice", "id", "total", "low"])

    return run


def _resolve(block, cutoffs, k: int, n_slices: int):
    """Phases 2 and 3: (query, id, total) of each partition's k best rows that reach the cutoff."""

    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in _matrix(batch.column(1)):
                if x.shape[1] not in block.value:
                    continue
                q_ids, q = block.value[x.shape[1]]
                own, cuts = ids[rows], _slices(x.shape[1], n_slices)
                parts = [_products(x[:, s], q[:, s]) for s in cuts]
                for c, q_id in enumerate(q_ids.tolist()):
                    least, lows = cutoffs.value.get(q_id, (None, None))
                    if lows is None:
                        continue
                    wide = any(part.dtype == object for part in parts) or max(map(abs, (least or 0, *lows))) >= 2**57
                    shifted = np.stack([(part[:, c].astype(object) if wide else part[:, c]) - lows[j] for j, part in enumerate(parts)])
                    if least is None or least == _LOW:  # totals below the limit of a long count as that limit
                        chosen = np.flatnonzero(own != q_id)
                    else:
                        level = -(-(least - sum(lows)) // len(cuts))  # the uniform threshold, rounded up
                        known = shifted >= level
                        most = np.where(known, shifted, level).sum(0)
                        chosen = np.flatnonzero(known.any(0) & (most >= least - sum(lows)) & (own != q_id))
                    total = _saturated(shifted[:, chosen].sum(0) + sum(lows))
                    if least is not None:
                        chosen, total = chosen[total >= least], total[total >= least]
                    if len(chosen) > k:
                        keep = np.lexsort((own[chosen], ~total))[:k]
                        chosen, total = chosen[keep], total[keep]
                    if len(chosen):
                        best[q_id] = sorted([*best.get(q_id, []), *zip((~total).tolist(), own[chosen].tolist(), strict=True)])[:k]
        out = [(q, i, ~t) for q, entries in best.items() for t, i in entries]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["q", "id", "total"])

    return run


def _block_top(rows: DataFrame, queries: DataFrame, k: int, n_slices: int, path: str) -> None:
    """Adds the answer for one block of queries to a table; a block is bounded, so it and its cutoffs may go to the driver."""
    context = rows.sparkSession.sparkContext
    own = queries.collect()
    if not own:
        return
    block = context.broadcast(_by_length([r.id for r in own], [r.v for r in own]))
    lists = mapped(rows, _local_lists(block, k, n_slices), "q long, slice int, id long, total long, low long")
    lists = scratch.table(lists, "topk-lists")
    lows = lists.where("slice is not null").groupBy("q", "slice").agg(F.min("low").alias("low")).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("slice", "low"))).alias("lows"))
    ranked = lists.where("slice is null").select("q", "id", "total").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "id"))).where(F.col("rank") == k).select("q", F.col("total").alias("least"))
    cutoffs = context.broadcast({r.q: (r.least, [r.lows[j] for j in sorted(r.lows)]) for r in lows.join(ranked, "q", "left").collect()})
    scratch.release(lists)
    found = mapped(rows, _resolve(block, cutoffs, k, n_slices), "q long, id long, total long")
    best = Window.partitionBy("q").orderBy(F.desc("total"), "id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("total").alias("score"))
    top.write.mode("append").parquet(path)
    scratch.release(block, cutoffs)


def search(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, n_slices: int = SLICES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that is_query (a condition) picks."""
    rows = clean(df, key, vector)
    queries = clean(df.where(is_query), key, vector).groupBy("id").agg(F.min("v").alias("v"))
    n = queries.count()
    blocks = max(1, -(-n // block))
    path, schema = scratch.new_path(rows.sparkSession, "topk"), "query_id long, rank int, vec_id long, score long"
    rows.sparkSession.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        _block_top(rows, queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), k, n_slices, path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def op2_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP2_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
