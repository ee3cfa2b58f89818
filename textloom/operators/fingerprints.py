"""Rolling MinHash fingerprints: per dimension the least window hash of a text and how often it occurs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from ..functions import hashers
from ..functions.arrow import per_value
from ..functions.bytesview import Text, col
from ..functions.kernels import dimensions, fingerprint_many

TYPE = "struct<hashes:array<bigint>,counts:array<bigint>>"


def fingerprints(x: Text, ndim: int, widths: tuple[int, ...] | None = None, alphabet_size: int = 256, seed: int = 0) -> Column:
    """STRUCT<hashes, counts>, ndim of each; a text shorter than a window has hash 4294967295 and count 0 there.

    alphabet_size is accepted and has no effect: multipliers span all byte values."""
    if ndim < 1:
        raise ValueError("a fingerprint has at least one dimension")
    dims = dimensions(ndim, widths, seed)

    def run(texts: pa.Array) -> pa.Array:
        wide = texts.cast(pa.large_binary())
        _, at, data = wide.buffers()
        offsets = np.frombuffer(at, np.int64)[wide.offset : wide.offset + len(wide) + 1] if at else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * ndim)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in fingerprint_many(raw, offsets, dims)]
        return pa.StructArray.from_arrays(lists, names=["hashes", "counts"], mask=texts.is_null())

    return arrow_udf(run, TYPE)(col(x).cast("binary"))


def fingerprints_by(x: Text, family: str, widths: tuple[int, ...], alphabet: str | int = "bytes", seed: int = 0) -> Column:
    """Fingerprints by another family of window hashes (see ``hashers.FAMILIES``), one dimension for each width. alphabet: a name in
    ``hashers.ALPHABETS``, or its size."""
    if family not in hashers.FAMILIES or not widths:
        raise ValueError(f"a family of {sorted(hashers.FAMILIES)} and at least one width are needed")
    size = hashers.ALPHABETS[alphabet] if isinstance(alphabet, str) else alphabet

    def run(data: bytes) -> dict:
        hashes, counts = hashers.fingerprint(data, family, widths, seed, size)
        return {"hashes": hashes, "counts": counts}

    return per_value(run, TYPE, col(x).cast("binary"))


def fingerprints_of_chunks(df: DataFrame, key: str, order: str, chunk: str, ndim: int, seed: int = 0) -> DataFrame:
    """key, hashes, counts: the fingerprint of each key's chunks put together, fed chunk by chunk. Only the end of the text so far is held,
    and windows across chunks count once."""
    dims = dimensions(ndim, None, seed)
    groups: dict[int, list[int]] = {}
    for d, (width, *_) in enumerate(dims):
        groups.setdefault(width, []).append(d)
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(chunk).cast("binary"), F.lit(b"")).alias("c"))
    names = [key, "hashes", "counts"]

    def fed(tail: bytes, piece: bytes, least: np.ndarray, often: np.ndarray) -> None:
        for width, at in groups.items():
            text = (tail[-(width - 1) :] if width > 1 else b"") + piece
            h, n = (x[0] for x in fingerprint_many(np.frombuffer(text, np.uint8), np.array([0, len(text)]), [dims[d] for d in at], whole=True))
            often[at] = np.where(h < least[at], n, often[at] + np.where(h == least[at], n, 0))
            least[at] = np.minimum(least[at], h)

    def run(batches):
        now, tail, least, often = None, b"", np.zeros(0), np.zeros(0, np.int64)

        def closed():
            shown = np.where(np.isinf(least), 0xFFFFFFFF, np.where(np.isinf(least), 0, least).astype(np.int64) & 0xFFFFFFFF)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([shown.tolist()], pa.list_(pa.int64())), pa.array([often.tolist()], pa.list_(pa.int64()))], names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now is None or now[0] != k:
                    if now is not None:
                        yield closed()
                    now, tail, least, often = (k,), b"", np.full(ndim, np.inf), np.zeros(ndim, np.int64)
                fed(tail, c, least, often)
                tail = (tail + c)[-(max(groups) - 1) :]
        if now is not None:
            yield closed()

    return rows.repartition("k").sortWithinPartitions("k", "o").mapInArrow(run, f"`{key}` {dict(rows.dtypes)['k']}, hashes array<bigint>, counts array<bigint>")


def candidates(df: DataFrame, key: str, hashes: str = "hashes", bands: int = 8) -> DataFrame:
    """a, b (a < b): pairs of keys whose sketches agree in all dimensions of at least one of the bands, found by an equi-join of
    bands. Rows with equal sketches are one class: their least key stands for them (see ``classes``)."""
    each = F.greatest(F.lit(1), F.floor(F.size(hashes) / bands)).cast("int")
    band = lambda i: F.xxhash64(i, F.slice(F.col(hashes), i * each + 1, each))
    few = df.groupBy(hashes).agg(F.min(key).alias("k"))
    cut = few.select("k", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("i", "band"))
    return cut.select(F.col("k").alias("a"), "i", "band").join(cut.select(F.col("k").alias("b"), "i", "band"), ["i", "band"]).where("a < b").select("a", "b").distinct()


def classes(df: DataFrame, key: str, hashes: str = "hashes") -> DataFrame:
    """key, class: the least key of the rows with the same sketch."""
    return df.join(df.groupBy(hashes).agg(F.min(key).alias("class")), hashes).select(key, "class")


def similarity(a: Column, b: Column) -> Column:
    """Share of dimensions with equal hashes, of two arrays of hashes."""
    same = F.aggregate(F.zip_with(a, b, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return same / F.size(a)


def merge(df: DataFrame, key: str, hashes: str = "hashes", counts: str = "counts") -> DataFrame:
    """key, hashes, counts: sketches of the same key merged, per dimension the least hash and the sum of its counts."""
    one = df.select(F.col(key), F.posexplode(F.arrays_zip(F.col(hashes).alias("h"), F.col(counts).alias("c"))).alias("dim", "x")).select(key, "dim", F.col("x.h").alias("h"), F.col("x.c").alias("c"))
    # First the counts of equal hashes, then the least hash: both are combined before the shuffle.
    summed = one.groupBy(key, "dim", "h").agg(F.sum("c").alias("c"))
    least = summed.groupBy(key, "dim").agg(F.min(F.struct("h", "c")).alias("x"))
    lists = least.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d"))
    return lists.select(key, F.transform("d", lambda e: e.x.h).alias(hashes), F.transform("d", lambda e: e.x.c).alias(counts))
