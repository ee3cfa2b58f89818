"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds token ids, ``decode`` turns ids back into bytes. A long text is cut at safe boundaries, which are the
places where white space follows another character: no alternative of the splitting pattern reaches from the one into
the other, and its only lookahead concerns the inside of a run of white space, so the pieces on both sides are the same
as for the whole text. A run without such a place is matched piece by piece with a matcher that doesn't recurse.

Defined cases: a null text encodes like an empty one (no ids); decoding an empty list gives no bytes; repeated rows are
encoded alike; an empty table gives an empty table; further columns are kept unless ``encode`` is given ``keep``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .workers import mapped

#: Texts beyond so many characters are cut, into parts of about PART characters; parts beyond LONG are matched one by one.
WHOLE, PART, LONG = 100_000, 32_000, 200_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pieces(batch: pa.RecordBatch, place: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose values in one column take about limit bytes at most, so ids and strings of few rows are held."""
    column = batch.column(place)
    wide = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    ends = np.asarray(column.offsets) if wide else np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))))
    ends = (ends - ends[0]) * (4 if wide else 1)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, min(stop, batch.num_rows) - at)
        at = stop


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = pattern
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that end at safe boundaries."""
        at, n = 0, len(text)
        while n - at > PART:
            end = at + PART
            while end < n and not (text[end].isspace() and not text[end - 1].isspace()):
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= WHOLE:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([self._part(part) for part in self.parts(text)])

    def _part(self, part: str) -> np.ndarray:
        if len(part) <= LONG:
            return self.encoding.encode_to_numpy(part, disallowed_special=())
        import regex

        ids: list[int] = []
        for match in regex.finditer(self.pattern, part):
            ids += self.encoding._core_bpe.encode_single_piece(match[0].encode())
        return np.array(ids, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@functools.lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(ranks_path, pattern)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds column ``ids`` (array of int) with the token ids of the whole text; replaces a column of that name."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    df = df.drop(ids)
    place = df.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{ids}` array<int>"

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in (part for whole in batches for part in pieces(whole, place)):
            found = [own.encode(x or "") for x in batch.column(place).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])

    return mapped(df, run, schema)


def decode(df: DataFrame, ids: str = "ids", raw: str = "raw", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds column ``raw`` (binary) with the bytes that the ids stand for; null ids give no bytes."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    df = df.drop(raw)
    place = df.columns.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{raw}` binary"

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in (part for whole in batches for part in pieces(whole, place)):
            out = [own.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.uint32)) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, raw])

    return mapped(df, run, schema)


def encode_and_check(df: DataFrame, keep: list[str], text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns in keep, n_tokens, ids, and decoded_sha256: the digest of the bytes that the ids decode to. One pass, one Python worker for each task."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep) + ", n_tokens long, ids array<int>, decoded_sha256 string"

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in (part for whole in batches for part in pieces(whole, len(keep))):
            found = [own.encode(x or "") for x in batch.column(len(keep)).to_pylist()]
            count = np.array([len(x) for x in found], np.int64)
            offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int32)))
            decoded = [hashlib.sha256(own.decode(x)).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count), ids, pa.array(decoded, pa.string())], names=[*keep, "n_tokens", "ids", "decoded_sha256"])

    return mapped(rows, run, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass and returns the digests of both: key, n_tokens, ids_sha256, decoded_sha256."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for x in batch.column(1):
                found = own.encode(x.as_py() or "")
                counts.append(len(found))
                encoded.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(found)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
