"""AES-256: authenticated (GCM, native, also for a message in chunks) and seekable (counter mode, Arrow kernel)."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .aes import ctr_stream, expand_key
from .arrow import per_value
from .bytesview import Text, col

TAG = 16


def _bytes(x) -> Column:
    return x if isinstance(x, Column) else F.lit(bytes(x))


def gcm_encrypt(x: Text, key: bytes | Column, nonce: bytes | Column, associated: bytes | Column = b"") -> Column:
    """STRUCT<text BINARY, tag BINARY>; nonce of 12 bytes."""
    if isinstance(key, bytes) and len(key) != 32 or isinstance(nonce, bytes) and len(nonce) != 12:
        raise ValueError("AES-256-GCM takes a key of 32 and a nonce of 12 bytes")
    sealed = F.aes_encrypt(col(x).cast("binary"), _bytes(key), F.lit("GCM"), F.lit("DEFAULT"), _bytes(nonce), _bytes(associated))
    n = F.octet_length(sealed)
    return F.struct(F.substring(sealed, F.lit(13), n - 12 - TAG).alias("text"), F.substring(sealed, n - TAG + 1, F.lit(TAG)).alias("tag"))


def _sealed(text: Column, tag: Column, nonce) -> Column:
    return F.concat(_bytes(nonce), text, tag)


def gcm_decrypt(text: Text, tag: Text, key: bytes | Column, nonce: bytes | Column, associated: bytes | Column = b"") -> Column:
    """The plain bytes; a forged text, tag or associated data is an error."""
    return F.aes_decrypt(_sealed(col(text), col(tag), nonce), _bytes(key), F.lit("GCM"), F.lit("DEFAULT"), _bytes(associated))


def try_gcm_decrypt(text: Text, tag: Text, key: bytes | Column, nonce: bytes | Column, associated: bytes | Column = b"") -> Column:
    """Like gcm_decrypt, but null where authentication fails."""
    return F.try_aes_decrypt(_sealed(col(text), col(tag), nonce), _bytes(key), F.lit("GCM"), F.lit("DEFAULT"), _bytes(associated))


def _chunked(df: DataFrame, key: str, order: str, chunk: str, whole) -> DataFrame:
    """One row for each key: its chunks in order, where each begins, and whole (a function of the chunks put together)."""
    parts = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(chunk).cast("binary"), F.lit(b"")).alias("_c")))).alias("_parts"))
    joined = F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["_c"])), ""))
    starts = F.aggregate("_parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(p["_c"]))))
    return parts.select(key, "_parts", starts.alias("_starts"), whole(joined).alias("_whole"))


def _cut(rows: DataFrame, key: str, order: str, chunk: str, text: Column, *more: Column) -> DataFrame:
    """Back to a row for each chunk: its slice of text."""
    each = rows.select(key, F.posexplode("_parts").alias("_i", "_p"), "_starts", text.alias("_text"), *more)
    n = F.octet_length(F.col("_p")["_c"])
    return each.select(key, F.col("_p")[order].alias(order), F.substring(F.col("_text"), F.get("_starts", F.col("_i")) + 1, n).alias(chunk), *(c for c in each.columns if c not in (key, "_i", "_p", "_starts", "_text")))


def gcm_encrypt_chunks(df: DataFrame, key: str, order: str, chunk: str, secret: bytes, nonce: bytes, associated: bytes = b"") -> DataFrame:
    """key, order, chunk (sealed), tag: every key's chunks, in order, are one message, sealed as a stream would be; the tag is the message's.
    A message is a row for a while, so it must fit into one."""
    rows = _chunked(df, key, order, chunk, lambda x: gcm_encrypt(x, secret, nonce, associated))
    return _cut(rows, key, order, chunk, F.col("_whole.text"), F.col("_whole.tag").alias("tag"))


def gcm_decrypt_chunks(df: DataFrame, key: str, order: str, chunk: str, tag: str, secret: bytes, nonce: bytes, associated: bytes = b"") -> DataFrame:
    """key, order, chunk (plain), verified: the other way round; where the tag doesn't fit, verified is false and chunks are null."""
    tags = df.groupBy(key).agg(F.min(tag).alias("_tag"))
    rows = _chunked(df, key, order, chunk, lambda x: x).join(tags, key)
    opened = rows.withColumn("_open", try_gcm_decrypt("_whole", "_tag", secret, nonce, associated))
    return _cut(opened, key, order, chunk, F.col("_open"), F.col("_open").isNotNull().alias("verified"))


def ctr_xor(x: Text, key: bytes, nonce: bytes, byte_offset: int | Text = 0) -> Column:
    """Counter mode, either way: x is XORed with the key stream from byte_offset on."""
    keys = expand_key(key)

    def run(data, first):
        return (np.frombuffer(data, np.uint8) ^ ctr_stream(keys, nonce, first, len(data))).tobytes()

    offset = F.lit(byte_offset) if isinstance(byte_offset, int) else col(byte_offset)
    return per_value(run, "binary", col(x).cast("binary"), offset.cast("long"))
