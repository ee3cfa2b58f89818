"""Incremental digests: of ordered chunks in a table, and of chunks that arrive in a stream."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.hashing import Hasher


def sha256_of_chunks(df: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """key, sha256: digest of each key's chunks in order, natively."""
    ordered = F.array_sort(F.collect_list(F.struct(order, chunk)))
    joined = F.concat_ws("", F.transform(ordered, lambda x: x[chunk]))
    return df.groupBy(key).agg(F.sha2(joined.cast("binary"), 256).alias("sha256"))


def hash_of_chunks(df: DataFrame, key: str, order: str, chunk: str, seed: int = 0) -> DataFrame:
    """key, hash, sha256: digests fed chunk by chunk; a key's chunks are sorted and streamed through, not joined."""
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(chunk).cast("binary").alias("c"))
    schema = f"`{key}` {dict(rows.dtypes)['k']}, hash long, sha256 string"

    def run(batches):
        now, h, sha = None, None, None
        out: list[tuple] = []
        close = lambda: out.append((now[0], h.digest() - (1 << 64) * (h.digest() >= 1 << 63), sha.hexdigest()))
        for pdf in batches:
            for k, c in zip(pdf["k"], pdf["c"], strict=True):
                if now is None or now[0] != k:
                    if now is not None:
                        close()
                    now, h, sha = (k,), Hasher(seed), hashlib.sha256()
                if c is not None:
                    h.update(bytes(c))
                    sha.update(bytes(c))
            if out:
                yield pd.DataFrame(out, columns=[key, "hash", "sha256"])
                out = []
        if now is not None:
            close()
            yield pd.DataFrame(out, columns=[key, "hash", "sha256"])

    return rows.repartition("k").sortWithinPartitions("k", "o").mapInPandas(run, schema)


def running_hash(stream: DataFrame, key: str, chunk: str, seed: int = 0) -> DataFrame:
    """key, hash, length after each micro-batch; the state is the hasher's 200 odd bytes, kept for each key.

    Chunks of a key are taken in the order of the column ``seq`` within a micro-batch."""
    rows = stream.select(F.col(key).cast("string").alias("k"), F.col("seq").cast("long").alias("seq"), F.col(chunk).cast("binary").alias("c"))

    def step(k, parts, state):
        h = Hasher.load(bytes(state.get[0])) if state.exists else Hasher(seed)
        whole = pd.concat(list(parts)).sort_values("seq")
        for c in whole["c"]:
            if c is not None:
                h.update(bytes(c))
        state.update((bytearray(h.dump()),))
        d = h.digest()
        yield pd.DataFrame({"k": [k[0]], "hash": [d - (1 << 64) * (d >= 1 << 63)], "length": [h.length]})

    return rows.groupBy("k").applyInPandasWithState(step, "k string, hash long, length long", "state binary", "update", GroupStateTimeout.NoTimeout)
