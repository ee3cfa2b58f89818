"""The functions for SQL: ``register(spark)`` makes temporary functions in the session.

Byte functions are SQL functions, so Catalyst inlines them. Unicode kernels are Arrow functions, and ``text_segments`` is a
table function with a row for each segment, for use with LATERAL.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from . import hashing, segment, unicode

_VIEW = "decode(encode({}, 'UTF-8'), 'ISO-8859-1')"

#: name(arguments), type, body.
NATIVE = [
    ("byte_view(x STRING)", "STRING", _VIEW.format("x")),
    ("byte_find(x STRING, sub STRING)", "BIGINT", f"CAST(if(sub = '', 0, locate({_VIEW.format('sub')}, {_VIEW.format('x')}) - 1) AS BIGINT)"),
    ("byte_rfind(x STRING, sub STRING)", "BIGINT", f"CAST(CASE WHEN sub = '' THEN octet_length(x) WHEN contains(x, sub) THEN octet_length(x) - octet_length(sub) - (locate(reverse({_VIEW.format('sub')}), reverse({_VIEW.format('x')})) - 1) WHEN NOT contains(x, sub) THEN -1 END AS BIGINT)"),
    ("byte_count(x STRING, sub STRING)", "BIGINT", "CAST(if(sub = '', octet_length(x) + 1, (octet_length(x) - octet_length(replace(x, sub, ''))) div greatest(octet_length(sub), 1)) AS BIGINT)"),
    ("byte_sum(x STRING)", "BIGINT", f"aggregate(transform(split({_VIEW.format('x')}, ''), c -> CAST(ascii(c) AS BIGINT)), 0L, (a, b) -> a + b)"),
    ("utf8_seek(x STRING, n INT)", "BIGINT", "CAST(if(n <= char_length(x), octet_length(left(x, n)), NULL) AS BIGINT)"),
    ("byte_levenshtein(a STRING, b STRING)", "BIGINT", f"CAST(levenshtein({_VIEW.format('a')}, {_VIEW.format('b')}) AS BIGINT)"),
]


def _text(fn, kind: pa.DataType, spark_type: str):
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else fn(v) for v in x.to_pylist()], kind)

    return arrow_udf(run, spark_type)


def _hash64(x: pa.Array) -> pa.Array:
    there = [v.encode() for v in x.to_pylist() if v is not None]
    got = iter(hashing.hash_many(there).view(np.int64).tolist() if there else [])
    return pa.array([next(got) if v.is_valid else None for v in x], pa.int64())


class TextSegments:
    """pos, segment of a text; mode is graphemes, words, sentences or lines."""

    def eval(self, text: str, mode: str) -> Iterator[tuple[int, str]]:
        cut = {"graphemes": segment.graphemes, "words": segment.words, "sentences": segment.sentences, "lines": segment.line_breaks}.get(mode)
        if cut is None:
            raise ValueError(f"no such segments: {mode}")
        yield from enumerate(cut(text or ""))


def register(spark: SparkSession) -> list[str]:
    """Registers everything and returns the names."""
    for head, kind, body in NATIVE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    kernels = {"utf8_fold": _text(str.casefold, pa.string(), "string"), "hash64": arrow_udf(_hash64, "bigint")}
    for form in unicode.FORMS:
        kernels[f"utf8_{form.lower()}"] = _text(lambda t, f=form: unicodedata.normalize(f, t), pa.string(), "string")
    for name, kernel in kernels.items():
        spark.udf.register(name, kernel)
    spark.udtf.register("text_segments", udtf(TextSegments, returnType="pos: int, segment: string"))
    return [head.split("(")[0] for head, _, _ in NATIVE] + [*kernels, "text_segments"]
