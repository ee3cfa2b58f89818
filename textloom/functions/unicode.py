"""Unicode: case folding and caseless search, normal forms, code points, and segments as arrays of strings.

Native where Spark has the semantics; otherwise Arrow kernels over Python's tables (casefold and unicodedata of the running
interpreter, segment properties of the ``regex`` module).
"""

from __future__ import annotations

import contextlib
import functools
import sys
import unicodedata

import pyspark.sql.functions as F
from pyspark.sql import Column

from . import segment
from .arrow import per_value
from .bytesview import Text, col

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _plain(x: Column) -> Column:
    """Whether a STRING is ASCII: as many characters as bytes. Lone continuation bytes count as characters of their own, so a
    malformed text can pass; kernels that take any bytes don't use this."""
    return F.octet_length(x) == F.char_length(x)


_NATIVE = [True]


@contextlib.contextmanager
def kernels_only():
    """Within it, functions make columns that go through their Arrow kernels even where there is a native way: to hold both against each
    other."""
    _NATIVE.append(False)
    try:
        yield
    finally:
        _NATIVE.pop()


def _beyond_ascii(x: Column, native: Column, kernel) -> Column:
    """native for ASCII texts, which stay inside the JVM, and kernel (a function of a column) for the others; the kernel sees nulls
    in place of ASCII texts."""
    if not _NATIVE[-1]:
        return kernel(x)
    return F.when(_plain(x), native).otherwise(kernel(F.when(~_plain(x), x)))


# Case


def fold(x: Text) -> Column:
    """Full case folding, as STRING."""
    x = col(x).cast("string")
    return _beyond_ascii(x, F.lower(x), lambda t: per_value(str.casefold, "string", t))


def fold_bytes(x: Text) -> Column:
    """Full case folding of any bytes, as BINARY; bytes that aren't UTF-8 stay as they are, each on its own."""
    return per_value(lambda b: b.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape"), "binary", col(x).cast("binary"))


def _folded(text: str) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters the place of the one it comes from."""
    parts, source = [], []
    for i, c in enumerate(text):
        f = c.casefold()
        parts.append(f)
        source += [i] * len(f)
    return "".join(parts), source


def uncased_find(text: str, needle: str, start: int = 0, end: int | None = None) -> int:
    """Place of the code point where the first caseless match begins, or -1; a match may begin inside an expansion."""
    first, last, _ = slice(start, end).indices(len(text))
    if start > len(text) or first > last:
        return -1
    if text.isascii() and needle.isascii():
        return text.lower().find(needle.lower(), first, last)
    folded, source = _folded(text[first:last])
    at = folded.find(needle.casefold())
    if not needle:
        return first
    return -1 if at < 0 else first + source[at]


def uncased_regions(text: str, needle: str, overlapping: bool = False) -> list[tuple[int, int]]:
    """Place and length, in code points, of all caseless matches; none for an empty needle."""
    folded, source = _folded(text)
    n, out, at = needle.casefold(), [], 0
    while n and (at := folded.find(n, at)) >= 0:
        first, last = source[at], source[at + len(n) - 1]
        out.append((first, last - first + 1))
        until = first if overlapping else last
        while at < len(source) and source[at] <= until:
            at += 1
    return out


def _whole(start: int, end: int | None) -> bool:
    return start == 0 and end is None


def uncased_search(x: Text, needle: str, start: int = 0, end: int | None = None) -> Column:
    """Code point offset of the first caseless match, or -1."""
    x = col(x)
    kernel = lambda t: per_value(lambda v: uncased_find(v, needle, start, end), "bigint", t)
    if not _whole(start, end):
        return kernel(x)
    return _beyond_ascii(x, F.locate(needle.casefold(), F.lower(x)).cast("long") - 1, kernel)


def uncased_search_bytes(x: Text, needle: str) -> Column:
    """Byte offset of the first caseless match, or -1."""

    def run(t: str) -> int:
        at = uncased_find(t, needle)
        return at if at < 0 else len(t[:at].encode())

    x = col(x).cast("string")
    return _beyond_ascii(x, F.locate(needle.casefold(), F.lower(x)).cast("long") - 1, lambda t: per_value(run, "bigint", t))


def uncased_contains(x: Text, needle: str) -> Column:
    """Whether there is a caseless match. Needles without cased characters are plain, native predicates."""
    x = col(x)
    if not any(map(is_cased, needle)):
        return F.contains(x, F.lit(needle))
    return _beyond_ascii(x, F.contains(F.lower(x), F.lit(needle.casefold())), lambda t: per_value(lambda v: needle.casefold() in v.casefold(), "boolean", t))


def uncased_matches(x: Text, needle: str, overlapping: bool = False) -> Column:
    return per_value(lambda t: [{"offset": a, "length": n} for a, n in uncased_regions(t, needle, overlapping)], "array<struct<offset:bigint,length:bigint>>", x)


class Needle:
    """A needle for many caseless searches: what it is folded to, and whether it needs folding at all, is settled once."""

    def __init__(self, text: str):
        self.text, self.folded, self.cased = text, text.casefold(), any(map(is_cased, text))

    def find(self, x: Text) -> Column:
        """Code point offset of the first match, or -1. A needle without cased characters is found natively."""
        return uncased_search(x, self.text) if self.cased else F.locate(self.text, col(x)).cast("long") - 1

    def contains(self, x: Text) -> Column:
        return uncased_contains(x, self.text)

    def matches(self, x: Text, overlapping: bool = False) -> Column:
        return uncased_matches(x, self.text, overlapping)


def uncased_order(a: Text, b: Text) -> Column:
    """-1, 0 or 1: order of the folded texts' code points."""
    x, y = fold(a).cast("binary"), fold(b).cast("binary")
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0).cast("int")


@functools.cache
def _cased() -> frozenset[str]:
    out: set[str] = set()
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        f = c.casefold()
        if f != c:
            out.add(c)
            out.update(f)
    return frozenset(out)


def is_cased(c: str) -> bool:
    """Whether the character takes part in case folding, as source or as part of a result."""
    return c in _cased()


def find_cased(x: Text) -> Column:
    """Byte offset of the first character that takes part in case folding; null if there is none."""

    def run(t: str):
        at = next((i for i, c in enumerate(t) if is_cased(c)), None)
        return None if at is None else len(t[:at].encode())

    return per_value(run, "bigint", x)


# Normal forms


def norm(x: Text, form: str = "NFC") -> Column:
    if form not in FORMS:
        raise ValueError(f"no normal form: {form}")
    x = col(x)
    return _beyond_ascii(x, x, lambda t: per_value(lambda v: unicodedata.normalize(form, v), "string", t))


def norm_bytes(x: Text, form: str = "NFC") -> Column:
    """The normal form of any bytes, as BINARY; a byte that isn't UTF-8 stays as it is and parts what stands on its sides."""
    if form not in FORMS:
        raise ValueError(f"no normal form: {form}")
    return per_value(lambda b: unicodedata.normalize(form, b.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape"), "binary", col(x).cast("binary"))


def is_norm(x: Text, form: str = "NFC") -> Column:
    x = col(x)
    return _beyond_ascii(x, F.lit(True), lambda t: per_value(lambda v: unicodedata.is_normalized(form, v), "boolean", t))


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters of class 0 that compose with the one before."""
    out = {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for i in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(i)).split()
        if len(d) == 2 and not d[0].startswith("<") and not unicodedata.combining(chr(int(d[1], 16))):
            out.add(chr(int(d[1], 16)))
    return frozenset(out)


def denormalized_at(text: str, form: str) -> int | None:
    """Byte offset of the first segment, begun by a starter, that normalization changes."""
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not unicodedata.combining(text[i]) and text[i] not in _seconds():
            part = text[start:i]
            if not part.isascii() and unicodedata.normalize(form, part) != part:
                return len(text[:start].encode())
            start = i
    return None


def find_denormalized(x: Text, form: str = "NFC") -> Column:
    x = col(x)
    return _beyond_ascii(x, F.lit(None).cast("long"), lambda t: per_value(lambda v: None if unicodedata.is_normalized(form, v) else denormalized_at(v, form), "bigint", t))


# Code points


def count_codepoints(x: Text) -> Column:
    return F.char_length(col(x)).cast("long")


def codepoints(x: Text) -> Column:
    x = col(x)
    return F.when(x == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(x, "", -1), F.ascii))


def codepoints_bytes(x: Text) -> Column:
    """The code points of any bytes; each maximal part of an ill-formed sequence is one U+FFFD."""
    return codepoints(F.make_valid_utf8(col(x).cast("binary").cast("string")))


def seek(x: Text, n: int) -> Column:
    """Byte offset of the n-th code point (from 0); null beyond the text."""
    x = col(x)
    return F.when(F.lit(n) <= F.char_length(x), F.octet_length(F.left(x, F.lit(n)))).cast("long")


# Segments


def graphemes(x: Text) -> Column:
    """Grapheme clusters, natively."""
    return F.regexp_extract_all(col(x), F.lit("(\\X)"), F.lit(1))


def wordbreaks(x: Text) -> Column:
    return per_value(segment.words, "array<string>", x)


def sentences(x: Text) -> Column:
    return per_value(segment.sentences, "array<string>", x)


def linebreaks(x: Text) -> Column:
    return per_value(segment.line_breaks, "array<string>", x)


def word_break_property(x: Text) -> Column:
    """The word break class of the first character."""
    return per_value(lambda t: segment.class_of("WB", t[0]) if t else None, "string", x)


def is_word_char(x: Text) -> Column:
    return per_value(lambda t: bool(t) and segment.is_word_char(t[0]), "boolean", x)


def spans(parts: Column) -> Column:
    """offset and length in bytes, and text, of parts that tile a text."""
    sized = F.transform(parts, lambda p: F.octet_length(p))
    starts = F.aggregate(sized, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return F.zip_with(F.slice(starts, 1, F.size(parts)), parts, lambda s, p: F.struct(s.cast("long").alias("offset"), F.octet_length(p).cast("long").alias("length"), p.alias("text")))
