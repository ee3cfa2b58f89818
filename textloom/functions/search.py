"""Search in strings and bytes: substrings, byte sets, counting, comparing, partitioning.

Offsets and lengths are in bytes, missing is -1, windows are Python slices of bytes; a window that begins after its end
or after the text finds nothing, not even an empty needle. Null in, null out.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .bytesview import Text, byte_class, col, needle, quote, raw, view, window


def contains(x: Text, sub: str | Column, start: int = 0, end: int | None = None) -> Column:
    """Whether x[start:end] holds sub. Without a window this is the plain predicate, which reaches the Parquet reader."""
    if start == 0 and end is None:
        return F.contains(col(x), sub if isinstance(sub, Column) else F.lit(sub))
    part, _, _, ok = window(x, start, end)
    return ok & F.contains(part, needle(sub))


def startswith(x: Text, sub: str | Column, start: int = 0, end: int | None = None) -> Column:
    if start == 0 and end is None:
        return col(x).startswith(sub)
    part, _, _, ok = window(x, start, end)
    return ok & F.startswith(part, needle(sub))


def endswith(x: Text, sub: str | Column, start: int = 0, end: int | None = None) -> Column:
    if start == 0 and end is None:
        return col(x).endswith(sub)
    part, _, _, ok = window(x, start, end)
    return ok & F.endswith(part, needle(sub))


def equal(a: Text, b: Text) -> Column:
    """Equality of bytes; STRING and BINARY may be mixed."""
    return col(a).cast("binary") == col(b).cast("binary")


def order(a: Text, b: Text) -> Column:
    """-1, 0 or 1: order of the bytes, a prefix first."""
    a, b = col(a).cast("binary"), col(b).cast("binary")
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0).cast("int")


def _found(pos: Column, first: Column) -> Column:
    return F.when(pos > 0, pos - 1 + first).when(pos == 0, F.lit(-1))


def find(x: Text, sub: str | bytes | Column, start: int = 0, end: int | None = None) -> Column:
    """Byte offset of the first sub in x[start:end]; an empty sub is found at the window's start.

    A str without a window is sought in the STRING as it is; bytes, columns and windows go by the byte view."""
    if isinstance(sub, str) and sub and start == 0 and end is None:
        return F.when(F.contains(col(x), F.lit(sub)), F.octet_length(F.substring_index(col(x), sub, 1))).when(~F.contains(col(x), F.lit(sub)), F.lit(-1)).cast("long")
    part, first, _, ok = window(x, start, end)
    n = needle(sub)
    return F.when(~ok, F.lit(-1)).when(F.length(n) == 0, first).otherwise(_found(F.position(n, part), first)).cast("long")


def rfind(x: Text, sub: str | bytes | Column, start: int = 0, end: int | None = None) -> Column:
    """Byte offset of the last sub in x[start:end]; an empty sub is found at the window's end."""
    if isinstance(sub, str) and sub and start == 0 and end is None:
        at = F.octet_length(col(x)) - F.octet_length(F.substring_index(col(x), sub, -1)) - len(raw(sub))
        return F.when(F.contains(col(x), F.lit(sub)), at).when(~F.contains(col(x), F.lit(sub)), F.lit(-1)).cast("long")
    part, first, last, ok = window(x, start, end)
    n = needle(sub)
    back = F.position(F.reverse(n), F.reverse(part))
    at = F.when(back > 0, F.length(part) - F.length(n) - (back - 1) + first).when(back == 0, F.lit(-1))
    return F.when(~ok, F.lit(-1)).when(F.length(n) == 0, last).otherwise(at).cast("long")


def _required(at: Column) -> Column:
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("long")).otherwise(at)


def index(x: Text, sub: str | bytes | Column, start: int = 0, end: int | None = None) -> Column:
    """Like find, but a missing sub is an error."""
    return _required(find(x, sub, start, end))


def rindex(x: Text, sub: str | bytes | Column, start: int = 0, end: int | None = None) -> Column:
    return _required(rfind(x, sub, start, end))


def find_byte(x: Text, byte: int) -> Column:
    return find(x, bytes([byte]))


def rfind_byte(x: Text, byte: int) -> Column:
    return rfind(x, bytes([byte]))


def _first(x: Text, pattern: str, start: int, end: int | None) -> Column:
    part, first, _, ok = window(x, start, end)
    return F.when(~ok, F.lit(-1)).otherwise(_found(F.regexp_instr(part, F.lit(pattern)), first)).cast("long")


def _last(x: Text, pattern: str, start: int, end: int | None) -> Column:
    part, first, _, ok = window(x, start, end)
    back = F.regexp_instr(F.reverse(part), F.lit(pattern))
    return F.when(~ok, F.lit(-1)).otherwise(F.when(back > 0, F.length(part) - back + first).when(back == 0, F.lit(-1))).cast("long")


def find_first_of(x: Text, chars: str | bytes, start: int = 0, end: int | None = None) -> Column:
    """Offset of the first byte that is in the set; -1 for an empty set."""
    return _first(x, byte_class(chars), start, end)


def find_last_of(x: Text, chars: str | bytes, start: int = 0, end: int | None = None) -> Column:
    return _last(x, byte_class(chars), start, end)


def find_first_not_of(x: Text, chars: str | bytes, start: int = 0, end: int | None = None) -> Column:
    """Offset of the first byte that isn't in the set; any byte for an empty set."""
    return _first(x, byte_class(chars, True), start, end)


def find_last_not_of(x: Text, chars: str | bytes, start: int = 0, end: int | None = None) -> Column:
    return _last(x, byte_class(chars, True), start, end)


def count(x: Text, sub: str | bytes, start: int = 0, end: int | None = None, allowoverlap: bool = False) -> Column:
    """Occurrences of sub; an empty sub occurs once more than the window has bytes."""
    n = raw(sub).decode("latin-1")
    part, _, _, ok = window(x, start, end)
    if not n:
        found = F.length(part) + 1
    elif allowoverlap and len(n) > 1:
        found = F.regexp_count(part, F.lit(f"(?={quote(n)})"))
    elif start == 0 and end is None:
        x = col(x).cast("binary") if isinstance(sub, bytes) else col(x)
        found = (F.length(part) - F.length(F.replace(part, F.lit(n), F.lit("")))) / len(n) if isinstance(sub, bytes) else (F.octet_length(x) - F.octet_length(F.replace(x.cast("string"), F.lit(sub), F.lit("")))) / len(n)
    else:
        found = (F.length(part) - F.length(F.replace(part, F.lit(n), F.lit("")))) / len(n)
    return F.when(ok, found).otherwise(F.lit(0)).cast("long")


def count_byteset(x: Text, chars: str | bytes, start: int = 0, end: int | None = None) -> Column:
    """Bytes that are in the set."""
    part, _, _, ok = window(x, start, end)
    found = F.length(part) - F.length(F.translate(part, raw(chars).decode("latin-1"), "")) if raw(chars) else F.lit(0)
    return F.when(ok, found).otherwise(F.lit(0)).cast("long")


def matches(x: Text, sub: str | bytes, overlapping: bool = True, backward: bool = False) -> Column:
    """Byte offsets of all matches, as an array; disjoint ones are taken from the side where the search begins."""
    n = raw(sub).decode("latin-1")
    if not n:
        raise ValueError("an empty pattern has no matches to list")
    part = view(x)
    if backward:
        part, n = F.reverse(part), n[::-1]
    size = len(n)
    # The text before each match has a length; matches of the plain scan are where split cuts.
    if overlapping:
        pieces = F.transform(F.split(part, f"(?={quote(n)})", -1), lambda p: F.length(p))
        starts = F.slice(F.aggregate(pieces, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p))), 1, F.size(pieces))
        found = F.filter(starts, lambda s: F.substring(part, s + 1, F.lit(size)) == n)
    else:
        pieces = F.transform(F.split(part, quote(n), -1), lambda p: F.length(p))
        ends = F.aggregate(pieces, F.array(F.lit(-size)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p + size)))
        found = F.slice(ends, 2, F.size(pieces) - 1)
    if backward:
        found = F.transform(found, lambda s: F.length(part) - s - size)
    return F.transform(found, lambda s: s.cast("long"))


def partition(x: Text, sep: str) -> Column:
    """head, sep, tail around the first sep; the whole text as head if there is none."""
    if not sep:
        raise ValueError("empty separator")
    x = col(x)
    head = F.substring_index(x, sep, 1)
    return F.when(F.contains(x, F.lit(sep)), _parts(head, F.lit(sep), F.substring(x, F.length(head) + len(sep) + 1, F.length(x)))).when(x.isNotNull(), _parts(x, F.lit(""), F.lit("")))


def rpartition(x: Text, sep: str) -> Column:
    """head, sep, tail around the last sep; the whole text as tail if there is none."""
    if not sep:
        raise ValueError("empty separator")
    x = col(x)
    tail = F.reverse(F.substring_index(F.reverse(x), sep[::-1], 1))
    return F.when(F.contains(x, F.lit(sep)), _parts(F.left(x, F.length(x) - F.length(tail) - len(sep)), F.lit(sep), tail)).when(x.isNotNull(), _parts(F.lit(""), F.lit(""), x))


def _parts(head: Column, sep: Column, tail: Column) -> Column:
    return F.struct(head.alias("head"), sep.alias("sep"), tail.alias("tail"))


def offset_within(part: Text, larger: Text) -> Column:
    """Where part's bytes first lie in larger, or -1."""
    return find(larger, col(part))
