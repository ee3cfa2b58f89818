"""Splitting: by separator, by byte set, by lines and by Unicode classes. Arrays out; ``explode_parts`` makes rows.

maxsplit counts all splits, also those whose part is dropped by skip_empty. A kept separator stays with the part before it
(splitting forward) or after it (backward).
"""

from __future__ import annotations

import pyspark.sql.functions as F
import regex
from pyspark.sql import Column, DataFrame

from .arrow import per_value
from .bytesview import Text, byte_class, col, quote, raw, unview, view

#: Code points with the White_Space property (fixed values).
WHITESPACE = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Line separators: LF, VT, FF, CR, NEL, LS, PS, and CR LF as one.
NEWLINE = "\\r\\n|[\\n\\u000B\\f\\r\\u0085\\u2028\\u2029]"
#: Punctuation, symbols, separators and white space, one code point each.
DELIMITER = f"[\\p{{P}}\\p{{S}}\\p{{Z}}{WHITESPACE}]"
_DELIMITERS = regex.compile(DELIMITER)


def _limit(maxsplit: int | None) -> int:
    return -1 if maxsplit is None or maxsplit < 0 else maxsplit + 1


def _forward(x: Column, pattern: str, maxsplit: int | None) -> Column:
    return F.split(x, pattern, _limit(maxsplit)) if maxsplit != 0 else F.array(x)


def split(x: Text, sep: str = " ", maxsplit: int | None = None, keepseparator: bool = False, skip_empty: bool = False) -> Column:
    if not sep:
        raise ValueError("empty separator")
    x = col(x)
    parts = _forward(x, quote(sep), maxsplit)
    return F.when(x.isNotNull(), _finish(parts, lambda i: F.lit(sep), keepseparator, skip_empty, True))


def rsplit(x: Text, sep: str = " ", maxsplit: int | None = None, keepseparator: bool = False, skip_empty: bool = False) -> Column:
    """Splits from the end; parts stand in the order of the text."""
    if not sep:
        raise ValueError("empty separator")
    x = col(x)
    parts = F.reverse(F.transform(_forward(F.reverse(x), quote(sep[::-1]), maxsplit), F.reverse))
    return F.when(x.isNotNull(), _finish(parts, lambda i: F.lit(sep), keepseparator, skip_empty, False))


def _finish(parts: Column, sep, keepseparator: bool, skip_empty: bool, before: bool) -> Column:
    """sep: the separator after part i, counted from 0."""
    if not keepseparator:
        return F.filter(parts, lambda p: p != "") if skip_empty else parts
    last = F.size(parts) - 1
    if before:
        joined = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.when(i < last, F.concat(p, sep(i))).otherwise(p).alias("k")))
    else:
        joined = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.concat(sep(i - 1), p)).otherwise(p).alias("k")))
    if skip_empty:
        joined = F.filter(joined, lambda s: s.p != "")
    return F.transform(joined, lambda s: s.k)


def _is_ascii(chars: str | bytes) -> bool:
    return all(b < 128 for b in raw(chars))


def split_byteset(x: Text, chars: str | bytes, maxsplit: int | None = None, keepseparator: bool = False, skip_empty: bool = False) -> Column:
    """Splits at any byte of the set. Strings for ASCII sets; BINARY parts otherwise, since characters may be cut."""
    return _byteset(x, chars, maxsplit, keepseparator, skip_empty, True)


def rsplit_byteset(x: Text, chars: str | bytes, maxsplit: int | None = None, keepseparator: bool = False, skip_empty: bool = False) -> Column:
    return _byteset(x, chars, maxsplit, keepseparator, skip_empty, False)


def _byteset(x: Text, chars, maxsplit, keepseparator, skip_empty, forward: bool) -> Column:
    if not raw(chars):
        raise ValueError("empty set of separators")
    ascii_only = _is_ascii(chars)
    y = col(x) if ascii_only else view(x)
    pattern = byte_class(chars)
    if forward:
        parts = _forward(y, pattern, maxsplit)
        skip = F.lit(0)
    else:
        parts = F.reverse(F.transform(_forward(F.reverse(y), pattern, maxsplit), F.reverse))
        skip = F.length(y) - F.length(F.translate(y, raw(chars).decode("latin-1"), "")) - (F.size(parts) - 1)
    seps = F.regexp_extract_all(y, F.lit(pattern), F.lit(0)) if keepseparator else None
    out = _finish(parts, lambda i: F.element_at(seps, (i + skip + 1).cast("int")), keepseparator, skip_empty, forward)
    return F.when(y.isNotNull(), out if ascii_only else F.transform(out, unview))


def splitlines(x: Text, keeplinebreaks: bool = False, maxsplit: int | None = None) -> Column:
    """Lines of a text: LF, VT, FF, CR and U+001C to U+001E each end a line; the last empty line is dropped."""
    return _lines(col(x), "\\n\\x0B\\f\\r\\x1C-\\x1E", keeplinebreaks, maxsplit, False)


def splitlines_bytes(x: Text, keeplinebreaks: bool = False, maxsplit: int | None = None) -> Column:
    """Lines of bytes, as BINARY: byte 85 ends a line too, even inside a character."""
    return _lines(view(x), "\\n\\x0B\\f\\r\\x85\\x1C-\\x1E", keeplinebreaks, maxsplit, True)


def _lines(y: Column, chars: str, keep: bool, maxsplit: int | None, binary: bool) -> Column:
    parts = _forward(y, f"[{chars}]", maxsplit)
    seps = F.regexp_extract_all(y, F.lit(f"[{chars}]"), F.lit(0)) if keep else None
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    if keep:
        ends = F.size(parts) - 1
        trimmed = F.transform(trimmed, lambda p, i: F.when(i < ends, F.concat(p, F.element_at(seps, i + 1))).otherwise(p))
    out = F.when(y.isNotNull(), trimmed)
    return F.transform(out, unview) if binary else out


def _tokens(x: Text, pattern: str, skip_empty: bool, with_separators: bool) -> Column:
    x = col(x)
    parts = F.split(x, pattern, -1)
    if with_separators:
        seps = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        parts = F.filter(F.flatten(F.zip_with(parts, seps, lambda p, s: F.array(p, s))), lambda p: p.isNotNull())
    if skip_empty:
        parts = F.filter(parts, lambda p: p != "")
    return F.when(x.isNotNull(), parts)


def newlines(x: Text) -> Column:
    """The line separators of a text, CR LF as one."""
    return F.regexp_extract_all(col(x), F.lit(f"({NEWLINE})"), F.lit(1))


def split_newlines(x: Text, skip_empty: bool = False, with_separators: bool = False) -> Column:
    return _tokens(x, NEWLINE, skip_empty, with_separators)


def whitespaces(x: Text) -> Column:
    """White space, one code point each."""
    return F.regexp_extract_all(col(x), F.lit(f"[{WHITESPACE}]"), F.lit(0))


def split_whitespaces(x: Text, skip_empty: bool = False, with_separators: bool = False) -> Column:
    return _tokens(x, f"[{WHITESPACE}]", skip_empty, with_separators)


def delimiters(x: Text) -> Column:
    return F.regexp_extract_all(col(x), F.lit(DELIMITER), F.lit(0))


def delimiters_bytes(x: Text) -> Column:
    """The delimiters of any bytes; bytes that aren't UTF-8 are passed over."""

    def run(data: bytes) -> list[str]:
        # They decode to lone surrogates, which are in no class of delimiters.
        return _DELIMITERS.findall(data.decode("utf-8", "surrogateescape"))

    return per_value(run, "array<string>", col(x).cast("binary"))


def split_delimiters(x: Text, skip_empty: bool = False, with_separators: bool = False) -> Column:
    return _tokens(x, DELIMITER, skip_empty, with_separators)


def explode_parts(df: DataFrame, parts: Column, name: str = "part", position: str = "pos", backward: bool = False) -> DataFrame:
    """One row for each part, with its place; the form of lazy iterators. backward: the last part comes first."""
    return df.select("*", F.posexplode(F.reverse(parts) if backward else parts).alias(position, name))
