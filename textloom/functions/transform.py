"""Strings to strings: slicing, stripping, byte translation, replacing, ASCII classes."""

from __future__ import annotations

import string

import pyspark.sql.functions as F
from pyspark.sql import Column

from .bytesview import Text, byte_class, col, raw, unview, view

#: White space that strip removes by default.
SPACES = " \t\n\r\f\v"
#: ASCII classes, by name.
CLASSES = {
    "letters": string.ascii_letters, "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "digits": string.digits, "hex": string.hexdigits, "oct": string.octdigits, "punctuation": string.punctuation, "printable": string.printable, "whitespace": SPACES,
    "newlines": "\n\r\f\v\x1c\x1d\x1e\x85", "controls": "".join(map(chr, [*range(32), 127])), "base64": string.ascii_letters + string.digits + "+/",
}


def slice_bytes(x: Text, start: int | None = None, end: int | None = None) -> Column:
    """x[start:end] in bytes, as BINARY; signs as in Python."""
    b = col(x).cast("binary")
    n = F.octet_length(b)
    clip = lambda i, missing: missing if i is None else F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))
    first, last = clip(start, F.lit(0)), clip(end, n)
    return F.substring(b, first + 1, F.greatest(last - first, F.lit(0)))


def front(x: Text, end: int) -> Column:
    """The bytes before end, which may count from the back."""
    return slice_bytes(x, None, end)


def back(x: Text, start: int) -> Column:
    """The bytes from start on, which may count from the back."""
    return slice_bytes(x, start)


def byte_length(x: Text) -> Column:
    return F.octet_length(col(x)).cast("long")


def concat(*parts: Text) -> Column:
    return F.concat(*map(col, parts))


def remove_prefix(x: Text, prefix: str) -> Column:
    x = col(x)
    return F.when(x.startswith(prefix), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x) if prefix else x


def remove_suffix(x: Text, suffix: str) -> Column:
    x = col(x)
    return F.when(x.endswith(suffix), F.left(x, F.length(x) - len(suffix))).otherwise(x) if suffix else x


def strip(x: Text, chars: str = SPACES) -> Column:
    return F.btrim(col(x), F.lit(chars)) if chars else col(x)


def lstrip(x: Text, chars: str = SPACES) -> Column:
    return F.ltrim(col(x), F.lit(chars)) if chars else col(x)


def rstrip(x: Text, chars: str = SPACES) -> Column:
    return F.rtrim(col(x), F.lit(chars)) if chars else col(x)


def translate(x: Text, table: bytes | dict[str, str]) -> Column:
    """Maps bytes by a table of 256, or by a dict of characters, of which the first UTF-8 byte counts.

    STRING if only ASCII bytes change, and to ASCII; BINARY otherwise."""
    if isinstance(table, dict):
        pairs = {raw(k)[0]: raw(v)[0] for k, v in table.items()}
    else:
        if len(table) != 256:
            raise ValueError("a table has 256 bytes")
        pairs = {i: b for i, b in enumerate(table) if i != b}
    pairs = {k: v for k, v in pairs.items() if k != v}
    source, target = bytes(pairs).decode("latin-1"), bytes(pairs.values()).decode("latin-1")
    if all(k < 128 and v < 128 for k, v in pairs.items()):
        return F.translate(col(x), source, target) if pairs else col(x)
    return unview(F.translate(view(x), source, target))


def ascii_lower(x: Text) -> Column:
    return F.translate(col(x), string.ascii_uppercase, string.ascii_lowercase)


def ascii_upper(x: Text) -> Column:
    return F.translate(col(x), string.ascii_lowercase, string.ascii_uppercase)


def replace_all(x: Text, pattern: str, by: str) -> Column:
    """All disjoint occurrences, from the left; an empty pattern changes nothing."""
    return F.replace(col(x), F.lit(pattern), F.lit(by)) if pattern else col(x)


def replace_byteset(x: Text, chars: str | bytes, by: str) -> Column:
    """Each byte of the set. STRING for ASCII sets, BINARY otherwise."""
    literal = by.replace("\\", "\\\\").replace("$", "\\$")
    if all(b < 128 for b in raw(chars)):
        return F.regexp_replace(col(x), byte_class(chars), literal)
    return unview(F.regexp_replace(view(x), byte_class(chars), raw(by).decode("latin-1").replace("\\", "\\\\").replace("$", "\\$")))


def insert(x: Text, at: int, what: str) -> Column:
    """what before the byte at; characters aren't cut for valid positions."""
    b = col(x).cast("binary")
    return F.concat(F.substring(b, F.lit(1), F.lit(at)), F.lit(raw(what)), F.substring(b, F.lit(at + 1), F.octet_length(b)))


def erase(x: Text, at: int, size: int) -> Column:
    b = col(x).cast("binary")
    return F.concat(F.substring(b, F.lit(1), F.lit(at)), F.substring(b, F.lit(at + size + 1), F.octet_length(b)))


def fill(x: Text, byte: int) -> Column:
    """As many bytes as x has, all equal."""
    return unview(F.repeat(F.lit(chr(byte)), F.octet_length(col(x))))


def resize(x: Text, size: int, byte: int = 0) -> Column:
    return unview(F.rpad(view(x), size, chr(byte)))


def decode(x: Text, encoding: str = "UTF-8", errors: str = "strict") -> Column:
    """Bytes to text: strict fails on malformed bytes, replace puts U+FFFD in their place, ignore gives null."""
    b = col(x).cast("binary")
    if errors == "strict":
        return F.decode(b, encoding)
    if encoding.upper().replace("-", "") != "UTF8":
        raise ValueError("only UTF-8 can be malformed here")
    s = b.cast("string")
    return F.make_valid_utf8(s) if errors == "replace" else F.try_validate_utf8(s)


def contains_only(x: Text, chars: str) -> Column:
    """Whether x isn't empty and has only characters of the set."""
    return (col(x) != "") & (F.btrim(col(x), F.lit(chars)) == "") if chars else F.lit(False) & col(x).isNotNull()


def _only(x: Text, pattern: str) -> Column:
    return col(x).rlike(f"\\A(?:{pattern})\\z")


def is_alpha(x: Text) -> Column:
    return _only(x, "[A-Za-z]+")


def is_alnum(x: Text) -> Column:
    return _only(x, "[A-Za-z0-9]+")


def is_digit(x: Text) -> Column:
    return _only(x, "[0-9]+")


def is_lower(x: Text) -> Column:
    return _only(x, "[a-z]+")


def is_upper(x: Text) -> Column:
    return _only(x, "[A-Z]+")


def is_space(x: Text) -> Column:
    return _only(x, "[ \\t\\n\\r\\f\\x0B]+")


def is_ascii(x: Text) -> Column:
    return _only(x, "[\\x00-\\x7F]*")


def is_printable(x: Text) -> Column:
    return _only(x, "[\\x20-\\x7E\\t\\n\\r\\f\\x0B]*")
