"""The byte view: every byte of a value becomes the code point of the same number, so string functions count bytes.

``view`` keeps everything inside the JVM. Booleans never need it (for valid UTF-8 a byte match is a character match); use it
only where offsets, lengths or single bytes are asked for.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def view(x: Text) -> Column:
    """The byte view of a STRING (its UTF-8 bytes) or BINARY column."""
    return F.decode(col(x).cast("binary"), "ISO-8859-1")


def unview(x: Column) -> Column:
    """BINARY from a byte view."""
    return F.encode(x, "ISO-8859-1")


def raw(value: str | bytes) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


def needle(value: str | bytes | Column) -> Column:
    """The byte view of a needle: a Python value or a column."""
    return view(value) if isinstance(value, Column) else F.lit(raw(value).decode("latin-1"))


def quote(text: str) -> str:
    """A regular expression that matches the text literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else ""


def byte_class(chars: str | bytes, negated: bool = False) -> str:
    """A regular expression class over the byte view; matches nothing (or everything) for an empty set."""
    found = sorted(set(raw(chars)))
    if not found:
        return "[\\x00-\\xFF]" if negated else "(?!)"
    return ("[^" if negated else "[") + "".join(f"\\x{b:02X}" for b in found) + "]"


class ByteSet(frozenset):
    """A set of byte values with union (``|``), complement and membership, usable wherever a set of characters is."""

    def __new__(cls, chars: str | bytes | set[int] = b""):
        return super().__new__(cls, chars if isinstance(chars, set | frozenset) else raw(chars))

    def __or__(self, other):
        return ByteSet(frozenset(self) | frozenset(other))

    def inverted(self) -> ByteSet:
        return ByteSet(frozenset(range(256)) - self)

    def __bytes__(self) -> bytes:
        return bytes(sorted(self))


def window(x: Text, start: int = 0, end: int | None = None) -> tuple[Column, Column, Column, Column]:
    """Byte view of x[start:end], its first and last byte offset, and whether the window is valid (first <= last <= length)."""
    whole = view(x)
    if start == 0 and end is None:
        n = F.length(whole)
        return whole, F.lit(0), n, F.lit(True)
    n = F.length(whole)
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    last = n if end is None else F.least(F.lit(end), n) if end >= 0 else F.greatest(n + end, F.lit(0))
    return F.substring(whole, first + 1, F.greatest(last - first, F.lit(0))), first, last, first <= last
