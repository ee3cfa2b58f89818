"""Vectorised views of the texts in an Arrow batch: bytes, words and hashes of word sequences, without Python strings.

Words are maximal runs of bytes other than U+0020 and U+0009 to U+000D. A null text counts as an empty one. Batches
are cut into chunks of about ``CHUNK`` bytes, so memory stays bounded by the larger of that and one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_STEP = 0xD1342543DE82EF95


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, step in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, step, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Chunk:
    """Some consecutive texts of a batch: rows first to last (excluded), their bytes and offsets."""

    def __init__(self, first: int, raw: np.ndarray, offsets: np.ndarray):
        self.first, self.raw, self.offsets = first, raw, offsets
        self.n = len(offsets) - 1
        self._words()

    def _words(self) -> None:
        raw, n = self.raw, len(self.raw)
        space = _IS_SPACE[raw]
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        begins[n] = True
        begins[0] = True
        start = ~space
        start[1:] &= space[:-1] | begins[1:n]
        end = ~space
        end[:-1] &= space[1:] | begins[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        bounds = np.searchsorted(self.starts, self.offsets)
        self.first_word = bounds  # of each text, and the end of the last
        self.n_words = np.diff(bounds)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        up, down = _BYTE_POWERS.upto(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def gram_hashes(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """64-bit hash of the k words from each word on, for all but the chunk's last k - 1 words (see inside)."""
        if len(hashes) < k:
            return np.zeros(0, np.uint64)
        up, down = _WORD_POWERS.upto(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: len(hashes) - k + 1])

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on belong to one text; as long as gram_hashes."""
        n = max(0, len(self.doc) - k + 1)
        return self.doc[:n] == self.doc[k - 1 :][:n]


def chunks(column: pa.Array, limit: int = CHUNK, lower: bool = False) -> Iterator[Chunk]:
    """The texts of a column in chunks. lower: A to Z become a to z."""
    raw, offsets = text_buffers(column)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, rows)
        yield Chunk(first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
