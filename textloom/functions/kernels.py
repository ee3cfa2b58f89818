"""Pairwise scores in numpy: edit distances and alignments with linear or affine gaps, many pairs at once.

Cells of one anti-diagonal don't depend on each other, so a batch of pairs advances diagonal by diagonal. Pairs are batched by
length, which bounds padding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    """Costs of a distance: equal and different characters, first and further characters of a gap."""

    match: int = 0
    mismatch: int = 1
    open: int = 1
    extend: int = 1

    def __post_init__(self):
        for v in (self.match, self.mismatch, self.open, self.extend):
            if not -128 <= v <= 127:
                raise ValueError("costs are 8-bit numbers")

    @property
    def unit(self) -> bool:
        return (self.match, self.mismatch, self.open, self.extend) == (0, 1, 1, 1)


@dataclass(frozen=True)
class Classes:
    """A substitution matrix over at most 32 classes of bytes, and gap costs (negative for penalties)."""

    byte_to_class: tuple[int, ...]
    costs: tuple[tuple[int, ...], ...]
    open: int = -1
    extend: int = -1

    def __post_init__(self):
        if len(self.byte_to_class) != 256 or len(self.costs) != 32 or any(len(r) != 32 for r in self.costs):
            raise ValueError("256 classes and a matrix of 32 by 32 are needed")

    @staticmethod
    def diagonal(match: int, mismatch: int, open: int = -1, extend: int = -1) -> Classes:
        return Classes(tuple(b % 32 for b in range(256)), tuple(tuple(match if i == j else mismatch for j in range(32)) for i in range(32)), open, extend)


def _pad(items: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(items), width), np.int64)
    for row, x in zip(out, items, strict=True):
        row[: len(x)] = x
    return out


def _diagonals(a: list[np.ndarray], b: list[np.ndarray], substitute, opening: int, extending: int, best, local: bool) -> np.ndarray:
    """Scores of pairs. best: np.minimum or np.maximum. Rows of a diagonal are indexed by the place in a."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    n, m, pairs = int(la.max()), int(lb.max()), len(a)
    x, y = _pad(a, n), _pad(b, m)
    worst = _FAR if best is np.minimum else -_FAR
    gap = lambda k: np.where(k > 0, opening + extending * (k - 1), 0)
    blank = lambda: np.full((pairs, n + 1), worst, np.int64)
    score = np.zeros(pairs, np.int64)
    if not local:
        empty = (la == 0) | (lb == 0)
        score[empty] = gap(np.maximum(la, lb))[empty]
    older, old = blank(), blank()
    old[:, 0] = 0
    up, left = blank(), blank()  # best scores that end in a gap: in b, in a
    for d in range(1, n + m + 1):
        now, new_up, new_left = blank(), blank(), blank()
        edge = 0 if local else int(gap(np.array(d)))
        if d <= m:
            now[:, 0] = edge
        if d <= n:
            now[:, d] = edge
        lo, hi = max(1, d - m), min(n, d - 1)
        if lo <= hi:
            i = np.arange(lo, hi + 1)
            # A gap lengthens along a or along b; at the border it can only be opened.
            new_up[:, i] = best(old[:, i - 1] + opening, up[:, i - 1] + extending)
            new_left[:, i] = best(old[:, i] + opening, left[:, i] + extending)
            cell = best(older[:, i - 1] + substitute(x[:, i - 1], y[:, d - i - 1]), best(new_up[:, i], new_left[:, i]))
            now[:, i] = np.maximum(cell, 0) if local else cell
            if local:
                inside = (i <= la[:, None]) & (d - i <= lb[:, None])
                score = np.maximum(score, np.where(inside, now[:, i], 0).max(1))
            else:
                ends = (la + lb == d) & (la >= lo) & (la <= hi)
                score[ends] = now[ends, la[ends]]
        older, old, up, left = old, now, new_up, new_left
    return score


def _batched(a: list[np.ndarray], b: list[np.ndarray], run) -> np.ndarray:
    """Runs pairs of similar length together; about a million cells of a diagonal at once."""
    size = np.array([max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], np.int64)
    order, out, at = np.argsort(size, kind="stable"), np.zeros(len(a), np.int64), 0
    while at < len(order):
        stop = min(len(order), at + max(1, (1 << 20) // int(size[order[at]] * 2)))
        while stop > at + 1 and size[order[stop - 1]] > 2 * size[order[at]] + 8:
            stop = at + int(np.searchsorted(size[order[at:stop]], 2 * size[order[at]] + 8, "right"))
        part = order[at:stop]
        out[part] = run([a[i] for i in part], [b[i] for i in part])
        at = stop
    return out


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], costs: Costs) -> np.ndarray:
    """Distances of pairs of number sequences (bytes or code points)."""
    sub = lambda p, q: np.where(p == q, costs.match, costs.mismatch)
    return _batched(a, b, lambda x, y: _diagonals(x, y, sub, costs.open, costs.extend, np.minimum, False))


def alignments(a: list[bytes], b: list[bytes], classes: Classes, local: bool) -> np.ndarray:
    """Best scores of global (Needleman-Wunsch) or local (Smith-Waterman) alignments."""
    table, matrix = np.array(classes.byte_to_class), np.array(classes.costs, np.int64)
    coded = lambda texts: [table[np.frombuffer(t, np.uint8)] for t in texts]
    return _batched(coded(a), coded(b), lambda x, y: _diagonals(x, y, lambda p, q: matrix[p, q], classes.open, classes.extend, np.maximum, local))


# Rolling fingerprints

#: Fixed values of the fingerprints: default window widths, dimensions in a slice, and the base of the moduli.
WIDTHS, SLICE, MODULUS = (3, 4, 5, 7, 9, 11, 15, 31), 64, 4503599626977
_MASK = (1 << 64) - 1


def splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def dimensions(ndim: int, widths: tuple[int, ...] | None = None, seed: int = 0) -> list[tuple[int, int, int]]:
    """width, multiplier and modulus of each dimension."""
    widths = tuple(widths or WIDTHS)
    each = ndim / len(widths)
    sliced = each == int(each) and each and each % SLICE == 0
    out = []
    for d in range(ndim):
        h = splitmix64(seed + d)
        out.append((widths[d // SLICE % len(widths)] if sliced else widths[d % len(widths)], 256 + h % 384, MODULUS - splitmix64(h) % (1 << 20)))
    return out


#: Positions of a batch that are hashed at once, so that the tables of one width stay in a core's cache.
_BLOCK = 8192
#: Coefficients are split here; sums of both halves over a window are exact in double precision.
_HALF = 1 << 21


def _coefficients(group: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For dimensions of one width: the powers of their multipliers by place in the window, in halves below each other; and
    the moduli as columns, whole and in halves."""
    width = group[0][0]
    powers = np.array([[pow(m, width - 1 - j, p) for j in range(width)] for _, m, p in group], np.int64)
    moduli = np.array([[p] for *_, p in group], np.int64)
    return np.concatenate([powers // _HALF, powers % _HALF]).astype(float), *(x.astype(float) for x in (moduli, moduli // _HALF, moduli % _HALF))


def _residues(high: np.ndarray, low: np.ndarray, p: np.ndarray, p_high: np.ndarray, p_low: np.ndarray) -> np.ndarray:
    """(high * _HALF + low) modulo p, exactly: the quotient is at most one too low, never too high."""
    q = high * (_HALF / p)
    q += low * (1 / p)
    q -= 2.0**-20
    np.floor(q, out=q)
    high -= q * p_high
    high *= _HALF
    low -= q * p_low
    high += low
    np.subtract(high, p, out=low)
    np.copyto(high, low, where=low >= 0)
    return high


def fingerprint_many(raw: np.ndarray, offsets: np.ndarray, dims: list[tuple[int, int, int]], whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per text (bytes raw[offsets[i] : offsets[i + 1]]) and dimension the least window hash (its low 32 bits) and how often it
    occurs; 2**32 - 1 and 0 for a text shorter than the window. whole: all bits of the hash, infinity if there is none.

    A window's hash is a sum of bytes times powers, so the hashes of all positions and of all dimensions of one width are one
    matrix product, reduced modulo each dimension's prime afterwards."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    least, often = np.full((len(dims), n), np.inf), np.zeros((len(dims), n), np.int64)
    groups: dict[int, list[int]] = {}
    for d, (width, *_) in enumerate(dims):
        groups.setdefault(width, []).append(d)
    tables = {w: _coefficients([dims[d] for d in at]) for w, at in groups.items()}
    widest = max(groups)
    there = np.flatnonzero(size)
    starts, ends = offsets[:-1][there], offsets[1:][there]
    for first in range(int(offsets[0]), int(offsets[-1]), _BLOCK):
        last = min(first + _BLOCK, int(offsets[-1]))
        piece = np.zeros(last - first + widest - 1)
        given = raw[first : last + widest - 1]
        piece[: len(given)] = given
        piece += 1
        rows = np.lib.stride_tricks.sliding_window_view(piece, last - first)[:widest].copy()
        a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(starts, last, "left"))
        cut, stop = np.maximum(starts[a:b], first) - first, np.minimum(ends[a:b], last) - first
        for width, at in groups.items():
            table, *moduli = tables[width]
            sums = table @ rows[:width]
            found = _residues(sums[: len(at)], sums[len(at) :], *moduli)
            # Windows that would reach into the next text.
            over = np.maximum(cut, ends[a:b] - first - width + 1)
            count = np.maximum(stop - over, 0)
            found[:, np.repeat(over - np.cumsum(count) + count, count) + np.arange(count.sum())] = np.inf
            best = np.minimum.reduceat(found, cut, axis=1)
            hits = np.add.reduceat(found == np.repeat(best, stop - cut, axis=1), cut, axis=1, dtype=np.int64)
            place = np.ix_(at, there[a:b])
            old, times = least[place], often[place]
            often[place] = np.where(best < old, hits, times + np.where(best == old, hits, 0))
            least[place] = np.minimum(best, old)
    if whole:
        return least.T, often.T
    short = np.isinf(least)
    hashes = np.where(short, 0xFFFFFFFF, np.where(short, 0, least).astype(np.int64) & 0xFFFFFFFF)
    return hashes.T, np.where(short, 0, often).T


def fingerprint(text: bytes, dims: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """fingerprint_many of one text."""
    hashes, counts = fingerprint_many(np.frombuffer(text, np.uint8), np.array([0, len(text)]), dims)
    return hashes[0].tolist(), counts[0].tolist()
