"""Further families of window hashes for fingerprints, besides the default one: vectorised over all windows of a text.

Each family gives, for a width, a dimension and a seed, the parameters of its dimension, and from those the hash of every window.
"""

from __future__ import annotations

import math

import numpy as np

from .kernels import splitmix64

#: The largest primes below 2**32 and near the end of what single precision holds exactly.
PRIME_32, PRIME_SINGLE = 4294967291, 8123


def coprime_below(multiplier: int, limit: int) -> int:
    """The largest odd number without a common factor with the multiplier, small enough that multiplying a residue and adding a byte stays
    below the limit; 0 if there is none."""
    if multiplier <= 0 or multiplier >= limit or limit <= 257:
        return 0
    first = (limit - 257) // multiplier + 1
    return next((p for p in range(first - (first % 2 == 0), 2, -2) if math.gcd(p, multiplier) == 1), 0)


def _windows(text: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(text, width) if len(text) >= width else np.zeros((0, width), text.dtype)


def multiplying(text: np.ndarray, width: int, dim: int, seed: int, alphabet: int = 256) -> np.ndarray:
    """A polynomial modulo 2**64."""
    m = np.uint64(alphabet + 1 + splitmix64(seed + dim) % 256)
    h = np.zeros(max(0, len(text) - width + 1), np.uint64)
    for column in _windows(text.astype(np.uint64), width).T:
        h = h * m + column
    return h


def rabin_karp(text: np.ndarray, width: int, dim: int, seed: int, alphabet: int = 256) -> np.ndarray:
    """A polynomial modulo a number of about 24 bits that has no common factor with the multiplier."""
    m = alphabet + splitmix64(seed + dim) % 256
    p = np.uint64(coprime_below(m, PRIME_32) or PRIME_32)
    h = np.zeros(max(0, len(text) - width + 1), np.uint64)
    for column in _windows(text.astype(np.uint64) + np.uint64(1), width).T:
        h = (h * np.uint64(m) + column) % p
    return h


def cyclic(text: np.ndarray, width: int, dim: int, seed: int, alphabet: int = 256) -> np.ndarray:
    """Cyclic polynomial hashing: numbers of a random table, rotated by their place. The alphabet has no effect."""
    first = splitmix64(seed + dim)
    table = np.array([splitmix64(first + i) for i in range(256)], np.uint64)
    h = np.zeros(max(0, len(text) - width + 1), np.uint64)
    for column in _windows(table[text], width).T:
        h = (h << np.uint64(1) | h >> np.uint64(63)) ^ column
    return h


def single(text: np.ndarray, width: int, dim: int, seed: int, alphabet: int = 256) -> np.ndarray:
    """A polynomial modulo a number so small that single precision holds every step; for experiments only. The alphabet has no effect."""
    m = 256 + splitmix64(seed + dim) % 256
    p = np.uint64(PRIME_SINGLE - splitmix64(splitmix64(seed + dim)) % 256)
    h = np.zeros(max(0, len(text) - width + 1), np.uint64)
    for column in _windows(text.astype(np.uint64) + np.uint64(1), width).T:
        h = (h * np.uint64(m) + column) % p
    return h


FAMILIES = {"multiplying": multiplying, "rabin_karp": rabin_karp, "cyclic": cyclic, "single": single}

#: Sizes of usual alphabets, for families whose multipliers depend on it.
ALPHABETS = {"bytes": 256, "ascii": 128, "protein": 22, "dna": 4}


def fingerprint(text: bytes, family: str, widths: tuple[int, ...], seed: int = 0, alphabet: int = 256) -> tuple[list[int], list[int]]:
    """Per dimension (one for each width) the least window hash (its low 32 bits) and how often it occurs; 2**32 - 1 and 0 for a
    text shorter than the window."""
    b = np.frombuffer(text, np.uint8)
    hashes, counts = [], []
    for dim, width in enumerate(widths):
        h = FAMILIES[family](b, width, dim, seed, alphabet)
        least = h.min() if len(h) else None
        hashes.append(0xFFFFFFFF if least is None else int(least) & 0xFFFFFFFF)
        counts.append(0 if least is None else int((h == least).sum()))
    return hashes, counts
