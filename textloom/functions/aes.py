"""AES in numpy, many blocks at once: single rounds for the seeded hash, whole AES-256 for counter mode.

Tables come from the definition of the field GF(2**8) with x**8 + x**4 + x**3 + x + 1 (FIPS 197).
"""

from __future__ import annotations

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S-box, and products with 2 and 3."""
    double = np.array([(x << 1) ^ (0x11B if x & 128 else 0) for x in range(256)], np.uint8)
    triple = double ^ np.arange(256, dtype=np.uint8)
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x = int(triple[x])  # 3 generates the field
    log = {v: i for i, v in enumerate(powers)}
    box = []
    for v in range(256):
        y = powers[-log[v] % 255] if v else 0
        spread = y
        for k in (1, 2, 3, 4):
            spread ^= ((y << k) | (y >> (8 - k))) & 255
        box.append(spread ^ 0x63)
    return np.array(box, np.uint8), double, triple


SBOX, DOUBLE, TRIPLE = _tables()
#: Column-major state: row r of column c moves to column c - r.
_SHIFT = np.array([(c + r) % 4 * 4 + r for c in range(4) for r in range(4)])


def _columns() -> np.ndarray:
    """Per row of the state, what a byte adds to its column of the next state: substituted, times the column's factors."""
    double, triple = DOUBLE[SBOX], TRIPLE[SBOX]
    factors = [(double, SBOX, SBOX, triple), (triple, double, SBOX, SBOX), (SBOX, triple, double, SBOX), (SBOX, SBOX, triple, double)]
    return np.stack([np.ascontiguousarray(np.stack(f, 1)).view("<u4")[:, 0] for f in factors])


_COLUMNS = _columns()


def aesenc(state: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One encryption round of (n, 16) states with (n, 16) or (16,) keys."""
    s = state[:, _SHIFT].reshape(-1, 4, 4)
    mixed = _COLUMNS[0][s[:, :, 0]]
    for r in (1, 2, 3):
        mixed ^= _COLUMNS[r][s[:, :, r]]
    return np.ascontiguousarray(mixed).view(np.uint8).reshape(-1, 16) ^ key


def expand_key(key: bytes) -> np.ndarray:
    """The 15 round keys of AES-256."""
    if len(key) != 32:
        raise ValueError("AES-256 takes a key of 32 bytes")
    words = [list(key[4 * i : 4 * i + 4]) for i in range(8)]
    rcon = 1
    for i in range(8, 60):
        w = words[-1]
        if i % 8 == 0:
            w = [int(SBOX[x]) for x in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = int(DOUBLE[rcon])
        elif i % 8 == 4:
            w = [int(SBOX[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[-8], w, strict=True)])
    return np.array(words, np.uint8).reshape(15, 16)


def encrypt_blocks(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = aesenc(s, k)
    return SBOX[s[:, _SHIFT]] ^ keys[-1]


def ctr_stream(keys: np.ndarray, nonce: bytes, first: int, n: int) -> np.ndarray:
    """Bytes first to first + n of the key stream: 12 bytes of nonce, then a 32-bit big-endian counter from 0."""
    if len(nonce) != 12:
        raise ValueError("counter mode takes a nonce of 12 bytes")
    a, b = first // 16, -(-(first + n) // 16)
    counters = np.arange(a, b, dtype=np.uint64).astype(">u4")
    blocks = np.empty((b - a, 16), np.uint8)
    blocks[:, :12] = np.frombuffer(nonce, np.uint8)
    blocks[:, 12:] = counters.view(np.uint8).reshape(-1, 4)
    return encrypt_blocks(blocks, keys).reshape(-1)[first - 16 * a : first - 16 * a + n]
