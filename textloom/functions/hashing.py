"""Checksums, digests, the seeded 64-bit hash and its random bytes.

64-bit values are unsigned; columns hold their bit patterns as BIGINT, ``unsigned`` shows them as DECIMAL(20, 0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column

from .aes import aesenc
from .arrow import per_batch
from .bytesview import Text, col, raw, view

#: Fixed values of the seeded hash: the fraction of pi, and the byte permutation of the sum half.
PI = (
    0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917,
    0x9216D5D98979FB1B, 0xD1310BA698DFB5AC, 0x2FFD72DBD01ADFB7, 0xB8E1AFED6A267E96, 0xBA7C9045F12C7F99, 0x24A19947B3916CF7, 0x0801F2E2858EFC16, 0x636920D871574E69,
)
SHUFFLE = (4, 11, 9, 6, 8, 13, 15, 5, 14, 3, 1, 12, 0, 7, 10, 2)
_MASK = (1 << 64) - 1


def bytesum(x: Text) -> Column:
    """Sum of the byte values."""
    bytes_ = F.transform(F.split(view(x), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(bytes_, F.lit(0).cast("long"), lambda a, b: a + b)


def sha256(x: Text) -> Column:
    """32 bytes."""
    return F.unhex(sha256_hex(x))


def sha256_hex(x: Text) -> Column:
    return F.sha2(col(x).cast("binary"), 256)


def hmac_sha256(key: str | bytes, message: Text) -> Column:
    """32 bytes (RFC 2104); the pads are made once, on the driver."""
    k = raw(key)
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), col(message).cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), first), 256))


def unsigned(h: Text) -> Column:
    h = col(h)
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def fast_hash(x: Text, seed: int = 0) -> Column:
    """A native 64-bit hash with the role, not the values, of hash64: for grouping, bucketing and joins."""
    return F.xxhash64(F.lit(seed), col(x))


# The seeded hash: an AES half and a sum half, of one lane of 16 bytes for up to 64 bytes of text and of four beyond


def _state(seed: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    words = lambda part: np.array([(seed ^ x) & _MASK for x in part], "<u8").view(np.uint8).reshape(lanes, 16)
    return words(PI[: 2 * lanes]), words(PI[8 : 8 + 2 * lanes])


def _absorb(aes: np.ndarray, total: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 16) states take (n, 16) blocks."""
    turned = np.ascontiguousarray(total[:, SHUFFLE]).view("<u8") + np.ascontiguousarray(block).view("<u8")
    return aesenc(aes, block), turned.view(np.uint8)


def _finish(aes: np.ndarray, total: np.ndarray, seed: int, length: np.ndarray) -> np.ndarray:
    """aes, total: (n, lanes, 16)."""
    mixed = aesenc(total.reshape(-1, 16), aes.reshape(-1, 16)).reshape(total.shape)
    while mixed.shape[1] > 1:
        n, lanes = mixed.shape[:2]
        mixed = aesenc(np.ascontiguousarray(mixed[:, 0::2]).reshape(-1, 16), np.ascontiguousarray(mixed[:, 1::2]).reshape(-1, 16)).reshape(n, lanes // 2, 16)
    mixed = mixed[:, 0]
    key = np.empty((len(mixed), 2), "<u8")
    key[:, 0] = np.uint64(seed & _MASK) + length.astype(np.uint64)
    key[:, 1] = np.uint64(seed & _MASK)
    return np.ascontiguousarray(aesenc(aesenc(mixed, key.view(np.uint8)), mixed)).view("<u8")[:, 0]


def hash_many(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """Unsigned hashes of many texts. All texts advance together, block by block, those with most blocks first; so the ones
    that go on are always the first rows."""
    out = np.zeros(len(texts), np.uint64)
    length = np.array([len(t) for t in texts], np.int64)
    for lanes, of in ((1, np.flatnonzero(length <= 64)), (4, np.flatnonzero(length > 64))):
        wide = 16 * lanes
        blocks = np.maximum(1, -(-length[of] // wide))
        order = np.argsort(-blocks, kind="stable")
        of, blocks = of[order], blocks[order]
        if not len(of):
            continue
        starts = np.concatenate(([0], np.cumsum(blocks)))[:-1]
        data = np.frombuffer(b"".join([texts[i].ljust(n * wide, b"\0") for i, n in zip(of.tolist(), blocks.tolist(), strict=True)]), np.uint8).reshape(-1, wide)
        aes, total = (np.broadcast_to(x, (len(of), lanes, 16)).reshape(-1, 16).copy() for x in _state(seed, lanes))
        for j in range(int(blocks[0])):
            n = int(np.searchsorted(-blocks, -j, "left"))  # texts with more than j blocks
            aes[: n * lanes], total[: n * lanes] = _absorb(aes[: n * lanes], total[: n * lanes], data[starts[:n] + j].reshape(-1, 16))
        out[of] = _finish(aes.reshape(-1, lanes, 16), total.reshape(-1, lanes, 16), seed, length[of])
    return out


class Hasher:
    """The seeded hash of a text that comes in pieces. ``dump`` and ``load`` carry it between tasks or micro-batches."""

    def __init__(self, seed: int = 0):
        self.seed = seed & _MASK
        self.reset()

    def reset(self) -> Hasher:
        self.aes, self.total = _state(self.seed, 4)
        self.rest, self.length, self.head = b"", 0, b""
        return self

    def update(self, piece: str | bytes) -> Hasher:
        piece = raw(piece)
        self.length += len(piece)
        if len(self.head) < 64:  # short texts are hashed in another way, so they are kept
            self.head += piece[: 64 - len(self.head)]
        data = self.rest + piece
        whole = max(0, (len(data) - 1) // 64)  # the last block waits for the end
        for j in range(whole):
            self.aes, self.total = _absorb(self.aes, self.total, np.frombuffer(data[64 * j : 64 * j + 64], np.uint8).reshape(4, 16))
        self.rest = data[64 * whole :]
        return self

    def digest(self) -> int:
        if self.length <= 64:
            return int(hash_many([self.head], self.seed)[0])
        block = np.frombuffer(self.rest.ljust(64, b"\0"), np.uint8).reshape(4, 16)
        aes, total = _absorb(self.aes, self.total, block)
        return int(_finish(aes[None], total[None], self.seed, np.array([self.length]))[0])

    def hexdigest(self) -> str:
        return f"{self.digest():016x}"

    def dump(self) -> bytes:
        numbers = np.array([self.seed, self.length, len(self.head)], "<u8").tobytes()
        return numbers + self.aes.tobytes() + self.total.tobytes() + self.head.ljust(64, b"\0") + self.rest

    @classmethod
    def load(cls, data: bytes) -> Hasher:
        seed, length, head = np.frombuffer(data[:24], "<u8").tolist()
        out = cls(seed)
        out.length = length
        out.aes = np.frombuffer(data[24:88], np.uint8).reshape(4, 16).copy()
        out.total = np.frombuffer(data[88:152], np.uint8).reshape(4, 16).copy()
        out.head, out.rest = data[152 : 152 + head], data[216:]
        return out


def _signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def hash64(x: Text, seed: int = 0) -> Column:
    """The seeded hash's bit pattern as BIGINT."""

    def run(values):
        got = iter(_signed(hash_many([v for v in values if v is not None], seed)))
        return [None if v is None else next(got) for v in values]

    return per_batch(run, "bigint", col(x).cast("binary"))


def hash_multiseed(x: Text, seeds: list[int]) -> Column:
    """The hashes for several seeds, as an array."""

    def run(values):
        there = [v for v in values if v is not None]
        rows = iter(zip(*(_signed(hash_many(there, s)) for s in seeds), strict=True))
        return [None if v is None else list(next(rows)) for v in values]

    return per_batch(run, "array<bigint>", col(x).cast("binary"))


def random_bytes(length: int, nonce: int = 0, alphabet: bytes | None = None) -> bytes:
    """Bytes that depend on nonce only; mapped into the alphabet, if one is given."""
    n = -(-length // 16)
    lane = np.arange(n, dtype=np.uint64)
    state = np.repeat((np.uint64(nonce & _MASK) + lane)[:, None], 2, 1)
    key = np.array([[(nonce ^ PI[2 * j]) & _MASK, (nonce ^ PI[2 * j + 1]) & _MASK] for j in range(4)], "<u8")[(lane % np.uint64(4)).astype(int)]
    out = aesenc(state.astype("<u8").view(np.uint8).reshape(n, 16), key.view(np.uint8).reshape(n, 16)).reshape(-1)[:length]
    if alphabet is not None:
        out = np.frombuffer(alphabet, np.uint8)[out % len(alphabet)]
    return out.tobytes()


def random(length: Text | int, nonce: Text | int = 0, alphabet: str | bytes | None = None) -> Column:
    """random_bytes for each row, as BINARY; length and nonce are numbers or columns."""
    letters = None if alphabet is None else raw(alphabet)
    n = F.lit(length) if isinstance(length, int) else col(length)
    s = F.lit(nonce) if isinstance(nonce, int) else col(nonce)
    return per_batch(lambda ns, ss: [None if a is None or b is None else random_bytes(a, b, letters) for a, b in zip(ns, ss, strict=True)], "binary", n.cast("long"), s.cast("long"))


def fill_random(x: Text, nonce: Text | int = 0, alphabet: str | bytes | None = None) -> Column:
    """As many random bytes as x has."""
    return random(F.octet_length(col(x)), nonce, alphabet)
