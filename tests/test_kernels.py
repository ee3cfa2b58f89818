"""Kernels without Spark: AES, the seeded hash, pairwise scores, fingerprints, segmentation."""

import random

import numpy as np
import pytest

from textloom.functions import aes, hashing, kernels, segment, unicode
from textloom.functions.kernels import Classes, Costs

RNG = random.Random(314159)


def test_aes_vector():
    key = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
    block = np.frombuffer(bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), np.uint8)[None]
    assert aes.encrypt_blocks(block, aes.expand_key(key)).tobytes().hex() == "f3eed1bdb5d2a03c064b5a7e3db181f8"


def test_counter_mode_seeks():
    keys = aes.expand_key(bytes(range(32)))
    whole = aes.ctr_stream(keys, bytes(12), 0, 100)
    for first in (0, 1, 15, 16, 17, 31, 63):
        assert (aes.ctr_stream(keys, bytes(12), first, 20) == whole[first : first + 20]).all()


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 33, 47, 48, 49, 63, 64, 65, 127, 128, 129, 255, 256, 1024])
def test_hash_in_pieces(n):
    text = bytes(RNG.randrange(256) for _ in range(n))
    h, at = hashing.Hasher(42), 0
    while at < n:
        step = RNG.randrange(1, 70)
        h = hashing.Hasher.load(h.update(text[at : at + step]).dump())
        at += step
    assert h.digest() == int(hashing.hash_many([text, b"other", text * 2], 42)[0])
    assert h.digest() != int(hashing.hash_many([text], 43)[0])


def test_random_bytes():
    assert hashing.random_bytes(10, 7) == hashing.random_bytes(40, 7)[:10] != hashing.random_bytes(10, 8)
    assert set(hashing.random_bytes(200, 1, b"ACGT")) <= set(b"ACGT")


def table(a, b, sub, opening, extending, best, local=False):
    """Full Gotoh tables."""
    far = 10**9 if best is min else -(10**9)
    n, m = len(a), len(b)
    gap = lambda k: opening + extending * (k - 1) if k else 0
    h = [[0 if local else gap(i + j) if not i or not j else far for j in range(m + 1)] for i in range(n + 1)]
    up, left = ([[far] * (m + 1) for _ in range(n + 1)] for _ in range(2))
    top = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up[i][j] = best(h[i - 1][j] + opening, up[i - 1][j] + extending)
            left[i][j] = best(h[i][j - 1] + opening, left[i][j - 1] + extending)
            h[i][j] = best(h[i - 1][j - 1] + sub(a[i - 1], b[j - 1]), up[i][j], left[i][j])
            if local:
                h[i][j] = max(0, h[i][j])
                top = max(top, h[i][j])
    return top if local else h[n][m]


PAIRS = [(bytes(RNG.choice(b"abc") for _ in range(RNG.randrange(25))), bytes(RNG.choice(b"abc") for _ in range(RNG.randrange(25)))) for _ in range(80)] + [(b"", b""), (b"", b"abc"), (b"abcdefgABCDEFG", b"ABCDEFGabcdefg")]


@pytest.mark.parametrize("costs", [Costs(), Costs(0, 4, 3, 2), Costs(0, 2, 3, 3), Costs(1, 3, 5, 1)])
def test_edit_distances(costs):
    a, b = ([np.frombuffer(p[i], np.uint8) for p in PAIRS] for i in (0, 1))
    want = [table(x, y, lambda p, q: costs.match if p == q else costs.mismatch, costs.open, costs.extend, min) for x, y in PAIRS]
    assert kernels.edit_distances(a, b, costs).tolist() == want


@pytest.mark.parametrize("local", [False, True])
@pytest.mark.parametrize("gaps", [(-1, -1), (-4, -1), (-3, -2)])
def test_alignments(local, gaps):
    classes = Classes.diagonal(2, -1, *gaps)
    want = [table(x, y, lambda p, q: 2 if p % 32 == q % 32 else -1, *gaps, max, local) for x, y in PAIRS]
    assert kernels.alignments([p for p, _ in PAIRS], [q for _, q in PAIRS], classes, local).tolist() == want


def test_costs_are_checked():
    with pytest.raises(ValueError):
        Costs(0, 200, 1, 1)
    with pytest.raises(ValueError):
        Classes((0,), ())


@pytest.mark.parametrize("ndim", [1, 7, 64])
def test_fingerprints(ndim):
    dims = kernels.dimensions(ndim, seed=3)
    for text in (b"", b"ab", b"hello world, hello", bytes(range(256))):
        hashes, counts = kernels.fingerprint(text, dims)
        for d, (w, m, p) in enumerate(dims):
            found = []
            for i in range(len(text) - w + 1):
                h = 0
                for c in text[i : i + w]:
                    h = (h * m + c + 1) % p
                found.append(h)
            assert (hashes[d], counts[d]) == ((min(found) & 0xFFFFFFFF, found.count(min(found))) if found else (0xFFFFFFFF, 0))


def test_widths_come_in_slices():
    assert [w for w, _, _ in kernels.dimensions(16)][:9] == [3, 4, 5, 7, 9, 11, 15, 31, 3]
    assert {w for w, _, _ in kernels.dimensions(512)[64:128]} == {4}


TEXTS = ["", "a", "Hello, world! It's 3.14 o'clock.", "Mr. Smith went. He (really) left?! \"Yes.\" ok", "日本語のテキスト。次の文。", "éa\r\nb\n\nc", "👩‍👩‍👧 🇩🇪🇫🇷 x", "http://a.b/c-d e f", "$12.50 (a) “q” 50%​z"]


@pytest.mark.parametrize("cut", [segment.words, segment.sentences, segment.line_breaks, segment.graphemes])
def test_segments_tile(cut):
    for text in TEXTS:
        parts = cut(text)
        assert "".join(parts) == text and all(parts)


def test_segment_rules():
    assert segment.words("Hi, can't 3.14") == ["Hi", ",", " ", "can't", " ", "3.14"]
    assert segment.sentences("One. Two! three? Four") == ["One. ", "Two! ", "three? ", "Four"]
    assert segment.sentences("It is 3.4 e.g. this. Yes") == ["It is 3.4 e.g. this. ", "Yes"]
    assert segment.sentences("a\nb\r\nc") == ["a\n", "b\r\n", "c"]
    assert segment.line_breaks("The (quick) fox-like 3.5% thing.\nNext") == ["The ", "(quick) ", "fox-", "like ", "3.5% ", "thing.\n", "Next"]
    assert segment.line_breaks("a b c​d") == ["a b ", "c​", "d"]
    assert segment.graphemes("é🇩🇪🇫🇷") == ["é", "🇩🇪", "🇫🇷"]


def test_uncased_search():
    assert unicode.uncased_find("ﬃ", "fi") == 0 and unicode.uncased_find("aßß", "sss") == 1
    assert unicode.uncased_find("Straße", "STRASSE") == 0 and unicode.uncased_find("abc", "x") == -1
    assert unicode.uncased_find("abc", "", 1) == 1 and unicode.uncased_find("abc", "", 9) == -1
    assert unicode.uncased_regions("aAa", "AA") == [(0, 2)] and unicode.uncased_regions("aAa", "AA", True) == [(0, 2), (1, 2)]
    assert unicode.uncased_regions("abc", "") == []


def test_denormalized_at():
    assert unicode.denormalized_at("café", "NFC") == 3
    assert unicode.denormalized_at("abc", "NFC") is None and unicode.denormalized_at("aé", "NFD") == 1
