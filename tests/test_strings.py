"""Search, splitting and transformation against Python's own bytes and strings."""

import hashlib
import hmac
import random
import re

import pyspark.sql.functions as F
import pytest

from textloom.functions import bytesview, search, split, transform

TEXTS = ["", "a", "ab", "aaaa", "hello world", "Ünïcödé straße", "a,,b,", ",,,", "line1\nline2\r\nline3\n", "  x\t", "ab" * 40, "日本語 text 日本", "\\E.*[x]$"]


def values(spark, *columns, texts=TEXTS):
    """Rows of results, one for each text."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


WINDOWS = [(0, None), (0, 3), (2, 5), (-3, None), (1, -1), (5, 2), (99, None), (-99, 99), (0, 0), (12, None)]


@pytest.mark.parametrize("needle", ["", "a", "aa", "o w", "é", "本", "zz", "\\E"])
def test_find_rfind_count_like_bytes(spark, needle):
    n = needle.encode()
    columns = [f("s", needle, a, b).alias(f"{f.__name__}{i}") for i, (a, b) in enumerate(WINDOWS) for f in (search.find, search.rfind, search.count, search.contains, search.startswith, search.endswith)]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        t, got = text.encode(), iter(row)
        for a, b in WINDOWS:
            end = len(t) if b is None else b
            size = len(range(*slice(a, end).indices(len(t))))
            valid = a <= len(t) and slice(a, end).indices(len(t))[0] <= slice(a, end).indices(len(t))[1]
            count = t.count(n, a, end) if n else (size + 1 if valid else 0)
            want = (t.find(n, a, end), t.rfind(n, a, end), count, t.find(n, a, end) >= 0, t.startswith(n, a, end) and valid, t.endswith(n, a, end) and valid)
            assert tuple(next(got) for _ in want) == want, (text, needle, a, b)


@pytest.mark.parametrize("chars", ["", "a", " ,", "oe", "é"])
def test_byte_sets(spark, chars):
    cs = set(chars.encode())
    columns = [search.find_first_of("s", chars), search.find_last_of("s", chars), search.find_first_not_of("s", chars), search.find_last_not_of("s", chars), search.count_byteset("s", chars)]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        inside = [i for i, b in enumerate(text.encode()) if b in cs]
        outside = [i for i, b in enumerate(text.encode()) if b not in cs]
        at = lambda x, k: x[k] if x else -1
        assert row == (at(inside, 0), at(inside, -1), at(outside, 0), at(outside, -1), len(inside)), text


def test_overlaps_and_matches(spark):
    rng = random.Random(42)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(66))) for _ in range(60)]
    for needle in ("a", "aa", "aba", "abab"):
        columns = [search.count("s", needle, allowoverlap=True), search.matches("s", needle), search.matches("s", needle, overlapping=False), search.matches("s", needle, backward=True)]
        for text, (n, every, disjoint, back) in zip(texts, values(spark, *columns, texts=texts), strict=True):
            want = [m.start() for m in re.finditer(f"(?={needle})", text)]
            assert (n, every, back) == (len(want), want, want[::-1]), text
            assert disjoint == [m.start() for m in re.finditer(needle, text)], text


def test_partition(spark):
    for sep in (",", "l", "ab", "日本"):
        for text, (a, b) in zip(TEXTS, values(spark, search.partition("s", sep), search.rpartition("s", sep)), strict=True):
            assert tuple(a) == text.partition(sep) and tuple(b) == text.rpartition(sep), (text, sep)
    with pytest.raises(ValueError):
        search.partition("s", "")


@pytest.mark.parametrize("sep", [",", "a", "aa", "\n", "本", "."])
def test_split_like_python(spark, sep):
    limits = [None, 0, 1, 2]
    columns = [f("s", sep, m) for m in limits for f in (split.split, split.rsplit)]
    columns += [split.split("s", sep, keepseparator=True), split.rsplit("s", sep, keepseparator=True), split.split("s", sep, skip_empty=True), split.split("s", sep, 1, skip_empty=True)]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        want = [f(sep, -1 if m is None else m) for m in limits for f in (text.split, text.rsplit)]
        assert list(row[:8]) == want, (text, sep)
        parts, back = text.split(sep), text.rsplit(sep)
        assert row[8] == [p + sep for p in parts[:-1]] + parts[-1:]
        assert row[9] == back[:1] + [sep + p for p in back[1:]]
        assert row[10] == [p for p in parts if p]
        assert row[11] == [p for p in text.split(sep, 1) if p]


def test_split_byteset(spark):
    chars = ", \n"
    columns = [split.split_byteset("s", chars), split.split_byteset("s", chars, 1, keepseparator=True), split.rsplit_byteset("s", chars, 1), split.rsplit_byteset("s", chars, 1, keepseparator=True), split.split_byteset("s", "é")]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        assert row[0] == re.split("[, \n]", text)
        assert "".join(row[1]) == text and len(row[1]) <= 2
        m = list(re.finditer("[, \n]", text))
        assert row[2] == ([text[: m[-1].start()], text[m[-1].end() :]] if m else [text])
        assert row[3] == ([text[: m[-1].start()], text[m[-1].start() :]] if m else [text])
        assert [bytes(x) for x in row[4]] == re.split(b"[\xc3\xa9]", text.encode())
    with pytest.raises(ValueError):
        split.split_byteset("s", "")


def test_lines(spark):
    for text, (a, b, c) in zip(TEXTS, values(spark, split.splitlines("s"), split.splitlines("s", keeplinebreaks=True), split.splitlines_bytes("s")), strict=True):
        parts = re.split("[\n\x0b\f\r\x1c-\x1e]", text)
        assert a == (parts[:-1] if parts[-1] == "" else parts)
        assert "".join(b) == text
        raw = re.split(b"[\n\x0b\f\r\x85\x1c-\x1e]", text.encode())
        assert [bytes(x) for x in c] == (raw[:-1] if raw[-1] == b"" else raw)


def test_unicode_splits_are_lossless(spark):
    columns = [f("s", with_separators=True) for f in (split.split_newlines, split.split_whitespaces, split.split_delimiters)] + [split.split_whitespaces("s"), split.newlines("s")]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        assert all("".join(x) == text for x in row[:3])
        assert row[3] == re.split("[\t-\r \x85\xa0]", text)
        assert row[4] == re.findall("\r\n|[\n\x0b\f\r\x85]", text)


def test_strip_and_slices(spark):
    columns = [transform.strip("s"), transform.lstrip("s", "ah "), transform.rstrip("s", "de3\n"), transform.slice_bytes("s", 1, -1), transform.slice_bytes("s", -3), transform.remove_prefix("s", "he"), transform.remove_suffix("s", "ld")]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        t = text.encode()
        assert row[:3] == (text.strip(" \t\n\r\f\v"), text.lstrip("ah "), text.rstrip("de3\n"))
        assert (bytes(row[3]), bytes(row[4])) == (t[1:-1], t[-3:])
        assert row[5:] == (text.removeprefix("he"), text.removesuffix("ld"))


def test_translate_and_replace(spark):
    table = bytes(255 - i for i in range(256))
    columns = [transform.translate("s", table), transform.translate("s", {"a": "b", "l": "L"}), transform.replace_all("s", "aa", "$\\1"), transform.replace_byteset("s", "ao", "$0"), transform.fill("s", 65), transform.resize("s", 4), transform.insert("s", 0, "é"), transform.erase("s", 0, 1)]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        t = text.encode()
        assert bytes(row[0]) == t.translate(table)
        assert row[1:4] == (text.translate(str.maketrans("al", "bL")), text.replace("aa", "$\\1"), re.sub("[ao]", "$0", text))
        assert [bytes(x) for x in row[4:]] == [b"A" * len(t), t[:4].ljust(4, b"\0"), "é".encode() + t, t[1:]]
    with pytest.raises(ValueError):
        transform.translate("s", b"short")


def test_ascii_classes(spark):
    texts = ["", "abc", "ABC", "a1", "12", " \t", "é", "a b", "\x7f"]
    columns = [transform.is_alpha("s"), transform.is_alnum("s"), transform.is_digit("s"), transform.is_lower("s"), transform.is_upper("s"), transform.is_space("s"), transform.is_ascii("s"), transform.is_printable("s"), transform.contains_only("s", "abc")]
    got = dict(zip(texts, values(spark, *columns, texts=texts), strict=True))
    assert got[""] == (False,) * 6 + (True, True, False)
    assert got["abc"] == (True, True, False, True, False, False, True, True, True)
    assert got["ABC"][:5] == (True, True, False, False, True) and got["12"][:3] == (False, True, True)
    assert got["é"][:1] == (False,) and not got["é"][6] and not got["\x7f"][7] and got[" \t"][5]


def test_compare_and_decode(spark):
    columns = [search.order("s", F.lit("b")), search.equal("s", F.encode("s", "UTF-8")), transform.decode(F.lit(b"a\xc3\xffb"), errors="replace"), transform.decode(F.lit(b"a\xff"), errors="ignore")]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        assert row[0] == (text.encode() > b"b") - (text.encode() < b"b") and row[1]
        assert "�" in row[2] and row[3] is None


def test_index_fails_when_missing(spark):
    assert values(spark, search.index("s", ""))[0] == (0,)
    with pytest.raises(Exception, match="substring not found"):
        values(spark, search.index("s", "zzz"))


def test_nulls_stay_null(spark):
    columns = [search.find("s", "a"), search.count("s", "a"), search.partition("s", "a"), split.split("s", "a"), split.splitlines("s"), split.split_whitespaces("s"), split.rsplit("s", "a"), transform.slice_bytes("s", 1), transform.strip("s")]
    row = values(spark, *columns, texts=[None])[0]
    assert all(x is None for x in row), row


def test_byte_sets_combine():
    a, b = bytesview.ByteSet("ab"), bytesview.ByteSet("bc")
    assert bytes(a | b) == b"abc" and len(a.inverted()) == 254 and 97 not in a.inverted()
    assert bytesview.quote("a\\Eb") == "\\Qa\\E\\\\E\\Qb\\E"


def test_digests(spark):
    from textloom.functions import hashing

    keys = [b"", b"k", b"k" * 64, b"k" * 65]
    columns = [hashing.sha256("s"), hashing.bytesum("s"), *(hashing.hmac_sha256(k, "s") for k in keys)]
    for text, row in zip(TEXTS, values(spark, *columns), strict=True):
        t = text.encode()
        assert bytes(row[0]) == hashlib.sha256(t).digest() and row[1] == sum(t)
        assert [bytes(x) for x in row[2:]] == [hmac.new(k, t, hashlib.sha256).digest() for k in keys]
