"""Quality rules: base counts of a text and the divergence of its distributions from its language's references.

Two histograms describe a text: character classes (of all bytes) and common words (the language's most frequent words,
and one bin for all others). A language's references are the same histograms summed over every document that carries the
language. A text is rejected if the Jensen-Shannon distance to every reference it is compared with is above that reference's
limit, for either histogram; each test has a minimum length below which it isn't applied. A text is compared with its own
language's references if it names one, else with all. A third pass takes the limit of characters from the distances of all texts.

Common words are found exactly in two passes. A word with a share of at least PHI in a language has at least that share
in some block of the corpus, so each block reports its words with a share of PHI / 2 or more; summed lower bounds of less than
PHI / 2 of the language's words are ruled out, which leaves 2 / PHI candidates at most, and the second pass counts those.

Defined cases: a null text counts as empty (all counts 0, base failed); texts below a guard pass that test; repeated rows
get equal answers; a row without a language, or with one seen in too few words, is compared with all references, and
passes if there are none; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import scratch
from .textbatch import SPACES, chunks
from .workers import mapped

#: Words with at least this share of a language's words are common.
PHI = 0.002
#: Words in a block of the first pass.
BLOCK = 2_000_000
#: A language needs so many words to have references; with more languages than LANGUAGES, whose references every task holds, the fit is refused.
LEAST_REFERENCE, LANGUAGES = 500, 4096
#: Least length of a text, and largest distance, for the test of character classes (bytes) and of common words (words).
#: The limit for characters stands CHARS_ABOVE over the median distance of the language's texts, so it moves with a reference
#: that holds junk; CHARS_MOST is for references without texts that are long enough.
CHARS_FROM, CHARS_ABOVE, CHARS_MOST = 200, 0.21, 0.32
WORDS_FROM, WORDS_MOST = 80, 0.45
#: A text without any of its language's common words has a distance that the reference gives; the limit for words is this share
#: of it, if that is below WORDS_MOST and common words are frequent enough that a text of WORDS_FROM words must hold some.
BARE, LEAST_COMMON = 0.93, 0.2

SYMBOLS = b"#*$%&|<>"
#: Steps of a distance in which the texts of a language are counted for their median.
STEPS = 1024
CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "quote", "bracket", "symbol", "letter beyond ASCII", "control"]
_CLASS = np.full(256, 8, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[32], _CLASS[[10, 13]] = 3, 4
_CLASS[list(b".,;:!?")], _CLASS[list(b"'\"-`")], _CLASS[list(b"()[]{}")] = 5, 6, 7
_CLASS[128:] = 9
_CLASS[:32][_CLASS[:32] == 8] = 10
_CLASS[127] = 10
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(SPACES)] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _class_counts(c) -> np.ndarray:
    kinds = _CLASS[c.raw]
    owner = np.repeat(np.arange(c.n), np.diff(c.offsets))
    return np.bincount(owner * len(CLASSES) + kinds, minlength=c.n * len(CLASSES)).reshape(c.n, len(CLASSES))


def _repeated(c) -> np.ndarray:
    """Per text, the words in 8-word windows that the text has twice or more. Exact: windows are compared by rank."""
    if len(c.doc) < 8:
        return np.zeros(c.n, np.int64)
    codes = pd.factorize(c.word_hashes())[0].astype(np.int64)
    for k in (1, 2, 4):
        codes = pd.factorize(codes[:-k] * (codes.max() + 1) + codes[k:])[0].astype(np.int64)
    ok = c.inside(8)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(c.n, np.int64)
    keys = pd.factorize(codes[at] * c.n + c.doc[at])[0]
    twice = at[np.bincount(keys)[keys] > 1]
    step = np.zeros(len(c.doc) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + 8, -1)
    return np.bincount(c.doc[np.cumsum(step)[:-1] > 0], minlength=c.n)


def _base(c) -> tuple[np.ndarray, ...]:
    chars = _sums((c.raw & 0xC0) != 0x80, c.offsets) - _sums(_IS_BLANK[c.raw], c.offsets)
    lines = np.zeros(c.n, np.int64)
    raw = c.raw.tobytes()
    for i in range(c.n):
        full = [x for x in raw[c.offsets[i] : c.offsets[i + 1]].split(b"\n") if x.strip(SPACES)]
        lines[i] = len(full) - len(set(full))
    return c.n_words, chars, _sums(_IS_SYMBOL[c.raw], c.offsets), lines, _repeated(c)


def _rows(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))


def _by_language(batch):
    """Each chunk of a batch with the language of each of its texts, as a number, and their names."""
    langs = batch.column(2).dictionary_encode()
    names, codes = langs.dictionary.to_pylist(), langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for c in chunks(batch.column(1)):
        yield c, codes[c.first : c.first + c.n], names


def _candidates(rows: DataFrame, phi: float) -> dict[str, list[bytes]]:
    """The words that can have a share of phi in their language; at most 2 / phi for each."""

    def run(batches):
        held: dict[str, Counter] = {}
        size: Counter = Counter()

        def report():
            for name, n in size.items():
                found = [(w, k) for w, k in held[name].items() if k >= phi / 2 * n]
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(found) + 1), pa.string()), pa.array([None, *(w for w, _ in found)], pa.binary()), pa.array([n, *(k for _, k in found)], pa.int64())], names=["lang", "word", "n"])
            held.clear()
            size.clear()

        for batch in batches:
            for c, codes, names in _by_language(batch):
                raw = c.raw.tobytes()
                for i in np.flatnonzero((codes >= 0) & (c.n_words > 0)):
                    words = raw[c.offsets[i] : c.offsets[i + 1]].split()
                    name = names[codes[i]]
                    held.setdefault(name, Counter()).update(words)
                    size[name] += len(words)
                if sum(size.values()) >= BLOCK:
                    yield from report()
        yield from report()

    counted = mapped(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = scratch.table(counted, "words")  # totals and candidates both read it
    totals = counted.where(F.col("word").isNull()).select("lang", F.col("n").alias("total")).where(F.col("total") >= LEAST_REFERENCE)
    likely = counted.where(F.col("word").isNotNull()).join(totals, "lang").where(F.col("n") >= F.lit(phi / 2) * F.col("total"))
    if totals.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages have references; the column of languages seems to hold something else")
    out: dict[str, list[bytes]] = {}
    for r in likely.select("lang", "word").collect():
        out.setdefault(r.lang, []).append(bytes(r.word))
    scratch.release(counted)
    return {k: sorted(v) for k, v in sorted(out.items())}


class References:
    """Per language: its common words, the two reference distributions and the limits of both distances."""

    def __init__(self, words: dict[str, list[bytes]], counts: dict[str, np.ndarray], phi: float):
        self.langs = sorted(words)
        self.place = {x: i for i, x in enumerate(self.langs)}
        self.index, self.words, self.chars = [], [], []
        for x in self.langs:
            got = counts.get(x, np.zeros(len(CLASSES) + len(words[x]) + 1, np.int64))
            chars, hits, total = got[: len(CLASSES)], got[len(CLASSES) : -1], got[-1]
            keep = np.flatnonzero(hits >= phi * total)
            self.index.append({words[x][j]: i for i, j in enumerate(keep)})
            self.words.append(np.append(hits[keep], total - hits[keep].sum()) / max(total, 1))
            self.chars.append(chars / max(chars.sum(), 1))
        self.chars_most = np.full(len(self.langs), CHARS_MOST)
        bare = [float(distance(np.eye(len(x))[-1], x)) for x in self.words]
        self.words_most = [min(WORDS_MOST, BARE * d) if x[-1] <= 1 - LEAST_COMMON else WORDS_MOST for d, x in zip(bare, self.words, strict=True)]


def references(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", phi: float = PHI) -> References:
    """References of every language, counted over all its documents."""
    rows = _rows(df, key, text, lang)
    words = _candidates(rows, phi)
    shared = rows.sparkSession.sparkContext.broadcast({k: {w: i for i, w in enumerate(v)} for k, v in words.items()})

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for c, codes, names in _by_language(batch):
                raw, kinds = c.raw.tobytes(), _class_counts(c)
                for i in np.flatnonzero((codes >= 0) & (c.n_words > 0)):
                    name = names[codes[i]]
                    index = shared.value.get(name)
                    if index is None:
                        continue
                    sums = total.setdefault(name, np.zeros(len(CLASSES) + len(index) + 1, np.int64))
                    at = [*map(index.get, raw[c.offsets[i] : c.offsets[i + 1]].split())]
                    hits = np.array([x for x in at if x is not None], np.int64)
                    sums[: len(CLASSES)] += kinds[i]
                    sums[len(CLASSES) : -1] += np.bincount(hits, minlength=len(index))
                    sums[-1] += len(at)
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums), pa.string()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["lang", "bin", "n"])

    found: dict[str, np.ndarray] = {}
    for r in mapped(rows.where(F.col("lang").isNotNull()), run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r.lang, np.zeros(len(CLASSES) + len(words[r.lang]) + 1, np.int64))[r.bin] = r.n
    refs = References(words, found, phi)
    for name, counts in _char_distances(rows, refs).items():
        median = (np.searchsorted(np.cumsum(counts), counts.sum() / 2) + 1) / STEPS
        refs.chars_most[refs.place[name]] = median + CHARS_ABOVE
    return refs


def _char_distances(rows: DataFrame, refs: References) -> dict[str, np.ndarray]:
    """Per language, how many of its texts have which distance in characters, in steps of 1 / STEPS."""
    shared = rows.sparkSession.sparkContext.broadcast((refs.place, refs.chars))

    def run(batches):
        place, chars = shared.value
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for c, codes, names in _by_language(batch):
                kinds, size = _class_counts(c), np.diff(c.offsets)
                for code, name in enumerate(names):
                    at = np.flatnonzero((codes == code) & (size >= CHARS_FROM))
                    if name in place and len(at):
                        steps = (distance(kinds[at] / size[at, None], chars[place[name]]) * STEPS).astype(int)
                        total[name] = total.get(name, 0) + np.bincount(np.minimum(steps, STEPS - 1), minlength=STEPS)
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], names=["lang", "step", "n"])

    out: dict[str, np.ndarray] = {}
    if refs.langs:
        for r in mapped(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), run, "lang string, step int, n long").groupBy("lang", "step").agg(F.sum("n").alias("n")).collect():
            out.setdefault(r.lang, np.zeros(STEPS, np.int64))[r.step] = r.n
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of distributions in the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


def rules(df: DataFrame, refs: References, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: the base counts, base_failed, both distances (null where not tested) and kept."""
    rows = _rows(df, key, text, lang)
    kind = dict(rows.dtypes)["key"]
    shared = rows.sparkSession.sparkContext.broadcast(refs)  # some hundreds of words for each language
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]

    def run(batches):
        r = shared.value
        for batch in batches:
            parts = []
            for c, codes, langs in _by_language(batch):
                n_words, n_chars, n_symbols, n_lines, n_repeat = _base(c)
                failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
                raw, kinds, size = c.raw.tobytes(), _class_counts(c), np.diff(c.offsets)
                by_char, by_word = np.full(c.n, np.nan), np.full(c.n, np.nan)
                odd_char, odd_word = np.zeros(c.n, bool), np.zeros(c.n, bool)
                for i in np.flatnonzero(size >= CHARS_FROM):
                    own = r.place.get(langs[codes[i]]) if codes[i] >= 0 else None
                    against = range(len(r.langs)) if own is None else [own]
                    if len(against):
                        found = [distance(kinds[i] / size[i], r.chars[k]) for k in against]
                        by_char[i], odd_char[i] = min(found), all(d > r.chars_most[k] for d, k in zip(found, against, strict=True))
                    if len(against) and n_words[i] >= WORDS_FROM:
                        words = raw[c.offsets[i] : c.offsets[i + 1]].split()
                        odd_word[i] = True
                        for k in against:
                            hits = np.array([x for x in map(r.index[k].get, words) if x is not None], np.int64)
                            h = np.append(np.bincount(hits, minlength=len(r.index[k])), len(words) - len(hits)) / len(words)
                            d = distance(h, r.words[k])
                            by_word[i], odd_word[i] = np.fmin(by_word[i], d), odd_word[i] and d > r.words_most[k]
                kept = ~failed & ~odd_char & ~odd_word
                parts.append((n_words, n_chars, n_symbols, n_lines, n_repeat, failed, by_char, by_word, kept))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in columns[:5]), pa.array(columns[5]), *(pa.array(x, pa.float64(), from_pandas=True) for x in columns[6:8]), pa.array(columns[8])], names=names)

    return mapped(rows, run, f"`{key}` {kind}, " + ", ".join(f"{x} long" for x in names[1:6]) + ", base_failed boolean, char_distance double, word_distance double, kept boolean")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return rules(docs, references(docs))
