"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

Suspicious tokens (leetspeak digits and signs next to letters, letters repeated three times or more, letters parted by
signs, runs of spaced single letters) become a lattice of characters: each sign stands for the letters it resembles or, if
it is a mere separator, for none; a run of one letter stands for one or two. A Viterbi search finds the path with the best sum
of channel cost and trigram character language model. Restored words and plain words are then scored alike.

The language model's counts are taken over every text of the corpus. The word model is learned from labelled rows: of all
beginnings of words (4 to 8 letters) and whole words, those whose share of toxic documents is significantly and
almost exclusively high. A document's score is 1 minus the product of the remaining doubts of the features it holds.

Training takes at most ``TRAIN_ROWS`` labelled rows, the same ones on every run (by hash of the id); equal texts count
once. Defined cases: null and empty texts, and texts without any feature, score 0; without labels all texts score 0;
repeated rows get equal scores; an empty table gives an empty table; further columns are ignored; scores don't depend on
labels, language, source or id of the row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import scratch
from .textbatch import chunks
from .workers import mapped

TRAIN_ROWS = 12_000
THRESHOLD = 0.7
#: Beginnings of words of these lengths are features, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature needs at least this share of toxic documents, after smoothing, and so many of them.
PRECISION, LEAST_DOCS = 0.9, 3
#: Longest word and longest spaced run that is decoded in one piece.
LONGEST = 48

#: Tokens whose reading a task remembers.
CACHE = 100_000

#: What signs can stand for (fixed values of the channel).
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "¡": "i", "£": "l", "¥": "y", "*": "aeiou", "#": "h"}
SEPARATORS = set(".-_*~'^·:,;/\\|+=")
#: Costs of the channel, in nats: a sign for a letter, a separator for nothing, one letter fewer in a run, an unread sign.
SIGN, NOTHING, REPEAT, UNREAD = 0.7, 0.4, 0.3, 6.0

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EDGE, _OTHER = 0, 27
SIZE = 28
_CODE = np.full(256, _OTHER, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[[9, 10, 11, 12, 13, 32]] = _EDGE

_STRIP = re.compile(r"^[^\w@$!|+(<€¡£¥*#]+|[^\w@$!|+(<€¡£¥*#]+$")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SUSPECT = re.compile(r"[^\W\d_][\W_\d]+[^\W\d_]|[\d@$!|+(<€¡£¥*#][^\W\d_]|[^\W\d_][\d@$!|+(<€¡£¥*#]|([^\W\d_])\1\1")


# Language model


def count_characters(df: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n: counts of character trigrams over all texts; words begin and end with an edge."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                # As in decoding, a letter beyond ASCII is one symbol, whatever its bytes.
                code = np.concatenate([[0], _CODE[c.raw[(c.raw & 0xC0) != 0x80]], [0]]).astype(np.int32)
                if len(code) > 2:
                    total += np.bincount(code[:-2] * SIZE * SIZE + code[1:-1] * SIZE + code[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return mapped(df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Trigram model with interpolation; cost[a, b, c] is -log P(c | a, b)."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + SIZE)
        p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per run of equal characters, what it can stand for and at which cost."""
    out = []
    for run in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = run[1], len(run[0])
        if c in _LETTERS:
            ways = [(c, 0.0 if n == 1 else REPEAT)] + ([(c + c, 0.0 if n == 2 else REPEAT)] if n > 1 else [])
        elif c in RESEMBLES or c in SEPARATORS:
            ways = [(x * k, SIGN * k + REPEAT * (n > k)) for x in RESEMBLES.get(c, "") for k in (1, 2) if k <= n]
            ways.append(("", NOTHING if c in SEPARATORS else UNREAD / 2))
        else:
            ways = [(c, 0.0)] if c.isalpha() else [("", UNREAD)]
        out.append(ways)
    return out


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest plain word behind a token (lower case), by Viterbi search over the last two characters."""
    code = {x: i + 1 for i, x in enumerate(_LETTERS)}
    best = {(0, 0): (0.0, "")}
    cost = model.cost
    for ways in lattice(token[:LONGEST]):
        new: dict = {}
        for (a, b), (so_far, read) in best.items():
            for add, price in ways:
                x, y, total = a, b, so_far + price
                for c in add:
                    z = code.get(c, _OTHER)
                    total += cost[x][y][z]
                    x, y = y, z
                old = new.get((x, y))
                if old is None or total < old[0]:
                    new[x, y] = (total, read + add)
        best = new
    return min(((t + cost[a][b][0], r) for (a, b), (t, r) in best.items()), default=(0, ""))[1]


# Words of a text


def _plain(token: str) -> str:
    return _EDGES.sub("", token)


def restored(text: str, model: CharacterModel, cache: dict[str, tuple[str, ...]]) -> set[str]:
    """The distinct words of a text, in lower case: plain ones as they are, suspicious ones also as decoded."""
    tokens = text.lower().split()
    out: set[str] = set()
    for token in set(tokens):
        got = cache.get(token)
        if got is None:
            word = _plain(token)
            got = (word,) if word else ()
            if len(token) > 2 and _SUSPECT.search(token):
                body = _STRIP.sub("", token)
                if len(token) > LONGEST:
                    got += tuple({x for line in {body, _plain(body)} for x in windows(line, model)})
                else:
                    got += (decode(body, model), decode(_plain(body), model))
            if len(cache) > CACHE:
                cache.clear()
            cache[token] = got
        out.update(got)
    if len(tokens) > 2:
        out.update(spaced(tokens, model))
    out.discard("")
    return out


def spaced(tokens: list[str], model: CharacterModel):
    """Words hidden in runs of three or more one-character tokens; each run is cut into overlapping windows, as long tokens are."""
    short = np.fromiter(map(len, tokens), np.int64, len(tokens)) <= 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], short, [0])).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= 3:
            yield from windows("".join(tokens[a:b]), model)


def windows(line: str, model: CharacterModel):
    """What overlapping windows of a long run read, and all that begins later in them."""
    line = re.sub(r"(.)\1{2,}", r"\1\1", line, flags=re.DOTALL)
    for i in range(0, max(1, len(line) - LONGEST // 2), LONGEST // 2):
        read = decode(line[i : i + LONGEST], model)
        yield read
        yield from (read[j:] for j in range(1, len(read) - 3))


def _features(words: set[str]) -> set[str]:
    out = set(words)
    for w in words:
        if len(w) >= BEGINNINGS[0]:
            out.update(w[:k] + "…" for k in BEGINNINGS if k <= len(w))
    return out


# Word model


class WordModel:
    def __init__(self, features: dict[str, float], characters: CharacterModel):
        self.whole = {k: math.log1p(-v) for k, v in features.items() if not k.endswith("…")}
        self.start = {k[:-1]: math.log1p(-v) for k, v in features.items() if k.endswith("…")}
        self.lengths = tuple(sorted({len(k) for k in self.start}))
        self.characters = characters

    def score(self, text: str | None, cache: dict) -> float:
        doubt = 0.0
        for w in restored(text or "", self.characters, cache):
            best = self.whole.get(w, 0.0)
            for k in self.lengths:
                if len(w) < k:
                    break
                best = min(best, self.start.get(w[:k], 0.0))
            doubt += best
        return 1.0 - math.exp(doubt)


def _signatures(batches):
    """signature, text, label: the least hash of the text's 3-word sequences, or of the text if it has fewer words."""
    for batch in batches:
        out = []
        for c in chunks(batch.column(1)):
            grams, inside = c.gram_hashes(c.word_hashes(), 3), c.inside(3)
            least = np.full(c.n, np.iinfo(np.int64).max)
            np.minimum.at(least, c.doc[: len(inside)][inside], grams[inside].view(np.int64))
            for i in np.flatnonzero(c.n_words < 3):
                least[i] = int.from_bytes(hashlib.sha1(c.raw[c.offsets[i] : c.offsets[i + 1]].tobytes()).digest()[:7], "big")
            out.append(least)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), batch.column(1), batch.column(2)], names=["signature", "text", "label"])


def fit(labels: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> WordModel:
    """labels: key and label of the rows to learn from. docs: key and text of all rows; their texts train the language model."""
    counts = np.zeros(SIZE**3)
    for r in count_characters(docs, text).collect():
        counts[r.bucket] = r.n
    characters = CharacterModel(counts)
    shared = docs.sparkSession.sparkContext.broadcast(characters)
    chosen = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("key"), "key").limit(rows)
    # At most `rows` ids and labels are broadcast, so the texts stay where they are until the few that are needed are known.
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    # Copies and most near copies count once, lest the other words of a toxic text that has copies look toxic too.
    sample = mapped(labelled.where(F.col("text").isNotNull()).select("key", "text", "label"), _signatures, "signature long, text string, label int").groupBy("signature").agg(F.max(F.struct("label", "text")).alias("x")).select("x.text", "x.label")

    def run(batches):
        cache: dict = {}
        bad, good, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _features(restored(t, shared.value, cache))
                (bad if y else good).update(found)
                n[bool(y)] += 1
        # Only features of toxic documents matter; the clean ones' counts are sent for those and for the totals.
        for x, y in ((bad, 1), (good, 0)):
            keys = list(x)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([x[k] if y else 0 for k in part], pa.int64()), pa.array([0 if y else x[k] for k in part], pa.int64())], names=["feature", "bad", "good"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([n[1]], pa.int64()), pa.array([n[0]], pa.int64())], names=["feature", "bad", "good"])

    spread = sample.repartition(24, F.xxhash64("text"))
    seen = mapped(spread, run, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= LEAST_DOCS)
    seen = scratch.table(seen, "features")
    scratch.release(shared)
    total = seen.where(F.col("feature") == "").collect()
    if not total or not total[0].bad:
        scratch.release(seen)
        return WordModel({}, characters)
    base = total[0].bad / (total[0].bad + total[0].good)
    p = (F.col("bad") + F.lit(base)) / (F.col("bad") + F.col("good") + 1.0)
    likely = seen.where((F.col("feature") != "") & (p >= PRECISION)).select("feature", "bad", p.alias("p"))
    # Chance finds: among so many features, one that only chance brought into toxic documents may reach this evidence.
    evidence = math.log(max(10.0, 3.0 * likely.count())) + 2.0
    # At most as many features as the words of `rows` documents give.
    picked = likely.where(F.col("bad") * F.log(F.col("p") / base) >= evidence).collect()
    scratch.release(seen)
    return WordModel({r.feature: min(r.p, 0.995) for r in picked}, characters)


def score(df: DataFrame, model: WordModel, key: str = "doc_id", text: str = "text", column: str = "score") -> DataFrame:
    """key and score of every row, from its whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches):
        cache: dict = {}
        for batch in batches:
            found = [shared.value.score(x.as_py(), cache) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[key, column])

    return mapped(rows, run, f"`{key}` {kind}, `{column}` double")


def reject(df: DataFrame, model: WordModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(x.as_py(), cache) < threshold for x in batch.column(place)], pa.bool_()))

    return mapped(df, run, df.schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on_labels(spark, documents: DataFrame, sf_dir: str) -> WordModel:
    """The model from the rows of ``labels`` that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return fit(labels, documents.select("doc_id", "text"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit_on_labels(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
