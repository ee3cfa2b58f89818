"""Language identification by error-correcting output codes.

Each language gets a codeword of +1 and -1 bits. One binary n-gram classifier per bit predicts that bit from hashed
byte trigrams: its weight for a trigram is the log ratio of the trigram's smoothed frequency in the languages whose
bit is +1 to that in the others, counted over all training rows. Decoding is loss-weighted: a bit's logistic loss counts
as much as the classifier separates its two sides, the nearest codeword wins, and a small gap to the second is flagged.

Defined cases: a null text and a text without a letter give language ``und``, score 0 and no flag; with no training rows
every row is ``und``; ties go to the smaller language by code point; repeated rows get equal answers; an empty table
gives an empty table; other columns never take part. Counts are the only thing gathered: at most 2**BITS numbers for
each language, whatever the number of rows; more than LANGUAGES languages are refused, since every task holds the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import scratch
from .textbatch import chunks
from .workers import mapped

BITS = 15
LANGUAGES = 4096
#: Trigrams of a text that are looked up at once.
STEP = 1 << 18
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[48:58] = 48
_LOW[[9, 10, 11, 12, 13]] = 32


def _features(raw: np.ndarray) -> np.ndarray:
    """Hash bucket of the trigram that starts at each byte (the last two have none)."""
    b = _LOW[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _inside(n: int, offsets: np.ndarray) -> np.ndarray:
    """Which trigrams lie inside one text."""
    ok = np.ones(max(0, n - 2), bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def codewords(n: int, length: int | None = None, seed: int = 11) -> np.ndarray:
    """n codewords of +1 and -1, far from each other: the best of some random codes, by their least distance."""
    length = length or max(7, 5 * int(np.ceil(np.log2(max(2, n)))))
    rng = np.random.default_rng(seed)
    best, least = None, -1
    for _ in range(200 if n <= 64 else 10):
        code = np.where(rng.random((n, length)) < 0.5, -1, 1)
        for j in range(length):  # a bit that is the same for all languages can't be learned
            if n > 1 and abs(code[:, j].sum()) == n:
                code[rng.integers(n), j] *= -1
        d = min(((code[i] != code[:i]).sum(1).min() for i in range(1, n)), default=0)
        if d > least:
            best, least = code, d
    return best


def count_trigrams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows with a language; counted per partition first."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for c in chunks(batch.column(1)):
                f = _features(c.raw)
                keep = _inside(len(c.raw), c.offsets)
                owner = np.repeat(codes[c.first : c.first + c.n], np.diff(c.offsets))[: len(f)]
                for k in np.unique(owner):
                    total[names[k]] = total.get(names[k], 0) + np.bincount(f[(owner == k) & keep], minlength=1 << BITS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return mapped(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs)) if langs else np.zeros((0, 1))
        smooth = counts + 0.5
        p = smooth / smooth.sum(1, keepdims=True)
        weights, loss = [], []
        for bit in self.code.T:
            up, down = p[bit > 0], p[bit < 0]
            if not len(up) or not len(down):
                weights.append(np.zeros(p.shape[1]))
                loss.append(0.0)
                continue
            w = np.log(up.mean(0)) - np.log(down.mean(0))
            ups, downs = up @ w, down @ w  # expected margins of the languages on both sides
            middle, gap = (ups.min() + downs.max()) / 2, ups.min() - downs.max()
            weights.append((w - middle) / max(gap / 2, 0.05))
            loss.append(max(gap, 0.01))
        self.weights = np.array(weights, np.float32).T.copy()
        self.loss = np.array(loss) / max(sum(loss), 1e-9)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score, and ambiguity, for rows of margins."""
        spread = np.clip(margins, -4, 4)[:, None, :] * self.code[None, :, :]
        cost = (np.logaddexp(0, -4 * spread) * self.loss).sum(2)
        share = np.exp(cost.min(1, keepdims=True) - cost)
        share /= share.sum(1, keepdims=True)
        best = cost.argmin(1)
        top = np.sort(share, 1)[:, ::-1]
        return best, top[:, 0], (top[:, 0] - top[:, 1] < 0.2) if share.shape[1] > 1 else np.zeros(len(best), bool)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    counted = scratch.table(count_trigrams(df, text, lang), "trigrams")
    if counted.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; the column of languages seems to hold something else")
    rows = counted.collect()
    scratch.release(counted)
    langs = sorted({r.lang for r in rows})
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), 1 << BITS))
    for r in rows:
        counts[place[r.lang], r.bucket] = r.n
    return Model(langs, counts)


def _has_letter(raw: np.ndarray) -> bool:
    low = raw | 32
    if ((low >= 97) & (low <= 122) & (raw < 128)).any():
        return True
    return bool((raw >= 128).any()) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", undetermined: str = "und") -> DataFrame:
    """key, lang_pred, score, ambiguous, for every row and whole texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of one float for each bit
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores, flags = [], [], []
            for c in chunks(batch.column(1), 1 << 19):
                size = np.diff(c.offsets)
                margins = np.zeros((c.n, m.weights.shape[1] if m.langs else 1))
                if m.langs and len(c.raw) > 2:
                    found, ok, full = _features(c.raw), _inside(len(c.raw), c.offsets), np.flatnonzero(size)
                    for a in range(0, len(found), STEP):
                        w = m.weights[found[a : a + STEP]]
                        w[~ok[a : a + STEP]] = 0
                        at = full[(c.offsets[full] < a + len(w)) & (c.offsets[full + 1] > a)]
                        margins[at] += np.add.reduceat(w, np.maximum(c.offsets[at] - a, 0), axis=0, dtype=np.float64)
                    margins /= np.maximum(size[:, None] - 2, 1)
                best, share, unsure = m.decode(margins) if m.langs else (None, None, None)
                for i in range(c.n):
                    if m.langs and _has_letter(c.raw[c.offsets[i] : c.offsets[i + 1]]):
                        names.append(m.langs[best[i]])
                        scores.append(float(share[i]))
                        flags.append(bool(unsure[i]))
                    else:
                        names.append(undetermined)
                        scores.append(0.0)
                        flags.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=[key, "lang_pred", "score", "ambiguous"])

    return mapped(rows, run, f"`{key}` {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(key: str = "doc_id", mod: int = 5, left: int = 0):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod)) == left, F.lit(False))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
