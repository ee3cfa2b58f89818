"""Substring deduplication with suffix automata of reference shards.

A window is W consecutive words of a document. Every word covered by a window whose words also occur earlier (in a smaller
document, or in the same one with an earlier start) is removed; windows are judged on the input.

Equal windows meet in one shard: each window has an anchor, the least hash of its ANCHOR-word sequences, which depends on
its words alone. Windows that share the place of their anchor are a run. Of the runs whose anchor occurs twice or more
(found by counting, and kept in a filter of fixed size; a false positive costs time only) equal ones are one, with the
earliest as its owner; all windows of the others are removed. A shard is a set of anchors' runs. It holds its reference, a
suffix automaton of the runs' words, and streams the runs in the order of their owners: matching statistics against
the automaton of all earlier text give, at each word, the longest match that ends there; where it spans W words or more
the window is removed. Then the run joins the automaton. So a shard is sent to one task once, with just the text that can match it, instead of to all
tasks: broadcast to all, shards times documents would be scanned.

Anchors with very many different runs (a short common passage in many surroundings) would make a hot shard. Their runs are cut
into windows of W words, and of equal windows all but the earliest are removed, by one aggregation and one join.

Defined cases: words are of ``[^\\x20\\x09-\\x0D]``, unchanged; null, empty and short texts lose nothing; a null id sorts before all
others; rows with equal id and equal text are one document, rows with equal id and other text are ordered by the
text's hash; an empty table gives an empty table; further columns are kept if named.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import scratch
from .textbatch import Chunk, chunks, mix
from .workers import mapped

W, ANCHOR = 20, 8
#: Bits of the filter of repeated anchors; 8 MB.
FILTER = 1 << 26
#: Runs of an anchor beyond which its windows are dealt out one by one, and runs in a shard.
HOT, SHARD = 1000, 1000
#: Runs that a task remembers.
SEEN = 200_000
_NULL_ID = -(1 << 63)


def anchors(c: Chunk, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a chunk's windows: first word (in the chunk), number of windows, and anchor hash."""
    grams = c.gram_hashes(c.word_hashes(), k)
    ok = c.inside(w)
    n = len(ok)
    if not ok.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    place = np.arange(n)
    best, at = grams[:n].copy(), place.copy()
    for step in range(1, w - k + 1):  # the leftmost least of the window's k-word hashes
        other = grams[step : step + n]
        less = other < best
        best[less], at[less] = other[less], place[less] + step
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1] | (c.doc[1:n] != c.doc[: n - 1])
    starts = np.flatnonzero(new & ok)
    stop = np.append(np.flatnonzero(new | ~ok), n)
    ends = stop[np.searchsorted(stop, starts, "right")]
    return starts, ends - starts, best[starts]


def _rows(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"), *(F.col(x).alias(f"keep_{i}") for i, x in enumerate(keep)))


def _repeated(rows: DataFrame, w: int, k: int) -> np.ndarray:
    """The filter of anchors that occur twice or more."""

    def run(batches):
        held, size = [], 0

        def count():
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for c in chunks(batch.column(0)):
                held.append(anchors(c, w, k)[2])
                size += len(held[-1])
                if size > 1_000_000:
                    yield count()
                    size = 0
        yield count()

    def bits(batches):
        out = np.zeros(FILTER >> 6, np.uint64)
        for batch in batches:
            bit = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(FILTER - 1)
            np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].view(np.int64))], names=["word", "bits"])

    counted = mapped(rows.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    found = mapped(counted, bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**20 rows at most
    out = np.zeros(FILTER >> 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _occurrences(rows: DataFrame, w: int, k: int, wanted) -> DataFrame:
    """h, rh (hash of the run's words), doc, th, pos (first word in the document), n (windows), words (the run's text, which a task
    gives only once for most equal runs)."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in chunks(batch.column(2)):
                starts, n, h = anchors(c, w, k)
                bit = mix(h) & np.uint64(FILTER - 1)
                hit = ((wanted.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
                starts, n, h = starts[hit], n[hit], h[hit]
                if not len(starts):
                    continue
                a, b = c.starts[starts], c.ends[starts + n + w - 2]
                raw, doc = c.raw.tobytes(), c.doc[starts]
                words = [b" ".join(raw[i:j].split()) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                rh = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in words]
                for i, x in enumerate(rh):
                    if x in seen:
                        words[i] = None
                    seen.add(x)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rh, pa.int64()), pa.array(ids[c.first + doc]), pa.array(hashes[c.first + doc]), pa.array((starts - c.first_word[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(words, pa.binary())], names=["h", "rh", "doc", "th", "pos", "n", "words"])

    return mapped(rows.select("doc", "th", "text"), run, "h long, rh long, doc long, th long, pos int, n int, words binary")


class Automaton:
    """Suffix automaton of word sequences, built word by word, with matching statistics against what it holds so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.last = 0
        self.state = self.matched = 0

    def begin(self) -> None:
        """A new sequence begins."""
        self.last = self.state = self.matched = 0

    def match(self, word) -> int:
        """How many words up to and with this one occur in the text held so far."""
        nxt, link = self.next, self.link
        v, n = self.state, self.matched
        while v and word not in nxt[v]:
            v = link[v]
            n = self.len[v]
        to = nxt[v].get(word)
        if to is None:
            self.state = self.matched = 0
            return 0
        self.state, self.matched = to, n + 1
        return n + 1

    def add(self, word) -> None:
        """Appends a word to the current sequence."""
        nxt, link, length = self.next, self.link, self.len
        p = self.last
        q = nxt[p].get(word)
        if q is not None and length[p] + 1 == length[q]:
            self.last = q
        elif q is not None:
            self.last = self._split(p, q, word)
        else:
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[p] + 1)
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[new] = q if length[p] + 1 == length[q] else self._split(p, q, word)
            self.last = new
        # A split can have put the matched sequence into a shorter state.
        while self.state and length[link[self.state]] >= self.matched:
            self.state = link[self.state]

    def _split(self, p: int, q: int, word) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy


def removals(runs: list[list[bytes]], w: int) -> list[list[int]]:
    """For runs in order, the places where windows start that occur earlier, in this or an earlier run."""
    auto, names, out = Automaton(), {}, []
    for words in runs:
        auto.begin()
        hit = []
        for i, x in enumerate(words):
            x = names.setdefault(x, len(names))
            if auto.match(x) >= w:
                hit.append(i - w + 1)
            auto.add(x)
        out.append(hit)
    return out


def _shard_kernel(w: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("th", "ascending"), ("pos", "ascending")])
        hits = removals([x.split() for x in table["words"].to_pylist()], w)
        doc, th, pos = (table[x].to_numpy() for x in ("doc", "th", "pos"))
        count = np.array([len(x) for x in hits], np.int64)
        row = np.repeat(np.arange(len(hits)), count)
        start = pos[row] + np.array([i for x in hits for i in x], np.int64)
        # Neighbouring windows become one span.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1 if len(row) else first
        return pa.table({"doc": doc[row[first]], "th": th[row[first]], "a": start[first].astype(np.int32), "b": (start[last] + w).astype(np.int32)})

    return run


def _windows(batches, w: int):
    """Runs of hot anchors, cut into windows: the digest of each window's words (16 bytes), and its place."""
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
    for batch in batches:
        out = []
        for doc, th, pos, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            parts = words.split(b" ")
            out += [(hashlib.blake2b(b" ".join(parts[i : i + w]), digest_size=16).digest(), doc, th, pos + i) for i in range(len(parts) - w + 1)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["window", "doc", "th", "pos"])


def _later(cut: DataFrame, w: int) -> DataFrame:
    """The spans of all windows but the earliest of each digest. Equal windows meet in an aggregation that is combined before
    the shuffle, and in a join whose hot keys can be split, so a passage that very many texts share makes no large group."""
    place = F.struct("doc", "th", "pos")
    first = scratch.table(cut.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("window", "first"), "first-windows")
    return cut.join(first, "window").where(place != F.col("first")).select("doc", "th", F.col("pos").alias("a"), (F.col("pos") + w).cast("int").alias("b"))


def spans(rows: DataFrame, w: int = W, k: int = ANCHOR) -> DataFrame:
    """doc, th, spans (array of a, b): words a to b (excluded) of a document are removed. Spans may overlap."""
    spark = rows.sparkSession
    wanted = spark.sparkContext.broadcast(_repeated(rows, w, k))
    found = scratch.table(_occurrences(rows, w, k, wanted), "occurrences")
    scratch.release(wanted)
    # The earliest of equal runs is their owner; its words come along in the same aggregation.
    first = found.groupBy("h", "rh").agg(F.min(F.struct("doc", "th", "pos")).alias("o"), F.max("words").alias("words"))
    firsts = scratch.table(first.select("h", "rh", "o.doc", "o.th", "o.pos", "words"), "runs")
    scratch.sweep(spark)
    owners = firsts.select("h", "rh", F.struct("doc", "th", "pos").alias("owner"))
    later = found.select("h", "rh", "doc", "th", "pos", "n").join(owners, ["h", "rh"]).where(F.struct("doc", "th", "pos") != F.col("owner"))
    copies = later.select("doc", "th", F.col("pos").alias("a"), (F.col("pos") + F.col("n") + (w - 1)).cast("int").alias("b"))
    per = firsts.groupBy("h").agg(F.count("*").alias("runs"))
    shards = max(64, -(-firsts.count() // SHARD))
    hot = scratch.table(per.where(F.col("runs") > HOT).select("h"), "hot-anchors")
    dealt = firsts.join(hot, "h", "left_anti").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    matched = dealt.select("shard", "doc", "th", "pos", "words").groupBy("shard").applyInArrow(_shard_kernel(w), "doc long, th long, a int, b int")
    made = [found, firsts, hot]
    if not hot.isEmpty():
        cut = scratch.table(mapped(firsts.join(hot, "h").select("doc", "th", "pos", "words"), lambda b: _windows(b, w), "window binary, doc long, th long, pos int"), "windows")
        matched = matched.unionByName(_later(cut, w))
        made.append(cut)
    out = scratch.table(matched.unionByName(copies).groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    scratch.release(*made)
    scratch.sweep(spark)
    return out


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", w: int = W, k: int = ANCHOR, keep: list[str] | None = None) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, kept_text (the text without the removed words), and the columns in keep.

    kept_text: a removed span goes from its first word to its last; white space around it stays; null for a null text."""
    keep = [x for x in keep or [] if x != key]
    rows = _rows(df, key, text, keep)
    lists = spans(rows.select("doc", "th", "text"), w, k)
    joined = rows.join(lists, ["doc", "th"], "left").select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc"), "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"), *(F.col(f"keep_{i}") for i in range(len(keep))))
    extra = [(x, df.schema[x].dataType.simpleString()) for x in keep]
    schema = f"`{key}` long, n_words long, n_removed long, kept_sha256 string, kept_text string" + "".join(f", `{x}` {t}" for x, t in extra)

    def run(batches):
        for batch in batches:
            total, removed, digest, left = [], [], [], []
            a, b, there = batch.column(2), batch.column(3), batch.column(1).is_valid()
            for c in chunks(batch.column(1)):
                raw = c.raw.tobytes()
                for i in range(c.n):
                    n, first, at = int(c.n_words[i]), int(c.first_word[i]), c.first + i
                    body = raw[c.offsets[i] : c.offsets[i + 1]]
                    total.append(n)
                    if not a[at].is_valid:
                        removed.append(0)
                        digest.append(hashlib.sha256(b" ".join(body.split())).hexdigest())
                        left.append(body.decode("utf-8", "replace") if there[at].as_py() else None)
                        continue
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, a[at].values.to_numpy(), 1)
                    np.add.at(step, b[at].values.to_numpy(), -1)
                    gone = np.cumsum(step)[:n] > 0
                    removed.append(int(gone.sum()))
                    words = body.split()
                    digest.append(hashlib.sha256(b" ".join([words[j] for j in np.flatnonzero(~gone)])).hexdigest())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
                    parts, back = [], 0
                    for p, q in zip(edge[::2], edge[1::2], strict=True):
                        parts.append(body[back : c.starts[first + p] - c.offsets[i]])
                        back = c.ends[first + q - 1] - c.offsets[i]
                    left.append(b"".join([*parts, body[back:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.string()), *batch.columns[4:]], names=[key, "n_words", "n_removed", "kept_sha256", "kept_text", *keep])

    return mapped(joined, run, schema)


def op5_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
