"""N-gram Jaccard join in metric space: pivots, Voronoi regions and triangle-inequality windows, joined recursively and exactly.

d(x, y) = 1 - |x and y| / |x or y| is a metric on sets of word shingles. Two sets link if d is at most EPS = 1 - threshold.
Almost all pairs of texts are at distance 1, where no window of the triangle inequality excludes anything; so pivots are not
taken at random but from the places where distances are below 1:

* Equal sets are one class. Classes are put into regions by the prefix principle: with the shingles of every set in one
  global order, sets that link share a shingle among the first n - ceil(threshold * n) + 1. Common shingles stand last in that order,
  so they seldom make regions. (The order comes from counts over all documents, in a table of 2**22 counters; it
  decides about cost only, not about results.)
* Each region's first pivot is its most central set: the one with the fewest rarer shingles before the region's. All members'
  distances to it are computed; members within EPS are linked to it. Such stars are joined to components.
* A pair matters in the region of the first shingle it shares only, where sizes and places bound what it can share.
* Regions whose members are one component by now are done: their other links join what is joined already. The others
  are handled recursively: of the members outside the region's largest component, a number become pivots, twice as many each
  time, and are compared with all members outside their own component that lie in the window |d(x, first) - d(pivot, first)| <= EPS,
  then leave the region. This goes on until every region is one component or has no pair left.

Every pair with a shared prefix shingle is thus linked by its distance, excluded by size, position or window, or in one
component, so components are exact. No step puts a region into one task: stars and pivots are equi-joins between tables, which adaptive execution splits
where a region is hot, and every selection aggregates before the shuffle. Sets are compared by 64-bit hashes of shingles.

Defined cases: words are of ``[^\\x20\\x09-\\x0D]``, A to Z lower-cased; a text with fewer words than a shingle has the whole
sequence as its one shingle; null and empty texts have empty sets and link with nothing; rows with a null id get no
component and take no part; repeated rows are in one class; ties go to the smaller id; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import scratch
from .components import components
from .textbatch import Chunk, chunks, mix
from .workers import mapped

COUNTERS = 1 << 22
#: Counters that travel together.
CELL = 1 << 12
#: Bits of the filter that says which sets are worth shipping; false positives cost time only.
FILTER = 1 << 26
PIVOTS = 64
#: A region takes more pivots at a time while it has no more than so many pairs of a member and a pivot.
EXAMINED = 4_000_000
#: A region that seems to have more members than this is read in parts, each with a first pivot of its own.
PART = 20_000


def shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a chunk's texts, sorted by text and hash, and the text of each."""
    words = c.word_hashes()
    grams, inside = c.gram_hashes(words, k), c.inside(k)
    values, owners = [grams[inside]], [c.doc[: len(inside)][inside]]
    for n in range(1, k):  # texts of n words have one shingle
        short = np.flatnonzero(c.n_words == n)
        if len(short):
            at = c.first_word[short]
            values.append(c.gram_hashes(words, n)[at] ^ np.uint64(n))
            owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def _digests(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two independent sums of scrambled members of each of n sets."""
    size = np.bincount(owner, minlength=n)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value ^ np.uint64(salt)), out=total[1:])
        end = np.cumsum(size)
        out.append((total[end] - total[end - size]).view(np.int64))
    return size, *out


def scan(rows: DataFrame, k: int) -> DataFrame:
    """First pass, two kinds of rows: (doc, n, h1, h2) for each text, and (cell, counts) of shingles for the order."""
    names = ["doc", "n", "h1", "h2", "cell", "counts"]

    def run(batches):
        counts, held, size = np.zeros(COUNTERS, np.uint32), [], 0

        def count():
            if held:
                np.add(counts, np.bincount(np.concatenate(held), minlength=COUNTERS), out=counts, casting="unsafe")
                held.clear()

        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                value, owner = shingles(c, k)
                n, h1, h2 = _digests(value, owner, c.n)
                held.append((value & np.uint64(COUNTERS - 1)).astype(np.int32))
                size += len(value)
                if size > 1_000_000:
                    count()
                    size = 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(n), pa.array(h1), pa.array(h2), pa.nulls(c.n, pa.int32()), pa.nulls(c.n, pa.binary())], names=names)
        count()
        for first in range(0, COUNTERS, CELL * 64):
            cells = [i for i in range(first, first + CELL * 64, CELL) if counts[i : i + CELL].any()]
            none = pa.nulls(len(cells), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i // CELL for i in cells], pa.int32()), pa.array([np.minimum(counts[i : i + CELL], 65535).astype(np.uint16).tobytes() for i in cells], pa.binary())], names=names)

    return mapped(rows, run, "doc long, n long, h1 long, h2 long, cell int, counts binary")


def _counted(cells: DataFrame) -> np.ndarray:
    """The sums of all partitions' counters; COUNTERS numbers reach the driver. Cells are summed as they stream by."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[cell] = total.get(cell, 0) + np.frombuffer(counts.as_buffer(), np.uint16).astype(np.uint64)
        for cell, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["cell", "counts"])

    n = min(64, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = mapped(cells.select("cell", "counts").repartition(n, "cell"), run, "cell int, counts binary").toArrow()
    out = np.zeros(COUNTERS)
    for cell, counts in zip(found["cell"].to_pylist(), found["counts"].to_pylist(), strict=True):
        out[cell * CELL : (cell + 1) * CELL] = np.frombuffer(counts, np.uint64)
    return out


def _prefix_length(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


def _passes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bit = mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(64 * len(bits) - 1)
    return ((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _parts(hot: tuple[np.ndarray, np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """In how many parts the regions of these counters are read. hot: the counters with more than one, and their numbers."""
    out = np.ones(len(bucket), np.uint64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], bucket), len(hot[0]) - 1)
        found = hot[0][at] == bucket
        out[found] = hot[1][at[found]]
    return out


def prefixes(rows: DataFrame, k: int, threshold: Fraction, levels, parts, wanted) -> DataFrame:
    """token, part, doc, n, pos for the prefix of every set that the filter lets through, in the global order (level of the
    token's counter, token). part: 0, or for tokens that seem hot one of several."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_passes(batch.column(0).to_numpy(), wanted.value)))
            ids = batch.column(0).to_numpy()
            for c in chunks(batch.column(1), lower=True):
                value, owner = shingles(c, k)
                if not len(value):
                    continue
                bucket = (value & np.uint64(COUNTERS - 1)).astype(np.int64)
                order = np.lexsort((value, levels.value[bucket], owner))
                value, owner, bucket = value[order], owner[order], bucket[order]
                size = np.bincount(owner, minlength=c.n)
                pos = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
                head = pos < _prefix_length(size, threshold)[owner]
                doc = ids[c.first + owner[head]]
                part = (mix(doc.astype(np.int64).view(np.uint64)) % _parts(parts.value, bucket[head])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(value[head].view(np.int64)), pa.array(part), pa.array(doc), pa.array(size[owner[head]].astype(np.int32)), pa.array(pos[head].astype(np.int32))], names=["token", "part", "doc", "n", "pos"])

    return mapped(rows, run, "token long, part int, doc long, n int, pos int")


def regions(posted: DataFrame, parts) -> DataFrame:
    """token, doc, n, pos and the region's first pivot (ldoc, ln, lpos), for tokens of at least two sets. split: whether the
    region is read in parts, whose first pivots differ.

    Rows come sorted by token, part, pos and doc, so the first of a token is its pivot; only that row and one batch are held."""
    names = ["token", "doc", "n", "pos", "ldoc", "ln", "lpos", "split"]

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches):
        last, pending = None, False  # the first row of the current (token, part), and whether it is still to be reported
        for batch in batches:
            token, part, doc, n, pos = (x.to_numpy() for x in batch.columns)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            if last is not None and len(token) and (token[0], part[0]) == last[:2]:
                new[0] = False
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            lead = [np.where(start >= 0, x[start], last[i] if last else 0) for i, x in ((2, doc), (3, n), (4, pos))]
            alone = new & np.append(new[1:], False)  # the batch's last row is settled by the next batch
            split = _parts(parts.value, (token.view(np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64)) > 1
            keep = ~alone | split
            if len(token) and new[-1] and not split[-1]:
                keep[-1] = False
            if pending and len(token) and not new[0]:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((last[0], *last[2:], *last[2:], False), kinds, strict=True)], names=names)
            if len(token):
                pending = bool(new[-1] and not split[-1])
                if new.any():
                    i = int(start[-1])
                    last = (int(token[i]), int(part[i]), int(doc[i]), int(n[i]), int(pos[i]))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip((token, doc, n, pos, *lead, split), kinds, strict=True)], names=names)

    return mapped(posted, run, "token long, doc long, n int, pos int, ldoc long, ln int, lpos int, split boolean")


def sets(rows: DataFrame, k: int, wanted) -> DataFrame:
    """doc, members (hashes) of the sets that the filter lets through."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_passes(batch.column(0).to_numpy(), wanted.value)))
            for c in chunks(batch.column(1), lower=True):
                value, owner = shingles(c, k)
                at = np.searchsorted(owner, np.arange(c.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.ListArray.from_arrays(pa.array(at), pa.array(value.view(np.int64)))], names=["doc", "members"])

    return mapped(rows, run, "doc long, members array<long>")


def _only(members: DataFrame, wanted) -> DataFrame:
    """The sets whose ids the filter lets through, so that only they are shuffled."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_passes(batch.column(0).to_numpy(), wanted.value)))

    return mapped(members, run, members.schema)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """The filter's bits for a table of ids; 2**20 numbers at most reach the driver, whatever the number of ids. Few ids take a
    small filter."""

    def run(batches):
        bits = np.zeros(FILTER >> 6, np.uint64)
        for batch in batches:
            bit = mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) & np.uint64(FILTER - 1)
            np.bitwise_or.at(bits, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["word", "bits"])

    found = mapped(ids, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER >> 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    while len(out) > 1024 and 8 * int(np.bitwise_count(out).sum()) < len(out):  # at most one set in 256 is shipped in vain
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def _possible(threshold: Fraction, n1, n2, pos1, pos2):
    """Whether sets of these sizes can link if the shingle at these places is the first in the order that they share.

    Every pair that links passes in the region of its first shared shingle, so the other regions needn't let it pass."""
    a, b = threshold.numerator, threshold.denominator
    return (F.least(n1, n2) * b >= F.greatest(n1, n2) * a) & (F.least(n1 - pos1, n2 - pos2) * (a + b) >= (n1 + n2) * a)


def measure(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """x, p, shared, together: the sizes of intersection and union for pairs of sets, as a scratch table."""
    context = pairs.sparkSession.sparkContext
    ps, xs = (context.broadcast(_id_filter(pairs.select(c))) for c in ("p", "x"))
    left = _only(members, ps).select(F.col("doc").alias("p"), F.col("members").alias("mp"))
    right = _only(members, xs).select(F.col("doc").alias("x"), F.col("members").alias("mx"))
    both = pairs.select("x", "p").join(left, "p").join(right, "x")
    shared = F.size(F.array_intersect("mx", "mp")).cast("long")
    out = scratch.table(both.select("x", "p", shared.alias("shared"), (F.size("mx") + F.size("mp") - shared).cast("long").alias("together")), "known")
    scratch.release(ps, xs)
    return out


def _pair(x: str, p: str) -> list:
    return [F.least(x, p).alias("x"), F.greatest(x, p).alias("p")]


def _regions(spark, rows: DataFrame, classes: DataFrame, k: int, threshold: Fraction, counts: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """The regions, and the scratch tables that they read."""
    levels = spark.sparkContext.broadcast(np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8))
    # What a counter holds beyond twice the usual is taken for one hot token.
    parts = np.maximum(1, np.ceil((counts - 2 * np.median(counts)) / PART)).astype(np.uint64)
    hot = np.flatnonzero(parts > 1)
    parts = spark.sparkContext.broadcast((hot, parts[hot]))
    wanted = spark.sparkContext.broadcast(_id_filter(classes.select("class")))
    posted = prefixes(rows, k, threshold, levels, parts, wanted)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.table(regions(posted.repartition(n, "token", "part").sortWithinPartitions("token", "part", "pos", "doc"), parts), "regions")
    scratch.release(levels, parts, wanted)
    scratch.sweep(spark)
    apart = found.where("split").drop("split")
    if apart.isEmpty():
        return found.drop("split"), [found]
    # Parts of a region agree on one first pivot; regions of one set are no longer of use.
    first = apart.groupBy("token").agg(F.min(F.struct("lpos", "ldoc", "ln")).alias("first"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    one = scratch.table(apart.drop("ldoc", "ln", "lpos").join(scratch.table(first, "first"), "token").select("token", "doc", "n", "pos", F.col("first.ldoc").alias("ldoc"), F.col("first.ln").alias("ln"), F.col("first.lpos").alias("lpos")), "regions")
    return found.where("not split").drop("split").unionByName(one), [found, one]


def _link(spark, rows: DataFrame, found: DataFrame, made: list[DataFrame], k: int, threshold: Fraction, extra: DataFrame) -> DataFrame:
    """node, label of all classes that link with others. found: the regions, from the tables made; extra: links (a, b) known
    beforehand."""
    a, b = threshold.numerator, threshold.denominator
    eps = 1 - a / b + 1e-9
    wanted = spark.sparkContext.broadcast(_id_filter(found.select("doc")))
    members = scratch.table(sets(rows, k, wanted), "sets")
    scratch.release(wanted)
    linked = lambda t: t.where(F.col("shared") * b >= F.col("together") * a).select(F.col("x").alias("a"), F.col("p").alias("b"))

    def absorb(links: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels after further links; those join components, so they may name the components' labels."""
        named = labels.withColumnRenamed("label", "l")
        up = links.join(named.select(F.col("node").alias("a"), F.col("l").alias("la")), "a", "left").join(named.select(F.col("node").alias("b"), F.col("l").alias("lb")), "b", "left")
        return components(up.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), labels)

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs that no component joins yet."""
        named = labels.withColumnRenamed("label", "l")
        with_both = pairs.join(named.select(F.col("node").alias("x"), F.col("l").alias("lx")), "x", "left").join(named.select(F.col("node").alias("p"), F.col("l").alias("lp")), "p", "left")
        return with_both.where(F.coalesce("lx", "x") != F.coalesce("lp", "p")).select("x", "p")

    # A set is first compared with the pivot with which it shares most regions, then with those that are still apart from it.
    met = scratch.table(found.where((F.col("doc") != F.col("ldoc")) & _possible(threshold, F.col("n"), F.col("ln"), F.col("pos"), F.col("lpos"))).groupBy("doc", "ldoc").agg(F.count("*").alias("rows")), "met")
    best = scratch.table(met.groupBy("doc").agg(F.max_by("ldoc", F.struct("rows", -F.col("ldoc"))).alias("ldoc")).select(*_pair("doc", "ldoc")).distinct(), "pairs")
    known = measure(best, members)
    scratch.sweep(spark)
    labels = components(linked(known).unionByName(extra))
    rest = scratch.table(apart(met.select(*_pair("doc", "ldoc")).distinct().join(known.select("x", "p"), ["x", "p"], "left_anti"), labels), "pairs")
    if not rest.isEmpty():
        new = measure(rest, members)
        labels = absorb(linked(new), labels)
        old, known = known, scratch.table(known.unionByName(new), "known")
        scratch.release(old, new)
    scratch.release(met, best, rest)
    scratch.sweep(spark)
    # A region's first pivot is linked with its members, apart from them, or in one component by now.
    left = scratch.table(found.where(F.col("doc") != F.col("ldoc")).select("token", "doc", "n", "pos", "ldoc"), "left")
    scratch.release(*made)
    for level in itertools.count():
        marked = left.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").select("token", "doc", "n", "pos", "ldoc", F.coalesce("label", "doc").alias("part"))
        marked = scratch.table(marked, "marked")
        mixed = scratch.table(marked.groupBy("token").agg(F.min("part").alias("u"), F.max("part").alias("v")).where("u < v").select("token"), "mixed")
        # d is a member's distance to the region's first pivot, where it was measured.
        to_first = known.select("x", "p", (1 - F.col("shared") / F.col("together")).alias("d")).groupBy("x", "p").agg(F.min("d").alias("d"))
        active = marked.join(mixed, "token").select("token", "doc", "n", "pos", "ldoc", "part", *_pair("doc", "ldoc"))
        active = scratch.table(active.join(to_first, ["x", "p"], "left").drop("x", "p"), "active")
        scratch.release(left, marked, mixed)
        if active.isEmpty():
            scratch.release(active, members, known)
            return labels
        parts = active.groupBy("token", "part").agg(F.count("*").alias("rows")).groupBy("token")
        main = scratch.table(parts.agg(F.max_by("part", F.struct("rows", "part")).alias("main"), F.sum("rows").alias("members"), (F.sum("rows") - F.max("rows")).alias("others")), "main")
        # Small regions are done at once, large ones a number of pivots at a time: a share of the members outside the main component, by
        # hash, so that no region is ranked in one task. The number doubles each time, so the rounds are few however large a region is.
        most = F.greatest(F.lit(PIVOTS << level), F.floor(F.lit(EXAMINED) / F.col("members")))
        share = F.ceil(F.col("others") / most)
        chosen = active.join(main, "token").where((F.col("part") != F.col("main")) & (F.pmod(F.xxhash64("doc", F.lit(level)), share) == 0))
        pivots = scratch.table(chosen.select("token", F.col("doc").alias("pivot"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("d").alias("pd"), F.col("part").alias("ppart")), "pivots")
        window = F.coalesce(F.abs(F.col("d") - F.col("pd")) <= eps, F.lit(True))
        both = active.join(pivots, "token").where((F.col("part") != F.col("ppart")) & (F.col("doc") != F.col("pivot")) & window & _possible(threshold, F.col("n"), F.col("pn"), F.col("pos"), F.col("ppos")))
        pairs = scratch.table(both.select(*_pair("doc", "pivot")).distinct().join(known.select("x", "p"), ["x", "p"], "left_anti"), "pairs")
        new = measure(pairs, members)
        old, known = known, scratch.table(known.unionByName(new), "known")
        labels = absorb(linked(new), labels)
        left = scratch.table(active.join(pivots.select("token", F.col("pivot").alias("doc")), ["token", "doc"], "left_anti").select("token", "doc", "n", "pos", "ldoc"), "left")
        scratch.release(main, pivots, pairs, new, old, active)
        scratch.sweep(spark)


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """key, n_shingles, component_id of every row; with exact components of the link graph."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    named = rows.where(F.col("doc").isNotNull())
    first = scratch.table(scan(rows, k), "shingles")
    docs = scratch.table(first.where(F.col("cell").isNull()).drop("cell", "counts"), "documents")
    full = docs.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = scratch.table(full.groupBy("h1", "h2", "n").agg(F.min("doc").alias("class")), "classes")
    counts = _counted(first.where(F.col("cell").isNotNull()))
    scratch.release(first)
    # Rows that share an id are one document, so their classes are linked.
    again = full.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc")
    extra = full.join(again, "doc").join(classes, ["h1", "h2", "n"]).select("doc", "class").distinct()
    extra = extra.select(F.col("class").alias("a"), F.col("doc").alias("b"))
    labels = _link(spark, named, *_regions(spark, named, classes, k, threshold, counts), k, threshold, extra)
    placed = scratch.table(classes.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select("h1", "h2", "n", F.coalesce("label", "class").alias("component")), "placed")
    scratch.release(classes, labels)
    out = docs.where(F.col("n") > 0).join(placed, ["h1", "h2", "n"], "left").select("doc", "n", F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))
    out = out.unionByName(docs.where(F.col("n") == 0).select("doc", "n", F.col("doc").alias("component")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
