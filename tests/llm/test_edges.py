"""Every operator on awkward input: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyspark.sql.functions as F
import pytest

from textloom.llm import bpe, jaccard, langid, mixing, quality, sharding, substring, topk, toxicity, warc

LONG = "word " * 30_000 + "x" * 120_000 + " " * 3000 + "end"
A = " ".join(f"w{i}" for i in range(60))
B = " ".join(f"v{i}" for i in range(60))
ROWS = [
    (1, A, "en", "s1"), (2, A, "en", "s1"), (3, A + " tail", "en", None), (4, None, None, None), (5, "", "en", "s1"), (6, "   \n\t ", None, "s2"), (7, B + " " + A, "de", "s2"), (7, B + " " + A, "de", "s2"),
    (None, "no id " + B, "en", "s1"), (8, LONG, "en", "s2"), (9, "one two", "de", "s3"), (10, "One TWO", "de", "s3"), (11, "é ü 日本 " * 5, "ja", "s3"), (12, "a b " * 40, "en", "s1"), (-3, A.replace("w5 ", "x5 "), "en", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["doc", "th", "k", "key", "size", "n", "h", "rank", "score", "vslot", "label", "s", "s0", "copies", "words", "spans", "keep_0"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text):
    return (text or "").encode().split()


def test_jaccard(docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()), key=str)
    sets = []
    for i, t, *_ in ROWS:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, x in sets:
        for j, y in sets:
            if i is not None and j is not None and x and 100 * len(x & y) >= 85 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)
    assert jaccard.join(empty).count() == 0
    assert jaccard.join(docs.withColumn("text", F.lit(None).cast("string"))).where("n_shingles <> 0").count() == 0


def removed(rows, w):
    """Brute force: the words kept of each document, in the order of id and of the text's place in it."""
    seen, out = set(), []
    for key, text in rows:
        ws = words(text)
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            gram = tuple(ws[i : i + w])
            if gram in seen:
                gone[i : i + w] = [True] * w
            seen.add(gram)
        out.append((key, len(ws), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("w", "k"), [(20, 8), (5, 2)])
def test_substring(docs, empty, w, k):
    rows = sorted({(i, t) for i, t, *_ in ROWS}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = dict(zip(rows, removed(rows, w), strict=True))
    got = substring.dedup(docs, w=w, k=k, keep=["lang", "n"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want[i, t] for i, t, *_ in ROWS)
    assert all(hashlib.sha256(b" ".join(words(r.kept_text))).hexdigest() == r.kept_sha256 and r.n == "x" for r in got)
    assert all(r.kept_text is None for r in got if r.doc_id == 4)
    assert substring.dedup(empty).count() == 0


def test_hot_anchors_are_cut(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 3)
    monkeypatch.setattr(substring, "SHARD", 5)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i % 3} e{i % 3} f{i % 2} g{i % 2} h h h h h h h h h h h") for i in range(40)]
    got = {tuple(r)[:4] for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), w=16, k=8).collect()}
    assert got == set(removed(rows, 16))


def test_a_passage_of_many_texts_makes_no_large_group(spark, monkeypatch):
    """5000 texts that share 28 words between words of their own: what a task of the automata gets stays small."""
    seen = spark.sparkContext.accumulator(0)
    kernel = substring._shard_kernel

    def counted(w):
        inner = kernel(w)

        def run(table):
            if table.num_rows > 3000:
                seen.add(1)
            return inner(table)

        return run

    monkeypatch.setattr(substring, "_shard_kernel", counted)
    passage = " ".join(f"p{i}" for i in range(28))
    own = lambda i, k: " ".join(f"{k}{i}x{j}" for j in range(15))
    rows = [(i, f"{own(i, 'a')} {passage} {own(i, 'b')}") for i in range(5000)]
    rows += [(6000, rows[3][1])] * 40  # one document many times, and its text stands in another, so that all its runs are copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(sorted(set(rows)), 20)
    assert Counter(tuple(r)[:4] for r in substring.dedup(df).collect()) == Counter({x: 40 if x[0] == 6000 else 1 for x in want})
    assert seen.value == 0
    spans = substring.spans(substring._rows(df, "doc_id", "text", []).select("doc", "th", "text")).where("doc = 6000").collect()
    assert len(spans) == 1 and len(spans[0].spans) < 60


def test_bpe(docs, empty):
    ids = bpe.decode(bpe.encode(docs.select("doc_id", "text", "n"))).collect()
    assert all(bytes(r.raw) == (r.text or "").encode() and r.n == "x" for r in ids)
    whole = bpe.codec(bpe.default_ranks(), bpe.default_pattern()).encoding
    for r in bpe.digests(docs).collect():
        text = next(t or "" for i, t, *_ in ROWS if i == r.doc_id)
        assert r.n_tokens == len(whole.encode_ordinary(text)) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(empty).count() == 0


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 250_001, "x " * 120_000, ("\n" * 50 + "it's 12 a ") * 4000, "日" * 130_000 + " é"])
def test_long_texts_are_cut_safely(text):
    own = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    import regex

    want = [i for m in regex.finditer(own.pattern, text) for i in own.encoding._core_bpe.encode_single_piece(m[0].encode())]
    assert own.encode(text).tolist() == want and own.decode(own.encode(text)) == text.encode()


def test_sharding(docs, empty, spark):
    def place(df):
        records = df.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"), sharding.slot_of(slots=64).alias("vslot"))
        sums = sharding.slot_bytes(records)
        first = sharding.first_map(spark, 4, 64)
        edited = sharding.rebalance(first, sums, 4)
        return sharding.assign(records, edited, sums, ["doc_id", "size"]), first, edited

    placed, first, edited = place(docs)
    rows = placed.collect()
    assert len(rows) == len(ROWS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert edited.count() == 64 == edited.select("vslot").distinct().count()
    assert place(empty)[0].count() == 0


def test_rebalancing_like_a_plain_loop(spark):
    sizes = [(i * 7919) % 97 + (400 if i % 11 == 0 else 0) for i in range(64)]
    sums = spark.createDataFrame([(i, b, 1) for i, b in enumerate(sizes)], "vslot int, bytes long, n long")
    for shards in (4, 5):
        fair, loads, free, want = sum(sizes) / shards, [0] * shards, [], {}
        for s in range(4):
            upto = 0
            for i in sorted((i for i in range(64) if i % 4 == s), key=lambda i: (-sizes[i], i)):
                upto += sizes[i]
                if upto <= fair or not sizes[i]:
                    loads[s] += sizes[i]
                    want[i] = s
                else:
                    free.append(i)
        for i in sorted(free, key=lambda i: (-sizes[i], i)):
            want[i] = loads.index(min(loads))
            loads[want[i]] += sizes[i]
        got = {r.vslot: r.shard for r in sharding.rebalance(sharding.first_map(spark, 4, 64), sums, shards).collect()}
        assert got == want


def test_rebalancing_is_near_equal_and_moves_little(spark):
    sums = spark.range(512).select(F.col("id").cast("int").alias("vslot"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1 + F.when(F.col("id") % 16 == 0, 5000).otherwise(0)).alias("bytes"), F.lit(1).cast("long").alias("n"))
    first = sharding.first_map(spark, 16, 512)
    edited = sharding.rebalance(sharding.rebalance(first, sums, 16), sums, 16)
    loads = [r[0] for r in edited.join(sums, "vslot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(loads) == 16 and max(loads) - min(loads) < 0.02 * sum(loads) / 16
    moved = first.join(edited.withColumnRenamed("shard", "new"), "vslot").where("shard <> new").count()
    assert 0 < moved < 400
    grown = sharding.rebalance(edited, sums, 17)
    into = {r.new for r in edited.join(grown.withColumnRenamed("shard", "new"), "vslot").where("shard <> new").collect()}
    assert 16 in into


def test_maps_are_versioned(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.save_map(sharding.first_map(spark, 4, 16), path, 0)
    sharding.save_map(sharding.first_map(spark, 2, 16), path, 1)
    assert sharding.load_map(spark, path, 0).agg(F.max("shard")).collect()[0][0] == 3
    assert sharding.load_map(spark, path, 1).agg(F.max("shard")).collect()[0][0] == 1


def test_mixing(docs, empty):
    rows = mixing.mix(docs, mixing.count_words(F.col("text")), keep=["text", "n"]).collect()
    assert len(rows) == len(ROWS) and all(r.size == len(words(r.text)) and 0 <= r.copies <= 2 for r in rows)
    again = mixing.mix(docs.repartition(5), mixing.count_words(F.col("text"))).collect()
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    goals = {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in goals) == pytest.approx(1.5 * sum(s for s, _ in goals))
    assert mixing.mix(empty, mixing.count_words(F.col("text"))).count() == 0


def test_mixing_comes_near_its_targets(spark):
    sizes = [(i, f"s{i % 3}", (i * 7919) % 300 + 1) for i in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, w long")
    got = mixing.mix(df, F.col("w"), keep=["source"]).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("t")).collect()
    assert all(abs(r.taken - r.t) < 600 for r in got)


def test_quality(docs, empty):
    refs = quality.references(docs)
    for r in quality.rules(docs, refs).collect():
        text = next(t or "" for i, t, *_ in ROWS if i == r.doc_id)
        ws = text.encode().split()
        starts = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {j for i in range(len(ws) - 7) if starts[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(len(w.decode()) for w in ws), len(lines) - len(set(lines)), len(hit), failed)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and not (failed and r.kept)
    assert quality.rules(empty, refs).count() == 0 and quality.rules(docs, quality.references(empty)).count() == len(ROWS)


def test_divergence_rejects_other_text(spark):
    import random

    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "to", "in", "wordy", "thing", "other"]) + rng.choice(["", "", "", ".", ","]) for _ in range(150))
    noise = lambda: " ".join(rng.choice("0123456789#$%") * rng.randrange(3, 9) + str(rng.random()) for _ in range(150))
    rows = [(i, prose() if i % 20 else noise(), "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.rules(df, quality.references(df)).where("not kept").collect()} == {i for i in range(0, 200, 20)}


def test_distance_like_the_definition():
    import math

    import numpy as np

    def divergence(p, q):
        return sum(a * math.log2(a / b) for a, b in zip(p, q, strict=True) if a)

    rng = np.random.default_rng(5)
    for _ in range(50):
        p, q = (x / x.sum() for x in rng.integers(0, 4, (2, 6)) + np.eye(6)[rng.integers(0, 6, 2)])
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        assert quality.distance(p, q) == pytest.approx(math.sqrt(max(0, (divergence(p, m) + divergence(q, m)) / 2)), abs=1e-9)
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and quality.distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGES", 3)
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    df = spark.createDataFrame([(i, "many words " * 300, f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    for fit in (quality.references, langid.fit):
        with pytest.raises(ValueError, match="languages"):
            fit(df)


def test_common_words_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 50)
    monkeypatch.setattr(quality, "LEAST_REFERENCE", 1)
    rows = [(i, " ".join(f"w{min(j, (i * j) % 7)}" for j in range(30)), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    counts = Counter(w for _, t, _ in rows for w in t.encode().split())
    refs = quality.references(df, phi=0.1)
    assert set(refs.index[0]) == {w for w, n in counts.items() if n >= 0.1 * counts.total()}


def test_langid(docs, empty):
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "ja"]
    got = langid.predict(docs, model).collect()
    assert len(got) == len(ROWS) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (4, 5, 6))
    assert all(0 <= r.score <= 1 for r in got) and all(r.lang_pred == "ja" for r in got if r.doc_id == 11)
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_margins_and_decoding_like_plain_loops(spark, docs, monkeypatch):
    import math

    monkeypatch.setattr(langid, "STEP", 1000)  # long texts are looked up in parts
    model = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.predict(docs, model).where("lang_pred <> 'und'").collect()}
    want = set()
    for i, t, *_ in ROWS:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        if not any(c.isalpha() for c in t or ""):
            continue
        sums = [0.0] * len(model.loss)
        for f in langid._features(raw).tolist():
            sums = [a + float(b) for a, b in zip(sums, model.weights[f], strict=True)]
        margins = [max(-4, min(4, x / max(len(raw) - 2, 1))) for x in sums]
        cost = [sum(w * math.log1p(math.exp(-4 * m * c)) for m, c, w in zip(margins, word, model.loss, strict=True)) for word in model.code.tolist()]
        share = [math.exp(min(cost) - c) for c in cost]
        want.add((i, model.langs[cost.index(min(cost))], round(1 / sum(share), 6)))
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert all(min(abs(s - v) for a, b, v in want if (a, b) == (i, n)) < 1e-4 for i, n, s in got)


def test_codewords_differ():
    for n in (2, 3, 4, 9, 40):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (3 if n > 2 else 1)
        assert all(abs(bit.sum()) < n for bit in code.T)


def test_toxicity(spark, docs, empty):
    rows = [(i, f"fine text number {i} about things" + (" you idiotic fool" if i % 3 == 0 else "")) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(labels, df)
    texts = [(1, "an 1d10t1c thing"), (2, "id-i-o-t-i-c"), (3, "so i d i o t i c"), (4, "iiidioootic!!"), (5, "fine things 1 2 3"), (6, None), (7, "")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert all(got[i] >= 0.7 for i in (1, 2, 3, 4)) and got[5] < 0.7 and got[6] == got[7] == 0
    assert toxicity.reject(docs, model).count() == len(ROWS) and toxicity.reject(empty, model).count() == 0
    none = toxicity.fit(labels.where("false"), df)
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_decoding_finds_the_cheapest_reading():
    import itertools
    import math

    import numpy as np

    model = toxicity.CharacterModel(np.random.default_rng(3).integers(0, 50, toxicity.SIZE**3))
    code = lambda c: toxicity._LETTERS.index(c) + 1 if c in toxicity._LETTERS else toxicity._OTHER

    def price(ways):
        read, total = "".join(x for x, _ in ways), sum(p for _, p in ways)
        at = [0, 0, *map(code, read), 0]
        return total + sum(model.cost[a][b][c] for a, b, c in zip(at, at[1:], at[2:], strict=False)), read

    for token in ("1d10t", "l00ser", "a.b.c", "sstuuupid", "m0r0n!", "*a*", "x", "", "é1é", "b@d$"):
        every = [price(ways) for ways in itertools.product(*toxicity.lattice(token))]
        got = toxicity.decode(token, model)
        assert got in {read for total, read in every if math.isclose(total, min(every)[0])}, token


def test_letters_beyond_ascii_count_once(spark):
    counts = {r.bucket: r.n for r in toxicity.count_characters(spark.createDataFrame([("é",), ("aé",)], "text string").coalesce(1)).collect()}
    other = toxicity._OTHER
    assert sum(counts.values()) == 3 and all((b // toxicity.SIZE**2, b // toxicity.SIZE % toxicity.SIZE, b % toxicity.SIZE).count(other) <= 2 for b in counts)


def test_toxicity_in_long_tokens(spark):
    rows = [(i, f"fine text number {i} about things" + (" you idiotic fool" if i % 3 == 0 else "")) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")), df)
    for n in range(30, 60):
        filler = ("fine_text.about_" * 5)[:n]
        assert model.score(f"{filler}.1d10t1c.{filler}", {}) >= 0.7 > model.score(f"{filler}.things.{filler}", {}), n


def crc(i):
    return zlib.crc32(str(i).encode())


def test_held_out(docs):
    for r in docs.select("doc_id", langid.held_out().alias("l"), toxicity.held_out().alias("t")).collect():
        assert (r.l, r.t) == ((False, False) if r.doc_id is None else (crc(r.doc_id) % 5 == 0, crc(r.doc_id) % 3 == 1))


NAN, INF = float("nan"), float("inf")
VECTORS = [(0, [0.5, -0.25, 1.0, 2.0]), (100, [0.5, -0.25, 1.0, 2.0]), (1, [0.5, -0.25, 1.0, 2.0]), (2, [0.0] * 4), (3, None), (4, [1.0, None, 0.0, 0.0]), (5, [NAN, 0.0, 0.0, 0.0]), (6, [INF, 0.0, 0.0, 0.0]), (7, []), (8, [1.0, 2.0]), (9, [-1.0] * 4), (9, [-1.0] * 4), (None, [1.0] * 4), (200, [3e38, 3e38, -3e38, 1.0]), (10, [3e38, 1.0, 1.0, 1.0])]


def test_topk(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).repartition(3)
    got = topk.search(df.select("*", *(F.lit("x").alias(c) for c in ("id", "v", "q", "total"))), F.pmod(F.col("vec_id"), F.lit(100)) == 0, k=3)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(rows) == [0, 100, 200]
    assert [x[:2] for x in sorted(rows[0])][1:] == [(2, 1), (3, 100)] and sorted(rows[0])[0][1] in (10, 200)
    floors = {i: [int(np.floor(np.float32(x).astype(float) * 1024)) for x in v] for i, v in VECTORS if v and len(v) == 4 and i not in (4, 5, 6)}
    clipped = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(floors[a], floors[b], strict=True))))
    assert all(score == clipped(q, i) for q, top in rows.items() for _, i, score in top)
    assert topk.search(df.where("false"), F.lit(True)).count() == 0


def test_topk_like_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    w = np.floor(v.astype(float) * 1024).astype(np.int64)
    for block in (2048, 7):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=5, block=block).collect()}
        for q in range(0, 400, 20):
            s = w @ w[q]
            best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
            assert [got[q, r + 1] for r in range(5)] == [(i, s[i]) for i in best]


def test_topk_of_large_components(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1e5, 3e5, 1e6):  # sums of about 2**58, up to 2**62 and beyond the limits of a long
        v = [[float(x) for x in row] for row in np.floor(rng.normal(size=(120, 12)) * size)] + [[1.0] * 12, [-size] * 12, [size] * 12]
        df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").repartition(3)
        w = [[int(x) * 1024 for x in row] for row in v]
        score = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(w[a], w[b], strict=True))))  # noqa: B023, E731
        for k in (5, 122):
            got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=k).collect()}
            for q in range(0, 123, 20):
                best = sorted((i for i in range(123) if i != q), key=lambda i: (-score(i, q), i))[:k]
                assert [got[q, r + 1] for r in range(k)] == [(i, score(i, q)) for i in best]


PAGES = [(1, "http://a/\r\nb", "x" * 1500), (2, "u", "x" * 1500), (3, None, "é" * 900), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "y" * 50_000), (None, "u", "x" * 1500), (9, "u", "é" * 900), (9, "u", "é" * 900)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("path", F.lit("x")).repartition(2)
    for dictionary in (b"", warc.train_dictionary(spark.createDataFrame([(f"<p>{'common words ' * 20}{i}</p>",) for i in range(200)], "html string"))):
        got = warc.read(warc.write(warc.plan(df), dictionary, archive_bytes=500)).collect()
        assert len(got) == len(PAGES)
        by = {(r.page_id, r.payload_digest): r for r in got}
        for i, _, html in PAGES:
            raw = (html or "").encode()
            r = by[i, hashlib.sha1(raw).hexdigest()]
            same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None and len(raw) >= 1000]
            want = max(same) if same and max(same) != i else None
            assert (r.payload_bytes, r.refers_to, r.record_type) == (len(raw), want, "revisit" if want else "response")
            assert (r.payload is None) == (want is not None) and (r.payload is None or bytes(r.payload) == raw)
    assert warc.read(warc.write(warc.plan(df.where("false")), b"")).count() == 0


def test_warc_is_validated(spark):
    import zstandard

    dictionary = zstandard.train_dictionary(4096, [b"WARC/1.1 some sample text %d" % i * 5 for i in range(300)]).as_bytes()
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    head = warc.dictionary_frame(dictionary)
    assert warc.load_dictionary(memoryview(head))[0] == dictionary
    plain = warc.struct.pack("<II", warc.WARC_DICTIONARY_MAGIC, len(dictionary)) + dictionary
    other = warc.struct.pack("<II", 0x184D2A50, 3) + b"abc"
    for content in (head + z.compress(good), plain + z.compress(good) + other + z.compress(good), zstandard.compress(good)):
        assert all(raw == good for _, raw in warc.frames(content))
    stream = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compress(good)
    assert [raw for _, raw in warc.frames(stream)] == [good]
    cut = head + z.compress(good)
    broken = [cut[:-3], cut[:10], head + b"junk", good, head + z.compress(good)[:7], warc.struct.pack("<II", warc.WARC_DICTIONARY_MAGIC, 12) + b"no dictionary"]
    for content in broken:
        with pytest.raises(warc.WarcError):
            list(warc.frames(content))
    for raw in (good.replace(b"Content-Length: ", b"Content-Length: 9", 1), good[:-2], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"Other"), b"nothing"):
        with pytest.raises(warc.WarcError):
            warc.http_payload(warc.parse(raw)) and warc.parse(raw)
    with pytest.raises(warc.WarcError):
        warc.http_payload(warc.parse(good.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")))


def foreign(kind: str, block: bytes, *headers: str, record_id: str = "<urn:uuid:0dc3ff4e-9f37-4f1f-8cd2-5d1c7f9d1f00>") -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2020-02-02T02:02:02Z", f"Content-Length: {len(block)}", *headers]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_of_other_makers(spark, tmp_path):
    import zstandard

    http = "Content-Type: application/http; msgtype=response"
    body = b"hello"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\n\r\n" + body
    sha1 = lambda x: warc.base64.b32encode(hashlib.sha1(x).digest()).decode()
    records = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"),
        foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n" + body, http, "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{sha1(body)}"),
        foreign("response", plain, http, f"WARC-Payload-Digest: sha-256:{hashlib.sha256(body).hexdigest()}", f"WARC-Block-Digest: sha1:{sha1(plain)}"),
        foreign("response", chunked, http, f"WARC-Payload-Digest: sha1:{sha1(body)}"),
        foreign("response", b"10 IN A 1.2.3.4", "Content-Type: text/dns", "WARC-Target-URI: dns:a"),
        foreign("metadata", b"via: x", "Content-Type:", "\tapplication/warc-fields"),
        foreign("revisit", b"", "WARC-Refers-To: <urn:uuid:x>"),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, f"WARC-Payload-Digest: sha1:{sha1(body)}"),
        foreign("resource", b"", record_id="<urn:page:12>"),
    ]
    rows = spark.createDataFrame([("other.warc.zst", bytearray(b"".join(map(zstandard.compress, records)))), ("none.warc.zst", bytearray()), ("null.warc.zst", None)], "path string, content binary")
    assert {r.path: r.bytes for r in warc.save(rows, f"file://{tmp_path}/archives").collect()} == {"other.warc.zst": sum(len(zstandard.compress(r)) for r in records), "none.warc.zst": 0}
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/archives")
    got = warc.read(files).orderBy("offset").collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "response", "response", "metadata", "revisit", "revisit", "resource"]
    assert [r.payload_bytes for r in got] == [13, 0, 5, 5, len(chunked) - 47, 15, 6, None, None, 0]
    assert got[8].payload_digest == hashlib.sha1(body).hexdigest() and got[7].payload_digest is None and got[7].refers_to_id == "<urn:uuid:x>" and got[7].refers_to is None
    assert [r.page_id for r in got] == [None] * 9 + [12] and all(r.problem is None for r in got)

    http_head = b"HTTP/1.1 200 OK\r\nContent-Length: 6\r\n\r\n"
    for raw, what in (
        (foreign("response", http_head + body, http), "5 bytes, not 6"),
        (foreign("response", b"HTTP/1.1 200 OK", http), "no HTTP headers"),
        (foreign("response", body, f"WARC-Payload-Digest: sha1:{sha1(b'other')}"), "its digest"),
        (foreign("response", body, "WARC-Block-Digest: md5:" + "0" * 32), "its digest"),
        (foreign("response", body, "WARC-Payload-Digest: sha1:!!"), "malformed"),
        (foreign("resource", body, "WARC-Date: again"), "repeated"),
    ):
        damaged = spark.createDataFrame([("d", bytearray(zstandard.compress(records[0]) + zstandard.compress(raw) + zstandard.compress(records[5]) + b"junk!"))], "path string, content binary")
        told = warc.read(damaged, strict=False).orderBy("offset").collect()
        assert [r.problem is None for r in told] == [True, False, True, False]
        assert what in told[1].problem and told[1].path == "d" and told[1].offset > 0
        with pytest.raises(Exception, match=f"d, at {told[1].offset}: "):
            warc.read(damaged).collect()


def test_five_words_and_other_thresholds(spark):
    rows = [(i, " ".join(f"w{j}" if j != i * 5 else "zz" for j in range(100))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.join(df, k=5, threshold=Fraction(4, 5)).collect()} == {0}
    assert len({r.component_id for r in jaccard.join(df, k=5, threshold=Fraction(19, 20)).collect()}) == 12


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from textloom.llm import scratch

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(session)


def test_slices_are_small_and_whole():
    import pyarrow as pa

    from textloom.llm import workers

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * (i % 50) for i in range(999)] + ["y" * 100_000]), pa.array([[i] * (i % 7) for i in range(1000)])], names=["a", "b", "c"])
    parts = list(workers.slices(batch, 5000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or p.nbytes <= 5000 for p in parts) and len(parts) > 10
    assert [p.num_rows for p in workers.slices(batch.slice(0, 0), 10)] == [0]
