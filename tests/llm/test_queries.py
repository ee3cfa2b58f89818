"""The registered queries over the small tables: against SQL, against brute force, or by accuracy on held-out rows."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from textloom.llm import bpe, quality, registry, scratch, toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def components(sets: dict, share: Fraction) -> dict:
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y > x and sets[x] and sets[y] and len(sets[x] & sets[y]) >= share * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: root(i) for i in ids}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def cut(texts: dict, w: int = 20) -> dict:
    """Per document the words, and which of them go."""
    seen, out = set(), {}
    for i in sorted(texts):
        ws = (texts[i] or "").encode().split()
        gone = [False] * len(ws)
        for j in range(len(ws) - w + 1):
            gram = tuple(ws[j : j + w])
            if gram in seen:
                gone[j : j + w] = [True] * w
            seen.add(gram)
        out[i] = (ws, gone)
    return out


def kept(ws, gone):
    return b" ".join(x for x, g in zip(ws, gone, strict=True) if not g)


def test_op7(spark, texts):
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = components(sets, Fraction(85, 100))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op7_jaccard"](spark, SMALL).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_op5(spark, texts):
    want = {i: (len(ws), sum(gone), hashlib.sha256(kept(ws, gone)).hexdigest()) for i, (ws, gone) in cut(texts).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.queries()["op5_substring"](spark, SMALL).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_op3(spark, texts):
    for r in registry.queries()["op3_quality"](spark, SMALL).collect():
        ws = (texts[r.doc_id] or "").encode().split()
        n = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {j for i in range(len(ws) - 7) if n[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (len(ws), len(hit), len(ws) < 20 or 100 * len(hit) > 30 * len(ws))
        assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in texts[r.doc_id] or ""), len(lines) - len(set(lines)))
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    clean = [r for r in registry.queries()["op3_quality"](spark, MEDIUM).collect() if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_op3_rejects_low_quality_rows(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    low = [r for r in registry.queries()["op3_quality"](spark, MEDIUM).collect() if quality.get(r.doc_id) == 0 and not r.base_failed]
    assert len(low) > 20 and sum(not r.kept for r in low) >= 0.9 * len(low)


def test_op3_rejects_texts_without_common_words(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").join(spark.read.parquet(f"{MEDIUM}/labels.parquet").where("quality = 1"), "doc_id")
    refs = quality.references(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    odd = docs.where("lang <> 'en'").withColumn("lang", F.lit("en"))
    rows = quality.rules(odd, refs).where("not base_failed and word_distance is not null").collect()
    assert len(rows) > 80 and sum(not r.kept for r in rows) >= 0.9 * len(rows)
    other = spark.createDataFrame([(1, " ".join(f"Wo{i} thing," for i in range(200)), "en")], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.rules(other, refs).collect()] == [False]


def test_op4(spark, texts):
    rows = registry.queries()["op4_sharding"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
    loads = Counter()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        loads[r.shard] += r.size
    assert set(loads) == set(range(16)) and max(loads.values()) < 1.05 * sum(loads.values()) / 16
    for s in loads:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op8(spark, texts):
    whole = bpe.codec(bpe.default_ranks(), bpe.default_pattern()).encoding
    for r in registry.queries()["op8_bpe"](spark, SMALL).collect():
        t = texts[r.doc_id] or ""
        ids = whole.encode_ordinary(t)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op9_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [r for r in registry.queries()["op9_toxicity"](spark, MEDIUM).collect() if r.doc_id in labels and r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    clean, bad = ([r for r in rows if labels[r.doc_id] == y] for y in (0, 1))
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean) and sum(r.predicted for r in bad) >= 0.7 * len(bad)


def test_op10_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in registry.queries()["op10_langid"](spark, MEDIUM).collect() if r.held_out]
    assert len(rows) > 150 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_pipeline_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "substring dedup", "mixing", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    before = {r.doc_id: r for r in docs.collect()}

    model, cache = toxicity.fit_on_labels(spark, docs, SMALL), {}
    docs = scratch.table(stages["toxicity"](spark, docs, SMALL), "t")
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == corpus_pipeline.COLUMNS and after == {i: r for i, r in before.items() if model.score(r.text, cache) < 0.7}

    docs = scratch.table(stages["near duplicates"](spark, docs, SMALL), "t")
    group = components({i: shingles(r.text, 5) for i, r in after.items()}, Fraction(4, 5))
    before, after = after, {r.doc_id: r for r in docs.collect()}
    assert docs.columns == corpus_pipeline.COLUMNS and after == {i: r for i, r in before.items() if group[i] == i}

    docs = scratch.table(stages["substring dedup"](spark, docs, SMALL), "t")
    want = {i: kept(*x) for i, x in cut({i: r.text for i, r in after.items()}).items()}
    before, after = after, {r.doc_id: r for r in docs.collect()}
    assert docs.columns == corpus_pipeline.COLUMNS and {i: b" ".join((r.text or "").encode().split()) for i, r in after.items()} == want
    assert all((r.lang, r.source) == (before[i].lang, before[i].source) and r.n_chars == len(r.text) for i, r in after.items())

    docs = scratch.table(stages["mixing"](spark, docs, SMALL), "t")
    mixed = docs.collect()
    words = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    taken, sizes = Counter(), Counter()
    for r in mixed:
        assert r == after[r.doc_id]
        taken[r.source] += words(r.text)
    for r in after.values():
        sizes[r.source] += words(r.text)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.2 * sum(sizes.values())

    out = stages["encoding"](spark, docs, SMALL).collect()
    whole = bpe.codec(bpe.default_ranks(), bpe.default_pattern()).encoding
    assert len(out) == len(mixed)
    for r in out:
        text = after[r.doc_id].text or ""
        assert r.ids == whole.encode_ordinary(text) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_on_awkward_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   ", "en", None, 3), (None, "no id here", None, "a", 10), (4, "same text " * 30, "en", "a", 300), (5, "same text " * 30, "de", "b", 300), (5, "same text " * 30, "de", "b", 300), (6, "x" * 90_000, "en", "b", 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for sub, df in (("rows", docs.withColumn("k", F.lit(1))), ("none", docs.where("false"))):
        df.write.parquet(str(tmp_path / sub / "documents.parquet"))
        spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / sub / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / sub)).collect()
        assert {r.doc_id for r in out} <= {1, 2, 3, None, 4, 6} and bool(out) == (sub == "rows")
