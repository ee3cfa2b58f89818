"""Operators on tables: collections, similarity, fingerprints, ciphers, Unicode columns, streams, and the catalogue."""

import unicodedata

import duckdb
import pyspark.sql.functions as F
import pytest

from textloom.functions import cipher, hashing, unicode
from textloom.functions.kernels import Costs
from textloom.operators import collection, fingerprints, similarity
from textloom.plans import catalogue
from textloom.sources import collections as sources
from textloom.streaming import digests

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words(spark):
    texts = ["b", "a", "B", "a", "é", "", "Z", "z", "ab", None]
    return sources.from_values(spark, texts), texts


def test_sorting_is_stable(words):
    df, texts = words
    for reverse in (False, True):
        order = [r.idx for r in collection.argsort(df.where("s is not null"), reverse=reverse).orderBy("position").collect()]
        assert order == sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: texts[i].encode(), reverse=reverse)[:: 1] or reverse
    got = [r.idx for r in collection.sort(df.where("s = 'a' or s = 'b'"), reverse=True).collect()]
    assert got == [0, 1, 3]
    folded = [r.s for r in collection.sort(df.where("s is not null"), uncased=True, top=4).collect()]
    assert folded == ["", "a", "a", "ab"]


def test_positions_are_dense(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), F.xxhash64("id").alias("h")).repartition(7)
    got = collection.with_positions(df, F.col("h"))
    assert [r.position for r in got.orderBy("h").collect()] == list(range(1000))
    assert collection.with_positions(df.where("false"), F.col("h")).count() == 0


def test_slices_and_samples(spark):
    df = spark.range(50).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("s"))
    for s in ((None, None, None), (5, 40, 3), (40, 5, -4), (-10, None, 2), (None, None, -1)):
        assert [r.idx for r in collection.rows(df, *s).orderBy("place").collect()] == list(range(50))[slice(*s)]
    assert collection.sample(df, 120, 1).count() == 120 and collection.sample(df.limit(0), 5).count() == 0
    a, b = ([r.idx for r in collection.shuffled(df.repartition(n), 5).collect()] for n in (1, 6))
    assert a == b != list(range(50)) and sorted(a) == list(range(50))


def test_intersect_and_joins(spark):
    a, b = sources.from_values(spark, ["x", "y", "x", "z", None]), sources.from_values(spark, ["z", "x", "q", "x", None])
    assert sorted((r.ours, r.theirs) for r in collection.intersect(a, b).collect()) == [(0, 1), (3, 0)]
    for how, n in (("inner", 5), ("left", 7), ("right", 7), ("full", 9), ("cross", 25)):
        assert collection.join_strings(a, b, how).count() == n, how
    with pytest.raises(ValueError):
        collection.join_strings(a, b, "inner_strict")
    with pytest.raises(ValueError):
        collection.join_strings(a, b, "sideways")
    assert collection.equal(a, a) and not collection.equal(a, b)
    assert collection.compare(a, b) == -1 and collection.compare(b, a) == 1 and collection.compare(a, a) == 0


def test_similarity_columns(spark):
    df = spark.createDataFrame([("αβγδ", "αγδ"), ("", "ab"), ("kitten", "sitting"), (None, "x")], "a string, b string").coalesce(1)
    rows = df.select(similarity.levenshtein_bytes("a", "b"), similarity.levenshtein_utf8("a", "b"), similarity.levenshtein_utf8("a", "b", Costs(0, 2, 2, 2)), similarity.levenshtein_bytes("a", "b", Costs(0, 1, 1, 0))).collect()
    assert [tuple(r) for r in rows] == [(2, 1, 2, 1), (2, 2, 4, 1), (3, 3, 6, 2), (None, None, None, None)]  # with free extension, two gaps of cost 1 replace everything


def test_cross_scores_mirror(spark):
    df = sources.from_values(spark, ["abc", "abd", "", "xyz"])
    full = {(r.qi, r.ci): r.score for r in similarity.cross_scores(df, df, similarity.levenshtein_utf8).collect()}
    half = {(r.qi, r.ci): r.score for r in similarity.cross_scores(df, None, similarity.levenshtein_utf8).collect()}
    assert full == half and len(full) == 16
    near = {(r.qi, r.ci) for r in similarity.cross_scores(df, None, similarity.levenshtein_utf8, at_most=1).collect()}
    assert near == {k for k, v in full.items() if v <= 1}


def test_fingerprints_merge(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello there"), (2, "")], "k int, s string")
    parts = df.select("k", fingerprints.fingerprints("s", 8).alias("f")).select("k", "f.hashes", "f.counts")
    for r in fingerprints.merge(parts, "k").collect():
        own = [(p.hashes, p.counts) for p in parts.where(F.col("k") == r.k).collect()]
        for d in range(8):
            least = min(h[d] for h, _ in own)
            assert (r.hashes[d], r.counts[d]) == (least, sum(c[d] for h, c in own if h[d] == least))


def test_ciphers(spark):
    key, nonce = bytes(range(32)), bytes(12)
    df = spark.createDataFrame([("secret text",), ("",)], "s string").select("s", cipher.gcm_encrypt("s", key, nonce, b"ad").alias("e"))
    out = df.select("s", cipher.gcm_decrypt("e.text", "e.tag", key, nonce, b"ad").cast("string").alias("d"), cipher.try_gcm_decrypt("e.text", "e.tag", key, nonce, b"no").alias("f"), F.length("e.tag").alias("n"), cipher.ctr_xor(cipher.ctr_xor("s", key, nonce, 3), key, nonce, 3).cast("string").alias("c")).collect()
    assert all(r.s == r.d == r.c and r.f is None and r.n == 16 for r in out)


def test_unicode_columns(spark):
    texts = ["", "Straße", "é", "ﬁ Ⅷ", "👩‍👧 x", "İ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    columns = [unicode.fold("s"), *(unicode.norm("s", f) for f in unicode.FORMS), unicode.codepoints("s"), unicode.seek("s", 1), unicode.count_codepoints("s"), unicode.uncased_search_bytes("s", "x"), unicode.spans(unicode.wordbreaks("s"))]
    for t, r in zip(texts, df.select("i", *columns).orderBy("i").collect(), strict=True):
        r = tuple(r)[1:]
        assert r[0] == t.casefold() and r[1:5] == tuple(unicodedata.normalize(f, t) for f in unicode.FORMS)
        assert r[5] == [ord(c) for c in t] and r[6] == (len(t[:1].encode()) if t else None) and r[7] == len(t)
        assert r[8] == t.casefold().encode().find(b"x")
        assert "".join(s.text for s in r[9]) == t and [s.offset for s in r[9]] == [sum(x.length for x in r[9][:i]) for i in range(len(r[9]))]


def test_lower_of_upper_is_no_fold(spark):
    df = spark.createDataFrame([("ſtraße",)], "s string")
    assert df.select(unicode.fold("s")).collect()[0][0] == "strasse"


def test_files_and_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert sorted(r.s for r in sources.read_lines(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert sources.read_text(spark, str(tmp_path)).collect()[0].s == "one\ntwo\n"
    assert bytes(sources.read_file(spark, str(tmp_path)).collect()[0].content) == b"one\ntwo\n"
    df = sources.from_values(spark, [b"\xff\x00", b"abc"])
    sources.write_bytes(df, str(tmp_path / "out"))
    assert sorted(bytes(r.s) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [b"abc", b"\xff\x00"]
    assert tuple(sources.layout(df).collect()[0]) == (5, 3, False)
    with pytest.raises(ValueError):
        sources.write_texts(df, "a\0b")


def test_running_hash_of_a_stream(spark, tmp_path):
    chunks = [("a", 0, "hello "), ("b", 0, "x" * 100), ("a", 1, "wor"), ("a", 2, "ld" * 50), ("b", 1, "y")]
    for i, c in enumerate(chunks):
        spark.createDataFrame([c], "k string, seq long, c string").write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("k string, seq long, c string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = digests.running_hash(stream, "k", "c", 9).writeStream.format("memory").queryName("hashes").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.k: (r.length, r.hash) for r in spark.table("hashes").orderBy("length").collect()}
    for k in "ab":
        text = "".join(c for key, _, c in sorted(chunks) if key == k).encode()
        assert last[k] == (len(text), int(hashing.hash_many([text], 9).view("int64")[0])), k


def test_predicates_reach_the_reader(spark):
    plan = catalogue.queries()["contains_docs"](spark, DATA)._jdf.queryExecution().toString()
    assert "StringContains(text,tion)" in plan


def test_open_slice_covers_the_table(spark):
    medium = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{medium}/documents.parquet").count()
    got = {r.place: r.doc_id for r in catalogue.queries()["slice_rows_open"](spark, medium).collect()}
    assert n > 500 and got == dict(enumerate(range(10, n, 7)))


def test_every_part_has_a_scored_name(spark):
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    least = {}
    for k, name in sorted(parts.items()):
        least.setdefault(name, k)
    assert {r.p_partkey: r.idx for r in catalogue.queries()["part_names"](spark, DATA).collect()} == {k: least[name] for k, name in parts.items()}


def test_fingerprints_of_different_texts(spark):
    from textloom.functions.kernels import dimensions, fingerprint

    dims = dimensions(32, None, 0)
    own = {r.item_id: list(fingerprint(r.text.encode(), dims)[0]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {r.item_id: r.same for r in catalogue.queries()["fingerprint_pairs"](spark, DATA).collect()}
    assert got == {i: sum(a == b for a, b in zip(h, own[i + 1], strict=True)) / 32 for i, h in own.items() if i + 1 in own} and min(got.values()) < 1


def test_candidates_have_no_pairs_of_equal_sketches(spark):
    df = spark.createDataFrame([(i, [1, 2, 3, 4]) for i in range(50)] + [(60, [1, 2, 9, 9]), (61, [8, 8, 8, 8])], "id long, hashes array<long>")
    assert [tuple(r) for r in fingerprints.candidates(df, "id", bands=2).collect()] == [(0, 60)]
    assert {r["class"] for r in fingerprints.classes(df, "id").where("id < 50").collect()} == {0}


def test_one_raw_file(spark, tmp_path):
    path = f"file://{tmp_path}/x.bin"
    sources.write_file(spark.createDataFrame([(bytearray(b"\xff\n\x00a"),)], "x binary"), path)
    assert (tmp_path / "x.bin").read_bytes() == b"\xff\n\x00a"
    with pytest.raises(ValueError):
        sources.write_file(spark.range(2).select(F.lit("a").alias("x")), path)
    with pytest.raises(ValueError):
        sources.write_file(spark.range(1), "a\0b")


def test_native_paths_equal_the_kernels(spark):
    texts = ["", "Plain ASCII text", "ÉTÉ Straße", "x" * 300 + "Ti", "tI\u0130", None, "\u212aelvin"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    make = lambda: [unicode.fold("s"), *(unicode.norm("s", f) for f in unicode.FORMS), unicode.is_norm("s", "NFD"), unicode.find_denormalized("s", "NFD"), unicode.uncased_search("s", "tI"), unicode.uncased_search("s", "ss"), unicode.uncased_search_bytes("s", "K"), unicode.uncased_contains("s", "TI")]
    native = [tuple(r) for r in df.select(*make()).collect()]
    with unicode.kernels_only():
        assert [tuple(r) for r in df.select(*make()).collect()] == native
    assert [r[0] for r in native] == [None if t is None else t.casefold() for t in texts]


def test_catalogue_matches_sql(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders documents pages benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql = catalogue.oracle_sql()
    for name, query in catalogue.queries().items():
        df = query(spark, DATA)
        columns = sorted(df.columns)
        got = df.select(*columns).collect()
        if name in sql:
            want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql[name]})").fetchall()
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str), name
        else:
            assert got, name


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from textloom.sources import shared

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared.folder(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context))
