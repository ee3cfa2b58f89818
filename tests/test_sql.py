"""The functions as SQL sees them."""

from textloom.functions import hashing, sql


def test_sql_functions(spark):
    assert "byte_find" in sql.register(spark)
    spark.createDataFrame([("naïve café", "é"), ("aaaa", "aa"), ("", ""), (None, "x")], "s string, n string").createOrReplaceTempView("t")
    rows = spark.sql("SELECT s, n, byte_find(s, n) f, byte_rfind(s, n) r, byte_count(s, n) c, byte_sum(s) b, utf8_seek(s, 3) k, byte_levenshtein(s, n) l, utf8_fold(s) u, utf8_nfd(s) d, hash64(s) h FROM t").collect()
    for r in rows:
        if r.s is None:
            assert tuple(r)[2:] == (None,) * 9
            continue
        s, n = r.s.encode(), r.n.encode()
        assert (r.f, r.r, r.c, r.b) == (s.find(n), s.rfind(n), s.count(n), sum(s))
        assert r.k == (len(r.s[:3].encode()) if len(r.s) >= 3 else None) and r.u == r.s.casefold()
        assert r.h == int(hashing.hash_many([s]).view("int64")[0])


def test_segments_as_rows(spark):
    sql.register(spark)
    rows = spark.sql("SELECT pos, segment FROM VALUES ('Hi, you. Yes'), ('') AS v(s), LATERAL text_segments(s, 'sentences') ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [(0, "Hi, you. "), (1, "Yes")]
