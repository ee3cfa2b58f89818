"""Named queries over the standard tables, one or more for each operator, with equivalent SQL where SQL has one.

Arrays are shown joined, so both sides compare plain values. Every query runs over its whole tables.
Pair scores of parts are between distinct names, each under its smallest key; ``part_names`` says which part has which.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import cipher, hashing, search, split, transform, unicode
from ..functions.kernels import Classes, Costs
from ..operators import collection, fingerprints, similarity, sketches
from ..sources import collections as sources
from ..sources.shared import new_folder
from ..streaming import digests
from . import cases, oracles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def simple(name: str, table: str, key: str, sql: str | None = None, where=None, spread: bool = False, **columns) -> None:
    """Registers a query that computes columns of a table beside its key. where, columns: functions without arguments. spread: for
    heavy columns, whether a table that is read by fewer tasks than there are cores is dealt out first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        if spread:
            df = sources.spread(df)
        if where is not None:
            df = df.where(where())
        return df.select(key, *(f().alias(c) for c, f in columns.items()))

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(parts, sep: str = "|"):
    return F.concat_ws(sep, parts)


def _numbers(parts):
    return F.concat_ws(",", F.transform(parts, lambda x: x.cast("string")))


def _size(parts):
    return F.size(parts).cast("long")


@query("SELECT doc_id, (strlen(text) - strlen(replace(text, 'the', ''))) // 3 AS n, strlen(split_part(text, 'the', 1)) AS first_byte FROM documents WHERE contains(text, 'the') ORDER BY n DESC, doc_id LIMIT 10")
def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where(search.contains("text", "the"))
    hits = docs.select("doc_id", search.count("text", "the").alias("n"), F.octet_length(F.substring_index("text", "the", 1)).cast("long").alias("first_byte"))
    return hits.orderBy(F.desc("n"), "doc_id").limit(10)


# Predicates and comparisons

simple("contains_docs", "documents", "doc_id", "SELECT doc_id, lang FROM documents WHERE contains(text, 'tion')", where=lambda: search.contains("text", "tion"), lang=lambda: F.col("lang"))
simple("contains_window", "pages", "page_id", "SELECT page_id, contains(substr(url, 9, 12), 'a') AS hit, starts_with(substr(url, 9), 'e') AS head, ends_with(left(url, length(url) - 2), '1') AS tail FROM pages", hit=lambda: search.contains("url", "a", 8, 20), head=lambda: search.startswith("url", "e", 8), tail=lambda: search.endswith("url", "1", 0, -2))
simple("prefix_suffix_filter", "documents", "doc_id", "SELECT doc_id, source FROM documents WHERE starts_with(text, 'The') AND ends_with(text, '.')", where=lambda: search.startswith("text", "The") & search.endswith("text", "."), source=lambda: F.col("source"))
simple("compare_texts", "customer", "c_custkey", "SELECT c_custkey, c_name = c_mktsegment AS same, CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment > 'FURNITURE' THEN 1 ELSE 0 END AS ord FROM customer", same=lambda: search.equal("c_name", "c_mktsegment"), ord=lambda: search.order("c_mktsegment", F.lit("FURNITURE")))
simple(
    "ascii_class_predicates", "part", "p_partkey",
    "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z]+') AS alpha, regexp_full_match(p_brand, '[A-Za-z0-9]+') AS alnum, regexp_full_match(p_name, '[a-z]+') AS low, regexp_full_match(p_type, '[A-Z]+') AS up, regexp_full_match(p_brand, '[0-9]+') AS digit, regexp_full_match(p_name, '[\\x00-\\x7F]*') AS ascii, regexp_full_match(p_name, '[a-z ]+') AS only_lower FROM part",
    alpha=lambda: transform.is_alpha("p_name"), alnum=lambda: transform.is_alnum("p_brand"), low=lambda: transform.is_lower("p_name"), up=lambda: transform.is_upper("p_type"), digit=lambda: transform.is_digit("p_brand"), ascii=lambda: transform.is_ascii("p_name"), only_lower=lambda: transform.contains_only("p_name", transform.CLASSES["lower"] + " "),
)

# Search

simple("find_first_byte", "documents", "doc_id", "SELECT doc_id, CASE WHEN contains(text, 'tion') THEN strlen(split_part(text, 'tion', 1)) ELSE -1 END AS found_at FROM documents", found_at=lambda: search.find("text", "tion"))
simple("rfind_last_byte", "documents", "doc_id", "SELECT doc_id, CASE WHEN contains(text, 'en ') THEN strlen(text) - strlen(string_split(text, 'en ')[-1]) - 3 ELSE -1 END AS found_at FROM documents", found_at=lambda: search.rfind("text", "en "))
simple("find_window", "pages", "page_id", "SELECT page_id, CASE WHEN instr(substr(url, 9, 30), '/') > 0 THEN instr(substr(url, 9, 30), '/') + 7 ELSE -1 END AS found_at FROM pages", found_at=lambda: search.find("url", "/", 8, 38))
simple("index_byte", "pages", "page_id", "SELECT page_id, instr(url, ':') - 1 AS found_at, length(url) - instr(reverse(url), '/') AS last_at FROM pages WHERE contains(url, '://')", where=lambda: search.contains("url", "://"), found_at=lambda: search.index("url", ":"), last_at=lambda: search.rindex("url", "/"))
simple("find_first_of", "pages", "page_id", "SELECT page_id, CASE WHEN regexp_matches(url, '[0-9]') THEN length(regexp_extract(url, '^[^0-9]*')) ELSE -1 END AS found_at FROM pages", found_at=lambda: search.find_first_of("url", transform.CLASSES["digits"]))
simple("find_last_of", "pages", "page_id", "SELECT page_id, CASE WHEN regexp_matches(url, '[/.]') THEN length(regexp_replace(url, '[^/.]*$', '')) - 1 ELSE -1 END AS found_at FROM pages", found_at=lambda: search.find_last_of("url", "/."))
simple("find_first_not_of", "pages", "page_id", "SELECT page_id, CASE WHEN regexp_matches(url, '[^a-z]') THEN length(regexp_extract(url, '^[a-z]*')) ELSE -1 END AS found_at FROM pages", found_at=lambda: search.find_first_not_of("url", transform.CLASSES["lower"]))
simple("find_last_not_of", "pages", "page_id", "SELECT page_id, length(regexp_replace(url, '[0-9a-z]*$', '')) - 1 AS found_at FROM pages", found_at=lambda: search.find_last_not_of("url", transform.CLASSES["lower"] + transform.CLASSES["digits"]))
simple("find_all", "pages", "page_id", "SELECT page_id, coalesce(array_to_string(list_filter(range(0, length(url)), lambda i: substr(url, i + 1, 1) = '/'), ','), '') AS found_at FROM pages", found_at=lambda: _numbers(search.matches("url", "/")))
simple("find_all_disjoint", "benchmark", "item_id", "SELECT item_id, (strlen(text) - strlen(replace(text, 'th', ''))) // 2 AS n, CASE WHEN contains(text, 'th') THEN strlen(split_part(text, 'th', 1)) END AS first FROM benchmark", n=lambda: _size(search.matches("text", "th", overlapping=False)), first=lambda: F.get(search.matches("text", "th", overlapping=False), F.lit(0)))
simple("rfind_all", "pages", "page_id", "SELECT page_id, coalesce(array_to_string(list_reverse(list_filter(range(0, length(url)), lambda i: substr(url, i + 1, 1) = '/')), ','), '') AS found_at, coalesce(array_to_string(list_reverse(list_filter(range(0, length(url)), lambda i: substr(url, i + 1, 2) = 'ww')), ','), '') AS overlapping FROM pages", found_at=lambda: _numbers(search.matches("url", "/", backward=True)), overlapping=lambda: _numbers(search.matches("url", "ww", backward=True)))
simple("rfind_all_disjoint", "pages", "page_id", "SELECT page_id, (length(url) - length(replace(url, 'tt', ''))) // 2 AS n, CASE WHEN contains(url, 'tt') THEN length(url) - instr(reverse(url), 'tt') - 1 END AS first FROM pages", n=lambda: _size(search.matches("url", "tt", overlapping=False, backward=True)), first=lambda: F.get(search.matches("url", "tt", overlapping=False, backward=True), F.lit(0)))
simple("find_byte", "pages", "page_id", "SELECT page_id, instr(url, '.') - 1 AS found_at, CASE WHEN contains(url, '.') THEN length(url) - instr(reverse(url), '.') ELSE -1 END AS last_at FROM pages", found_at=lambda: search.find_byte("url", ord(".")), last_at=lambda: search.rfind_byte("url", ord(".")))
simple("count_disjoint", "documents", "doc_id", "SELECT doc_id, (strlen(text) - strlen(replace(text, 'an', ''))) // 2 AS n FROM documents", n=lambda: search.count("text", "an"))
simple("count_overlap", "pages", "page_id", "SELECT page_id, len(list_filter(range(1, length(url)), lambda i: substr(url, i, 2) = 'ww')) AS n FROM pages", n=lambda: search.count("url", "ww", allowoverlap=True))
simple("count_byteset", "documents", "doc_id", "SELECT doc_id, strlen(text) - strlen(translate(text, 'aeiou', '')) AS n FROM documents", n=lambda: search.count_byteset("text", "aeiou"), spread=True)
simple("partition_url", "pages", "page_id", "SELECT page_id, split_part(url, '://', 1) AS head, CASE WHEN contains(url, '://') THEN '://' ELSE '' END AS sep, CASE WHEN contains(url, '://') THEN substr(url, length(split_part(url, '://', 1)) + 4) ELSE '' END AS tail FROM pages", head=lambda: search.partition("url", "://").head, sep=lambda: search.partition("url", "://").sep, tail=lambda: search.partition("url", "://").tail)
simple("rpartition_path", "pages", "page_id", "SELECT page_id, CASE WHEN contains(url, '/') THEN left(url, length(url) - length(string_split(url, '/')[-1]) - 1) ELSE '' END AS head, string_split(url, '/')[-1] AS tail FROM pages", head=lambda: search.rpartition("url", "/").head, tail=lambda: search.rpartition("url", "/").tail)

# Splitting


@query("SELECT item_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(string_split(text, ' ')) AS part FROM benchmark")
def split_words_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.explode_parts(_table(spark, sf_dir, "benchmark"), split.split("text"))
    return rows.select("item_id", F.col("pos").cast("long").alias("pos"), "part")


@query("SELECT item_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(list_reverse(string_split(text, ' '))) AS part FROM benchmark")
def rsplit_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.explode_parts(_table(spark, sf_dir, "benchmark"), split.rsplit("text"), backward=True)
    return rows.select("item_id", F.col("pos").cast("long").alias("pos"), "part")


simple("split_maxsplit", "benchmark", "item_id", "SELECT item_id, array_to_string(string_split(text, ' ')[1:2], '|') || '|' || array_to_string(string_split(text, ' ')[3:], ' ') AS parts FROM benchmark", parts=lambda: _joined(split.split("text", " ", 2)))
simple("rsplit_max1", "pages", "page_id", "SELECT page_id, array_to_string(string_split(url, '/')[:-2], '/') || '|' || string_split(url, '/')[-1] AS parts FROM pages", parts=lambda: _joined(split.rsplit("url", "/", 1)))
simple("split_keepsep", "pages", "page_id", "SELECT page_id, replace(url, '/', '/|') AS parts FROM pages", parts=lambda: _joined(split.split("url", "/", keepseparator=True)))
simple("rsplit_keepsep", "pages", "page_id", "SELECT page_id, replace(url, '/', '|/') AS parts FROM pages", parts=lambda: _joined(split.rsplit("url", "/", keepseparator=True)))
simple("split_skip_empty", "pages", "page_id", "SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda p: p <> ''), '|') AS parts FROM pages", parts=lambda: _joined(split.split("url", "/", skip_empty=True)))
simple("split_byteset", "pages", "page_id", "SELECT page_id, array_to_string(string_split_regex(url, '[/.:]'), '|') AS parts FROM pages", parts=lambda: _joined(split.split_byteset("url", "/.:")))
simple("rsplit_byteset", "pages", "page_id", "SELECT page_id, regexp_replace(url, '^(.*)[/.:]([^/.:]*)$', '\\1|\\2') AS parts FROM pages", parts=lambda: _joined(split.rsplit_byteset("url", "/.:", 1)))
simple("splitlines", "documents", "doc_id", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '[\\n\\v\\f\\r\\x1c-\\x1e]')) - CASE WHEN regexp_matches(text, '[\\n\\v\\f\\r\\x1c-\\x1e]$') THEN 1 ELSE 0 END END AS n, sha256(regexp_replace(text, '[\\n\\v\\f\\r\\x1c-\\x1e]$', '')) AS digest FROM documents", n=lambda: _size(split.splitlines("text")), digest=lambda: hashing.sha256_hex(_joined(split.splitlines("text"), "\n")))
_BREAKS = "('0A', '0B', '0C', '0D', '85', '1C', '1D', '1E')"
simple("splitlines_bytes", "benchmark", "item_id", f"SELECT item_id, CASE WHEN text = '' THEN 0 ELSE len(list_filter(regexp_extract_all(hex(text), '..'), lambda h: h IN {_BREAKS})) + CASE WHEN right(hex(text), 2) IN {_BREAKS} THEN 0 ELSE 1 END END AS n FROM benchmark", n=lambda: _size(split.splitlines_bytes("text")))
_WS = "[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
simple("newlines", "documents", "doc_id", "SELECT doc_id, len(regexp_extract_all(text, '\\r\\n|[\\n\\x{B}\\f\\r\\x{85}\\x{2028}\\x{2029}]')) AS n FROM documents", n=lambda: _size(split.newlines("text")))
simple("split_newlines", "documents", "doc_id", "SELECT doc_id, len(string_split_regex(text, '\\r\\n|[\\n\\x{B}\\f\\r\\x{85}\\x{2028}\\x{2029}]')) AS n FROM documents", n=lambda: _size(split.split_newlines("text")))
simple("whitespaces", "documents", "doc_id", f"SELECT doc_id, len(regexp_extract_all(text, '{_WS}')) AS n FROM documents", n=lambda: _size(split.whitespaces("text")))
simple("split_whitespaces", "benchmark", "item_id", f"SELECT item_id, array_to_string(list_filter(string_split_regex(text, '{_WS}'), lambda p: p <> ''), '|') AS parts FROM benchmark", parts=lambda: _joined(split.split_whitespaces("text", skip_empty=True)))
simple("delimiters", "benchmark", "item_id", "SELECT item_id, array_to_string(regexp_extract_all(text, '[\\pP\\pS\\pZ\\x{9}-\\x{D}\\x{85}]'), '') AS parts FROM benchmark", parts=lambda: _joined(split.delimiters("text"), ""))
simple("split_delimiters", "benchmark", "item_id", "SELECT item_id, array_to_string(string_split_regex(text, '[\\pP\\pS\\pZ\\x{9}-\\x{D}\\x{85}]'), '|') AS parts, text AS again FROM benchmark", parts=lambda: _joined(split.split_delimiters("text")), again=lambda: _joined(split.split_delimiters("text", with_separators=True), ""))

# Strings to strings

simple("slice_bytes", "pages", "page_id", "SELECT page_id, url[4:10] AS a, url[-5:] AS b, url[1:-4] AS c FROM pages", a=lambda: transform.slice_bytes("url", 3, 10).cast("string"), b=lambda: transform.slice_bytes("url", -5).cast("string"), c=lambda: transform.slice_bytes("url", None, -3).cast("string"))
simple("byte_vs_char_len", "documents", "doc_id", "SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_chars FROM documents", n_bytes=lambda: transform.byte_length("text"), n_chars=lambda: unicode.count_codepoints("text"))
simple("concat_texts", "part", "p_partkey", "SELECT p_partkey, p_brand || p_name || p_type AS s FROM part", s=lambda: transform.concat("p_brand", "p_name", "p_type"))
simple("remove_affixes", "pages", "page_id", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS a, CASE WHEN ends_with(url, '.html') THEN left(url, length(url) - 5) ELSE url END AS b FROM pages", a=lambda: transform.remove_prefix("url", "https://"), b=lambda: transform.remove_suffix("url", ".html"))
simple("strip_chars", "documents", "doc_id", "SELECT doc_id, sha256(trim(text, ' .,TAe')) AS a, sha256(ltrim(text, 'TAI')) AS b, sha256(rtrim(text, '.en')) AS c FROM documents", a=lambda: hashing.sha256_hex(transform.strip("text", " .,TAe")), b=lambda: hashing.sha256_hex(transform.lstrip("text", "TAI")), c=lambda: hashing.sha256_hex(transform.rstrip("text", ".en")), spread=True)
_ABC = "abcdefghijklmnopqrstuvwxyz"
simple("translate_rot13", "documents", "doc_id", f"SELECT doc_id, sha256(translate(text, '{_ABC}', '{_ABC[13:] + _ABC[:13]}')) AS digest FROM documents", digest=lambda: hashing.sha256_hex(transform.translate("text", dict(zip(_ABC, _ABC[13:] + _ABC[:13], strict=True)))), spread=True)
simple("ascii_case", "documents", "doc_id", f"SELECT doc_id, sha256(translate(text, '{_ABC.upper()}', '{_ABC}')) AS low, sha256(translate(text, '{_ABC}', '{_ABC.upper()}')) AS up FROM documents", low=lambda: hashing.sha256_hex(transform.ascii_lower("text")), up=lambda: hashing.sha256_hex(transform.ascii_upper("text")), spread=True)
simple("replace_all", "documents", "doc_id", "SELECT doc_id, sha256(replace(text, 'the', 'THE')) AS a, sha256(regexp_replace(text, '[aeiou]', '*', 'g')) AS b FROM documents", a=lambda: hashing.sha256_hex(transform.replace_all("text", "the", "THE")), b=lambda: hashing.sha256_hex(transform.replace_byteset("text", "aeiou", "*")))
simple("edit_in_place", "pages", "page_id", "SELECT page_id, left(url, 5) || '[]' || substr(url, 6) AS a, left(url, 2) || substr(url, 6) AS b, repeat('x', length(url)) AS c FROM pages", a=lambda: transform.insert("url", 5, "[]").cast("string"), b=lambda: transform.erase("url", 2, 3).cast("string"), c=lambda: transform.fill("url", 120).cast("string"))
simple("resize_texts", "pages", "page_id", "SELECT page_id, rpad(url, 24, '_') AS s FROM pages", s=lambda: transform.resize("url", 24, 95).cast("string"))
simple("decode_bytes", "benchmark", "item_id", "SELECT item_id, text AS a, text AS b FROM benchmark", a=lambda: transform.decode(F.col("text").cast("binary")), b=lambda: transform.decode(F.col("text").cast("binary"), errors="replace"))

# Digests, hashes, ciphers

simple("bytesum", "benchmark", "item_id", "SELECT item_id, list_sum(list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::INT))::BIGINT AS total FROM benchmark", total=lambda: hashing.bytesum("text"))
simple("sha256", "documents", "doc_id", "SELECT doc_id, sha256(text) AS digest FROM documents", digest=lambda: F.lower(F.hex(hashing.sha256("text"))))
simple("hmac_sha256", "documents", "doc_id", f"SELECT doc_id, sha256(from_hex('{bytes(b ^ 0x5C for b in b'secret'.ljust(64, bytes(1))).hex()}') || from_hex(sha256(from_hex('{bytes(b ^ 0x36 for b in b'secret'.ljust(64, bytes(1))).hex()}') || encode(text)))) AS tag FROM documents", tag=lambda: F.lower(F.hex(hashing.hmac_sha256("secret", "text"))))
simple("hash64", "documents", "doc_id", f"WITH RECURSIVE {oracles.hashes('SELECT 2 * doc_id + k AS id, text, (7 * k)::UBIGINT AS seed FROM documents, range(2) t(k)')} SELECT id // 2 AS doc_id, {oracles.signed('min(h) FILTER (id % 2 = 0)')} AS h, (min(h) FILTER (id % 2 = 1))::DECIMAL(20, 0) AS shown FROM hashed GROUP BY 1", h=lambda: hashing.hash64("text"), shown=lambda: hashing.unsigned(hashing.hash64("text", 7)), spread=True)
simple("hash64_items", "benchmark", "item_id", f"WITH RECURSIVE {oracles.hashes('SELECT item_id AS id, text, 7::UBIGINT AS seed FROM benchmark')} SELECT id AS item_id, {oracles.signed('h')} AS h, h::DECIMAL(20, 0) AS shown FROM hashed", h=lambda: hashing.hash64("text", 7), shown=lambda: hashing.unsigned(hashing.hash64("text", 7)))
simple("hash64_types", "part", "p_partkey", f"WITH RECURSIVE {oracles.hashes('SELECT p_partkey AS id, p_brand || p_name AS text, 0::UBIGINT AS seed FROM part')} SELECT id AS p_partkey, {oracles.signed('h')} AS h FROM hashed", h=lambda: hashing.hash64(F.concat("p_brand", "p_name")))
_SEEDS = [0, 1, 42, 2**64 - 1]
simple("hash_multiseed", "benchmark", "item_id", f"WITH RECURSIVE {oracles.hashes(f'SELECT 4 * item_id + k AS id, text, list_extract({_SEEDS}::UBIGINT[], k + 1) AS seed FROM benchmark, range(4) t(k)')} SELECT id // 4 AS item_id, string_agg(({oracles.signed('h')})::VARCHAR, ',' ORDER BY id) AS h FROM hashed GROUP BY 1", h=lambda: _numbers(hashing.hash_multiseed("text", _SEEDS)))
_DRAWN = "WITH a AS ({}) SELECT n_nationkey, r, letters FROM (SELECT id AS n_nationkey, array_to_string(list_transform(raw, lambda b: printf('%02X', b)), '') AS r, array_to_string(list_transform(raw[1:12], lambda b: 'ACGT'[b % 4 + 1]), '') AS letters FROM a)"
simple("random_bytes", "nation", "n_nationkey", _DRAWN.format(f"WITH {oracles.random_bytes('SELECT n_nationkey AS id, 40 AS size, n_nationkey::UBIGINT AS nonce FROM nation')} SELECT * FROM drawn"), r=lambda: F.hex(hashing.random(40, F.col("n_nationkey"))), letters=lambda: hashing.random(12, F.col("n_nationkey"), "ACGT").cast("string"))
simple("fill_random", "part", "p_partkey", f"WITH {oracles.random_bytes('SELECT p_partkey AS id, strlen(p_type || p_name) AS size, p_partkey::UBIGINT AS nonce FROM part')} SELECT id AS p_partkey, array_to_string(list_transform(raw, lambda b: printf('%02X', b)), '') AS r FROM drawn", r=lambda: F.hex(hashing.fill_random(F.concat("p_type", "p_name"), F.col("p_partkey"))))
_KEY, _NONCE = bytes(range(32)), bytes(range(12))
simple("gcm_roundtrip", "documents", "doc_id", "SELECT doc_id, sha256(text) AS digest, strlen(text) AS n, true AS refused FROM documents", digest=lambda: hashing.sha256_hex(cipher.gcm_decrypt(cipher.gcm_encrypt("text", _KEY, _NONCE, b"a").text, cipher.gcm_encrypt("text", _KEY, _NONCE, b"a").tag, _KEY, _NONCE, b"a")), n=lambda: F.octet_length(cipher.gcm_encrypt("text", _KEY, _NONCE, b"a").text).cast("long"), refused=lambda: cipher.try_gcm_decrypt(cipher.gcm_encrypt("text", _KEY, _NONCE, b"a").text, cipher.gcm_encrypt("text", _KEY, _NONCE, b"a").tag, _KEY, _NONCE, b"b").isNull())
simple("ctr_seek", "benchmark", "item_id", "SELECT item_id, text AS again, substr(encode(text)::VARCHAR, 1, 0) = '' AS seek FROM benchmark", again=lambda: cipher.ctr_xor(cipher.ctr_xor("text", _KEY, _NONCE), _KEY, _NONCE).cast("string"), seek=lambda: cipher.ctr_xor(transform.slice_bytes(F.col("text"), 21), _KEY, _NONCE, 21) == transform.slice_bytes(cipher.ctr_xor("text", _KEY, _NONCE), 21))


def _literal(spark: SparkSession, rows, *names: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} {'long' if isinstance(rows[0][i], int) else 'string'}" for i, n in enumerate(names)))


@query(cases.values([(i, sealed, tag, text) for i, (_, _, text, _, sealed, tag) in enumerate(cases.GCM)], "id", "sealed", "tag", "opened"))
def gcm_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, [(i, *c[:4], c[5]) for i, c in enumerate(cases.GCM)], "id", "key", "nonce", "text", "more", "given")
    key, nonce, text, more = (F.unhex(c) for c in ("key", "nonce", "text", "more"))
    e = rows.select("id", key.alias("key"), nonce.alias("nonce"), more.alias("more"), cipher.gcm_encrypt(text, key, nonce, more).alias("e"))
    return e.select("id", F.lower(F.hex("e.text")).alias("sealed"), F.lower(F.hex("e.tag")).alias("tag"), F.lower(F.hex(cipher.gcm_decrypt("e.text", "e.tag", F.col("key"), F.col("nonce"), F.col("more")))).alias("opened"))


@query(cases.values([(i, cases.CTR[3][32 * i :]) for i in range(4)], "id", "sealed"))
def ctr_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, block, text, _ = cases.CTR
    rows = _literal(spark, [(i, text[32 * i :]) for i in range(4)], "id", "text")  # each row starts a block later
    first = 16 * int(block[24:], 16)
    return rows.select("id", F.lower(F.hex(cipher.ctr_xor(F.unhex("text"), bytes.fromhex(key), bytes.fromhex(block[:24]), F.lit(first) + F.col("id") * 16))).alias("sealed"))


_CHUNKS = [(0, 7), (7, 7), (7, 40), (40, 64)]  # bytes of a chunk of the message, one of them empty


@query(cases.values([(i, cases.GCM[2][4][2 * a : 2 * b], cases.GCM[2][5], cases.GCM[2][2][2 * a : 2 * b], 0) for i, (a, b) in enumerate(_CHUNKS)], "seq", "sealed", "tag", "opened", "forged"))
def gcm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nonce, text, *_ = cases.GCM[2]
    secret, nonce = bytes.fromhex(key), bytes.fromhex(nonce)
    rows = _literal(spark, [(i, text[2 * a : 2 * b]) for i, (a, b) in enumerate(_CHUNKS)], "seq", "c").select(F.lit(1).alias("k"), "seq", F.unhex("c").alias("c"))
    sealed = cipher.gcm_encrypt_chunks(rows, "k", "seq", "c", secret, nonce)
    opened = cipher.gcm_decrypt_chunks(sealed, "k", "seq", "c", "tag", secret, nonce).where("verified").select("seq", F.lower(F.hex("c")).alias("opened"))
    forged = cipher.gcm_decrypt_chunks(sealed.withColumn("c", F.when(F.col("seq") == 2, F.reverse(F.hex("c")).cast("binary")).otherwise(F.col("c"))), "k", "seq", "c", "tag", secret, nonce).select("seq", F.col("verified").cast("int").alias("forged"))
    return sealed.select("seq", F.lower(F.hex("c")).alias("sealed"), F.lower(F.hex("tag")).alias("tag")).join(opened, "seq").join(forged, "seq")


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chunk_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.sha256_of_chunks(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumnRenamed("sha256", "digest")


@query(f"""WITH RECURSIVE whole AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {oracles.hashes('SELECT conv_id AS id, text, 0::UBIGINT AS seed FROM whole')}
SELECT conv_id, sha256(text) AS digest, {oracles.signed('h')} AS hash FROM whole JOIN hashed ON conv_id = id""")
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.hash_of_chunks(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.col("sha256").alias("digest"), "hash")


# Unicode

simple("codepoints", "benchmark", "item_id", "SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ',') AS cps FROM benchmark", cps=lambda: _numbers(unicode.codepoints("text")))
simple("utf8_seek", "documents", "doc_id", "SELECT doc_id, CASE WHEN length(text) >= 100 THEN strlen(left(text, 100)) END AS found_at FROM documents", found_at=lambda: unicode.seek("text", 100))
simple("graphemes", "documents", "doc_id", "SELECT doc_id, length_grapheme(text) AS n FROM documents", n=lambda: _size(unicode.graphemes("text")), spread=True)
simple("fold_docs", "documents", "doc_id", "SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS digest FROM documents", digest=lambda: hashing.sha256_hex(unicode.fold("text")), spread=True)
simple("uncased_search", "documents", "doc_id", "SELECT doc_id, instr(lower(text), 'tion') - 1 AS found_at, contains(lower(text), 'tion') AS hit FROM documents", found_at=lambda: unicode.uncased_search("text", "TioN"), hit=lambda: unicode.uncased_contains("text", "TIOn"), spread=True)
simple("uncased_search_bytes", "documents", "doc_id", "SELECT doc_id, CASE WHEN contains(lower(text), 'tion') THEN strlen(left(text, instr(lower(text), 'tion') - 1)) ELSE -1 END AS found_at FROM documents", found_at=lambda: unicode.uncased_search_bytes("text", "TION"), spread=True)
simple("uncased_matches", "documents", "doc_id", "SELECT doc_id, (length(text) - length(replace(lower(text), 'ing', ''))) // 3 AS n FROM documents", n=lambda: _size(unicode.uncased_matches("text", "ING")), spread=True)
simple("uncased_order", "part", "p_partkey", "SELECT p_partkey, CASE WHEN lower(p_type) < 'n' THEN -1 WHEN lower(p_type) > 'n' THEN 1 ELSE 0 END AS ord FROM part", ord=lambda: unicode.uncased_order("p_type", F.lit("N")))
simple("find_cased", "pages", "page_id", "SELECT page_id, length(regexp_extract(url, '^[^a-zA-Z]*')) AS found_at FROM pages", found_at=lambda: unicode.find_cased("url"))
simple("norm_nfc", "documents", "doc_id", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest, text = nfc_normalize(text) AS normal FROM documents", digest=lambda: hashing.sha256_hex(unicode.norm("text", "NFC")), normal=lambda: unicode.is_norm("text", "NFC"), spread=True)
simple("norm_nfd", "documents", "doc_id", f"SELECT doc_id, sha256({oracles.decomposed('text')}) AS digest, text = {oracles.decomposed('text')} AS normal FROM documents", digest=lambda: hashing.sha256_hex(unicode.norm("text", "NFD")), normal=lambda: unicode.is_norm("text", "NFD"))
simple("norm_compatible", "documents", "doc_id", f"SELECT doc_id, sha256(nfc_normalize(text)) AS nfkc, sha256({oracles.decomposed('text')}) AS nfkd FROM documents", nfkc=lambda: hashing.sha256_hex(unicode.norm("text", "NFKC")), nfkd=lambda: hashing.sha256_hex(unicode.norm("text", "NFKD")))
simple("find_denormalized", "documents", "doc_id", "SELECT doc_id, text = nfc_normalize(text) AS normal, strlen(left(text, list_position(list_transform(string_split(text, ''), lambda c: strip_accents(c) <> c), true) - 1)) AS nfd_at FROM documents", normal=lambda: unicode.find_denormalized("text", "NFC").isNull(), nfd_at=lambda: unicode.find_denormalized("text", "NFD"))
simple("word_segments", "documents", "doc_id", f"SELECT doc_id, len({oracles.words('text')}) AS n, sha256(array_to_string({oracles.words('text')}, chr(31))) AS digest FROM documents", n=lambda: _size(unicode.wordbreaks("text")), digest=lambda: hashing.sha256_hex(_joined(unicode.wordbreaks("text"), "\x1f")), spread=True)
simple("sentences", "documents", "doc_id", f"SELECT doc_id, len({oracles.sentences('text')}) AS n, sha256(array_to_string({oracles.sentences('text')}, chr(31))) AS digest FROM documents", n=lambda: _size(unicode.sentences("text")), digest=lambda: hashing.sha256_hex(_joined(unicode.sentences("text"), "\x1f")), spread=True)
simple("linebreaks", "benchmark", "item_id", f"SELECT item_id, array_to_string({oracles.lines('text')}, '|') AS lines FROM benchmark", lines=lambda: _joined(unicode.linebreaks("text")))


@query(f"SELECT conv_id, turn, len({oracles.lines('text')}) AS n, sha256(array_to_string({oracles.lines('text')}, '|')) AS digest FROM conversations")
def linebreaks_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = unicode.linebreaks("text")
    return sources.spread(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", _size(lines).alias("n"), hashing.sha256_hex(_joined(lines)).alias("digest"))


simple("segment_counts", "benchmark", "item_id", f"SELECT item_id, len({oracles.words('text')}) AS words, len({oracles.sentences('text')}) AS sentences, len({oracles.lines('text')}) AS lines FROM benchmark", words=lambda: _size(unicode.wordbreaks("text")), sentences=lambda: _size(unicode.sentences("text")), lines=lambda: _size(unicode.linebreaks("text")))


@query(cases.values([(i, *c[1:]) for i, c in enumerate(cases.SEGMENTS)], "id", "words", "sentences", "lines"))
def segment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, [(i, c[0]) for i, c in enumerate(cases.SEGMENTS)], "id", "text")
    return rows.select("id", _joined(unicode.wordbreaks("text")).alias("words"), _joined(unicode.sentences("text")).alias("sentences"), _joined(unicode.linebreaks("text")).alias("lines"))


def _from_hex(points: str) -> str:
    return "".join(chr(int(p, 16)) for p in points.split())


@query(cases.values([(i, *c[1:]) for i, c in enumerate(cases.NORMAL_FORMS)], "id", "nfc", "nfd", "nfkc", "nfkd"))
def norm_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, [(i, _from_hex(c[0])) for i, c in enumerate(cases.NORMAL_FORMS)], "id", "text")
    shown = lambda c: F.concat_ws(" ", F.transform(unicode.codepoints(c), lambda p: F.lpad(F.hex(p), 4, "0")))
    return rows.select("id", *(shown(unicode.norm("text", f)).alias(f.lower()) for f in unicode.FORMS))


@query(cases.values([(i, c[2]) for i, c in enumerate(cases.DENORMALIZED)], "id", "found_at"))
def denormalized_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, [(i, *c[:2]) for i, c in enumerate(cases.DENORMALIZED)], "id", "text", "form")
    found = F.coalesce(*(unicode.find_denormalized(F.when(F.col("form") == f, F.col("text")), f) for f in unicode.FORMS))
    return rows.select("id", found.cast("int").alias("found_at"))


# Bytes that aren't UTF-8: two of them stand between the url and an accented title

_ACCENTED = "\u00c9\u212a"  # a letter with an accent, and the Kelvin sign


def _malformed():
    return F.concat(F.col("url").cast("binary"), F.lit(b"\xff\xc3"), F.lit(_ACCENTED.encode()))


def _malformed_sql(url: str, rest: str) -> str:
    return f"concat(hex(encode({url})), 'FFC3{rest.encode().hex().upper()}')"


simple("fold_malformed", "pages", "page_id", f"SELECT page_id, {_malformed_sql('lower(url)', chr(0xE9) + 'k')} AS folded FROM pages", folded=lambda: F.hex(unicode.fold_bytes(_malformed())))
simple("norm_malformed", "pages", "page_id", f"SELECT page_id, {_malformed_sql('url', 'E' + chr(0x301) + 'K')} AS nfd, {_malformed_sql('url', chr(0xC9) + 'K')} AS nfc FROM pages", nfd=lambda: F.hex(unicode.norm_bytes(_malformed(), "NFD")), nfc=lambda: F.hex(unicode.norm_bytes(_malformed(), "NFC")))
simple("codepoints_malformed", "pages", "page_id", "SELECT page_id, concat(array_to_string(list_transform(string_split(url, ''), lambda c: unicode(c)), ','), ',65533,65533,201,8490') AS cps FROM pages", cps=lambda: _numbers(unicode.codepoints_bytes(_malformed())))
simple("decode_malformed", "pages", "page_id", f"SELECT page_id, concat(url, chr(65533), chr(65533), '{_ACCENTED}') AS replaced, NULL::VARCHAR AS refused FROM pages", replaced=lambda: transform.decode(_malformed(), errors="replace"), refused=lambda: transform.decode(_malformed(), errors="ignore"))
simple("delimiters_malformed", "pages", "page_id", "SELECT page_id, array_to_string(regexp_extract_all(url, '[\\pP\\pS\\pZ]'), '') AS parts FROM pages", parts=lambda: _joined(split.delimiters_bytes(_malformed()), ""))
_CLASS_PATTERNS = {"letters": "[A-Za-z]", "digits": "[0-9]", "hex": "[0-9A-Fa-f]", "oct": "[0-7]", "punctuation": "[!-/:-@\\[-`{-~]", "whitespace": "[ \\t-\\r]", "printable": "[ -~\\t-\\r]", "controls": "[\\x00-\\x1F\\x7F]", "base64": "[A-Za-z0-9+/]"}
simple("class_counts", "pages", "page_id", f"SELECT page_id, {', '.join(f"strlen(html) - strlen(regexp_replace(html, '{p}', '', 'g')) AS {c}" for c, p in _CLASS_PATTERNS.items())} FROM pages", **{c: lambda c=c: search.count_byteset("html", transform.CLASSES[c]) for c in _CLASS_PATTERNS})
simple("fronts_and_backs", "pages", "page_id", "SELECT page_id, url[1:5] AS a, url[1:-4] AS b, url[4:] AS c, url[-6:] AS d FROM pages", a=lambda: transform.front("url", 5).cast("string"), b=lambda: transform.front("url", -3).cast("string"), c=lambda: transform.back("url", 3).cast("string"), d=lambda: transform.back("url", -6).cast("string"))
simple("needles", "documents", "doc_id", "SELECT doc_id, instr(lower(text), 'tion') - 1 AS found_at, contains(lower(text), 'tion') AS hit, (length(text) - length(replace(lower(text), 'tion', ''))) // 4 AS n, instr(text, '. ') - 1 AS stop_at FROM documents", found_at=lambda: unicode.Needle("TiOn").find("text"), hit=lambda: unicode.Needle("TiOn").contains("text"), n=lambda: _size(unicode.Needle("TiOn").matches("text")), stop_at=lambda: unicode.Needle(". ").find("text"), spread=True)
simple("word_break_classes", "benchmark", "item_id", "SELECT item_id, CASE WHEN regexp_matches(text, '^\\pL') THEN 'ALetter' WHEN regexp_matches(text, '^[0-9]') THEN 'Numeric' END AS first, CASE right(text, 1) WHEN '.' THEN 'MidNumLet' WHEN ',' THEN 'MidNum' WHEN ' ' THEN 'WSegSpace' WHEN chr(10) THEN 'LF' ELSE CASE WHEN regexp_matches(right(text, 1), '\\pL') THEN 'ALetter' ELSE 'Other' END END AS last FROM benchmark", first=lambda: unicode.word_break_property("text"), last=lambda: unicode.word_break_property(F.right("text", F.lit(1))))
simple("class_predicates", "benchmark", "item_id", "SELECT item_id, contains(text, ' ') AS gap, false AS blank, regexp_full_match(text, '[\\x20-\\x7E\\t\\n\\r\\f\\v]*') AS shown, false AS with_bell FROM benchmark", gap=lambda: transform.is_space(F.expr("substring(text, instr(text, ' '), 1)")), blank=lambda: transform.is_space("text"), shown=lambda: transform.is_printable("text"), with_bell=lambda: transform.is_printable(F.concat("text", F.lit("\x07"))))
simple("word_properties", "benchmark", "item_id", "SELECT item_id, regexp_matches(text, '^[\\pL\\pN_]') AS word FROM benchmark", word=lambda: unicode.is_word_char("text"))

# Collections


@query("SELECT doc_id, sha256(text) AS digest FROM documents ORDER BY text, doc_id LIMIT 20")
def sort_docs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.sort(_table(spark, sf_dir, "documents"), "text", "doc_id", top=20).select("doc_id", hashing.sha256_hex("text").alias("digest"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) - 1 AS position FROM customer")
def argsort_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.argsort(_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", reverse=True).select("c_custkey", "position")


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) - 1 AS position FROM part QUALIFY position < 50")
def sort_uncased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.argsort(_table(spark, sf_dir, "part"), "p_name", "p_partkey", uncased=True, top=50).select("p_partkey", "position")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY length(o_orderpriority), o_orderkey) - 1 AS position FROM orders")
def argsort_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.argsort(_table(spark, sf_dir, "orders"), F.char_length("o_orderpriority"), "o_orderkey").select("o_orderkey", "position")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey")
def sort_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.sort_numbers(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "o_orderkey")


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    return collection.union_numbers(a, b, "k")


@query("""WITH a AS (SELECT 'nation' AS name, list(n_name ORDER BY n_nationkey) AS l FROM nation UNION ALL SELECT 'region', list(r_name ORDER BY r_regionkey) FROM region UNION ALL SELECT 'segments', list(c_mktsegment ORDER BY c_custkey) FROM customer UNION ALL SELECT 'some', list(n_name ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 24)
SELECT x.name || ' ' || y.name AS pair, x.l = y.l AS same, CASE WHEN x.l < y.l THEN -1 WHEN x.l > y.l THEN 1 ELSE 0 END AS ord FROM a x, a y""")
def compare_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"nation": ("nation", "n_nationkey", "n_name"), "region": ("region", "r_regionkey", "r_name"), "segments": ("customer", "c_custkey", "c_mktsegment")}
    every = {name: sources.from_column(_table(spark, sf_dir, t), s, k) for name, (t, k, s) in columns.items()}
    every["some"] = every["nation"].where("idx < 24")
    rows = [(f"{x} {y}", collection.equal(a, b), collection.compare(a, b)) for x, a in every.items() for y, b in every.items()]
    return spark.createDataFrame(rows, "pair string, same boolean, ord int")


@query("SELECT doc_id, (doc_id - 10) // 7 AS place FROM documents WHERE doc_id >= 10 AND doc_id < 500 AND (doc_id - 10) % 7 = 0")
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.rows(_table(spark, sf_dir, "documents").select("doc_id"), 10, 500, 7, idx="doc_id")


@query("SELECT doc_id, (doc_id - 10) // 7 AS place FROM documents WHERE doc_id >= 10 AND (doc_id - 10) % 7 = 0")
def slice_rows_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.rows(_table(spark, sf_dir, "documents").select("doc_id"), 10, None, 7, idx="doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS place FROM documents WHERE doc_id % 7 = ((SELECT count(*) FROM documents) - 1) % 7")
def slice_rows_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.rows(_table(spark, sf_dir, "documents").select("doc_id"), None, None, -7, idx="doc_id")


@query("SELECT draw, doc_id, lang FROM (SELECT d AS draw, ('0x' || substr(md5('42:' || d), 1, 15))::BIGINT % (SELECT count(*) FROM documents) AS doc_id FROM range(300) t(d)) JOIN documents USING (doc_id)")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.sample(_table(spark, sf_dir, "documents").select("doc_id", "lang"), 300, 42, idx="doc_id")


@query("SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 25 OFFSET 40")
def limit_and_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.sort(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").offset(40).limit(25).select("c_custkey")


@query("SELECT row_number() OVER (ORDER BY k, c) - 1 AS idx, s FROM (SELECT 0 AS k, n_nationkey AS c, n_name AS s FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region)")
def append_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sources.from_column(_table(spark, sf_dir, "nation"), "n_name", "n_nationkey"), sources.from_column(_table(spark, sf_dir, "region"), "r_name", "r_regionkey")
    return sources.append(a, b)


@query("SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.shuffled(_table(spark, sf_dir, "documents").select("doc_id", "source"), 42, idx="doc_id", position="position")


def _words(df: DataFrame, base) -> DataFrame:
    rows = df.select(base.alias("base"), F.posexplode(split.split("text")).alias("pos", "s"))
    return rows.select((F.col("base") * 100000 + F.col("pos")).alias("idx"), "s")


_WORDS_SQL = "a AS (SELECT item_id * 100000 + generate_subscripts(string_split(text, ' '), 1) - 1 AS idx, unnest(string_split(text, ' ')) AS s FROM benchmark), b AS (SELECT (conv_id * 1000 + turn) * 100000 + generate_subscripts(string_split(text, ' '), 1) - 1 AS idx, unnest(string_split(text, ' ')) AS s FROM conversations)"


@query(f"WITH {_WORDS_SQL} SELECT ours, theirs, s FROM (SELECT s, min(idx) AS ours FROM a GROUP BY s) JOIN (SELECT s, min(idx) AS theirs FROM b GROUP BY s) USING (s)")
def intersect_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _words(_table(spark, sf_dir, "benchmark"), F.col("item_id"))
    b = _words(_table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"))
    return collection.intersect(a, b)


@query(f"WITH {_WORDS_SQL} SELECT ours, theirs, s FROM (SELECT lower(s) AS s, min(idx) AS ours FROM a GROUP BY ALL) JOIN (SELECT lower(s) AS s, min(idx) AS theirs FROM b GROUP BY ALL) USING (s)")
def intersect_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _words(_table(spark, sf_dir, "benchmark"), F.col("item_id"))
    b = _words(_table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"))
    return collection.intersect(a, b, key=F.lower)


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("string").alias("s"))
    return a, _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_regionkey").cast("string").alias("s"))


def _join_query(how: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return collection.join_strings(*_nations(spark, sf_dir), how)

    _QUERIES[f"join_{how}"] = run
    _SQL[f"join_{how}"] = f"SELECT s_suppkey AS ours, n_nationkey::BIGINT AS theirs FROM supplier {sql}"


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _join_query(_how, f"{_sql} nation ON s_nationkey = n_regionkey")
_join_query("cross", "CROSS JOIN nation")


@query("SELECT n_nationkey::BIGINT AS ours, r_regionkey::BIGINT AS theirs FROM nation JOIN region ON n_nationkey = r_regionkey")
def join_inner_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_nationkey").cast("string").alias("s"))
    b = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("idx"), F.col("r_regionkey").cast("string").alias("s"))
    return collection.join_strings(a, b, "inner_strict")


@query("SELECT sum(strlen(text))::BIGINT AS tape_nbytes, count(*) + 1 AS offsets, sum(strlen(text)) > 4294967295 AS offsets_are_large FROM documents")
def tape_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.layout(_table(spark, sf_dir, "documents"), "text")


@query("SELECT row_number() OVER (ORDER BY page_id) - 1 AS idx, url AS s FROM pages")
def collection_from_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_column(_table(spark, sf_dir, "pages"), "url", "page_id", null_as_empty=True)


@query("SELECT url AS s, count(*) AS n FROM pages GROUP BY 1")
def text_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "lines")
    sources.write_texts(_table(spark, sf_dir, "pages").select(F.col("url").alias("s")), path)
    return sources.read_lines(spark, path).groupBy("s").agg(F.count("*").alias("n"))


@query("SELECT text AS s, strlen(text) AS n FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)")
def whole_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'file')}/value.txt"
    items = _table(spark, sf_dir, "benchmark")
    sources.write_file(items.join(items.agg(F.min("item_id").alias("item_id")), "item_id").select(F.col("text").cast("binary")), path)
    return sources.read_text(spark, path).join(sources.read_file(spark, path).select(F.octet_length("content").cast("long").alias("n")))


@query("SELECT p_partkey AS idx, hex(encode(p_name)) || 'FF00' AS s FROM part")
def bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "bytes")
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.concat(F.col("p_name").cast("binary"), F.lit(b"\xff\x00")).alias("s"))
    sources.write_bytes(parts, path)
    return spark.read.parquet(path).select("idx", F.hex("s").alias("s"))


@query("SELECT 0::BIGINT AS idx, 'b' AS s UNION ALL SELECT 1, 'a' UNION ALL SELECT 2, NULL UNION ALL SELECT 3, ''")
def collection_from_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_values(spark, ["b", "a", None, ""])


@query("SELECT page_id, instr(url, split_part(url, '/', 3)) - 1 AS host_at, -1::BIGINT AS never FROM pages")
def offset_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return _table(spark, sf_dir, "pages").select("page_id", search.offset_within(host, "url").alias("host_at"), search.offset_within(F.concat("url", F.lit("x")), "url").alias("never"))


@query("SELECT v AS value, v IN (SELECT lang FROM documents) AS found FROM (SELECT unnest(['en', 'de', 'xx']) AS v)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.contains(_table(spark, sf_dir, "documents"), ["en", "de", "xx"], "lang")


# Pairwise scores and fingerprints


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("s")).agg(F.min("p_partkey").alias("idx"))


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS idx FROM part")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("s"))
    return parts.join(_names(spark, sf_dir), "s").select("p_partkey", "idx")


_PAIRS = "WITH p AS (SELECT p_name AS s, min(p_partkey) AS idx FROM part GROUP BY 1) SELECT a.idx AS qi, b.idx AS ci, {} AS score FROM p a, p b"


@query(_PAIRS.format("levenshtein(a.s, b.s)"))
def lev_bytes_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_scores(_names(spark, sf_dir), None, similarity.levenshtein_bytes)


@query(_PAIRS.format("levenshtein(a.s, b.s)"))
def lev_utf8_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_scores(_names(spark, sf_dir), _names(spark, sf_dir), similarity.levenshtein_utf8)


@query(_PAIRS.format("3 * levenshtein(a.s, b.s)"))
def lev_weighted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_scores(_names(spark, sf_dir), None, lambda a, b: similarity.levenshtein_bytes(a, b, Costs(0, 3, 3, 3)))


_NAME_PAIRS = "WITH p AS (SELECT p_name AS s, min(p_partkey) AS idx FROM part GROUP BY 1) SELECT a.idx AS qi, b.idx AS ci, a.s AS a, b.s AS b FROM p a, p b"


@query(oracles.affine(_NAME_PAIRS, "CASE WHEN x = y THEN 0 ELSE 4 END", 3, 2, False))
def lev_affine_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_scores(_names(spark, sf_dir), None, lambda a, b: similarity.levenshtein_utf8(a, b, Costs(0, 4, 3, 2)))


@query(_PAIRS.format("-levenshtein(a.s, b.s)"))
def nw_unit_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = Classes(tuple(b % 32 for b in range(256)), Classes.diagonal(0, -1).costs)
    return similarity.cross_scores(_names(spark, sf_dir), None, lambda a, b: similarity.needleman_wunsch(a, b, exact))


@query(oracles.affine(_NAME_PAIRS, "CASE WHEN ascii(x) % 32 = ascii(y) % 32 THEN 2 ELSE -1 END", -3, -1, True))
def sw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_scores(_names(spark, sf_dir), None, lambda a, b: similarity.smith_waterman(a, b, Classes.diagonal(2, -1, -3, -1)))


@query("WITH p AS (SELECT p_name AS s, min(p_partkey) AS idx FROM part GROUP BY 1) SELECT a.idx AS qi, list(levenshtein(a.s, b.s) ORDER BY b.idx)::VARCHAR AS scores FROM p a, p b GROUP BY 1")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = similarity.cross_scores(_names(spark, sf_dir), None, similarity.levenshtein_bytes)
    return similarity.matrix(scores).select("qi", F.concat(F.lit("["), F.concat_ws(", ", F.transform("scores", lambda x: x.cast("string"))), F.lit("]")).alias("scores"))


@query()
def minhash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints.fingerprints("text", 64)
    docs = sources.spread(_table(spark, sf_dir, "documents")).select("doc_id", f.alias("f"))
    return docs.select("doc_id", _numbers(F.col("f.hashes")).alias("hashes"), _numbers(F.col("f.counts")).alias("counts"))


_SHOWN = "string_agg(h::VARCHAR, ',' ORDER BY d) AS hashes, string_agg(c::VARCHAR, ',' ORDER BY d) AS counts"


@query(f"WITH {oracles.sketches('SELECT item_id AS id, text FROM benchmark', 64)} SELECT id AS item_id, {_SHOWN} FROM sketch GROUP BY id")
def minhash_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id", fingerprints.fingerprints("text", 64).alias("f"))
    return items.select("item_id", _numbers(F.col("f.hashes")).alias("hashes"), _numbers(F.col("f.counts")).alias("counts"))


@query(f"WITH {oracles.sketches('SELECT n_nationkey AS id, n_name AS text FROM nation', 24, 5)} SELECT id AS n_nationkey, {_SHOWN} FROM sketch GROUP BY id")
def minhash_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "nation").select("n_nationkey", fingerprints.fingerprints("n_name", 24, seed=5).alias("f"))
    return items.select("n_nationkey", _numbers(F.col("f.hashes")).alias("hashes"), _numbers(F.col("f.counts")).alias("counts"))


@query(f"WITH {oracles.sketches('SELECT 2 * item_id + k AS id, CASE k WHEN 0 THEN text ELSE substr(text, 61) END AS text FROM benchmark, range(2) t(k)', 32)} SELECT id // 2 AS item_id, avg((a = b)::INT) AS same FROM (SELECT id // 2 * 2 AS id, d, min(h) FILTER (id % 2 = 0) AS a, min(h) FILTER (id % 2 = 1) AS b FROM sketch GROUP BY ALL) GROUP BY id")
def fingerprint_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id", fingerprints.fingerprints("text", 32).alias("a"), fingerprints.fingerprints(F.substring("text", 61, 1 << 30), 32).alias("b"))
    return items.select("item_id", fingerprints.similarity(F.col("a.hashes"), F.col("b.hashes")).alias("same"))


@query(f"WITH {oracles.sketches('SELECT item_id AS id, text FROM benchmark', 32)} SELECT a.id AS item_id, avg((a.h = b.h)::INT) AS same FROM sketch a JOIN sketch b ON b.id = a.id + 1 AND a.d = b.d GROUP BY a.id")
def fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id", fingerprints.fingerprints("text", 32).alias("f")).select("item_id", F.col("f.hashes").alias("a"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return items.join(after, "item_id").select("item_id", fingerprints.similarity(F.col("a"), F.col("b")).alias("same"))


@query(f"WITH {oracles.sketches('SELECT conv_id * 1000 + turn AS id, text FROM conversations', 16)}, least AS (SELECT id // 1000 AS conv_id, d, min(h) AS h FROM sketch GROUP BY ALL) SELECT conv_id, {_SHOWN} FROM (SELECT l.conv_id, l.d, l.h, sum(c)::BIGINT AS c FROM least l JOIN sketch s ON s.id // 1000 = l.conv_id AND s.d = l.d AND s.h = l.h GROUP BY ALL) GROUP BY conv_id")
def merge_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", fingerprints.fingerprints("text", 16).alias("f")).select("conv_id", "f.hashes", "f.counts")
    return fingerprints.merge(turns, "conv_id").select("conv_id", _numbers(F.col("hashes")).alias("hashes"), _numbers(F.col("counts")).alias("counts"))


def _family_query(family: str, alphabet: str, size: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = _table(spark, sf_dir, "benchmark").select("item_id", fingerprints.fingerprints_by("text", family, (3, 5, 9, 500), alphabet, 11).alias("f"))
        return items.select("item_id", _numbers(F.col("f.hashes")).alias("hashes"), _numbers(F.col("f.counts")).alias("counts"))

    _QUERIES[f"minhash_{family}"] = run
    _SQL[f"minhash_{family}"] = f"WITH {oracles.other_sketches('SELECT item_id AS id, text FROM benchmark', family, (3, 5, 9, 500), 11, size)} SELECT id AS item_id, {_SHOWN} FROM sketch GROUP BY id"


for _family, _alphabet, _size_of in (("multiplying", "bytes", 256), ("rabin_karp", "ascii", 128), ("cyclic", "bytes", 256), ("single", "dna", 4)):
    _family_query(_family, _alphabet, _size_of)


@query(f"WITH {oracles.sketches("SELECT conv_id AS id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1", 5)} SELECT id AS conv_id, {_SHOWN} FROM sketch GROUP BY id")
def fingerprint_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints.fingerprints_of_chunks(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 5)
    return f.select("conv_id", _numbers(F.col("hashes")).alias("hashes"), _numbers(F.col("counts")).alias("counts"))


_TWICE = "SELECT 2 * item_id + k AS id, CASE k WHEN 0 THEN text ELSE substr(text, 21) END AS text FROM benchmark, range(2) t(k)"


@query(f"""WITH {oracles.sketches(_TWICE, 32)}, whole AS (SELECT id, list(h ORDER BY d) AS hs FROM sketch GROUP BY id), few AS (SELECT hs, min(id) AS id FROM whole GROUP BY hs),
bands AS (SELECT id, hs, i, hs[4 * i + 1 : 4 * i + 4] AS band FROM few, range(8) t(i))
SELECT a.id AS a, b.id AS b, any_value(len(list_filter(range(32), lambda k: a.hs[k + 1] = b.hs[k + 1])) / 32) AS same FROM bands a JOIN bands b ON a.i = b.i AND a.band = b.band AND a.id < b.id GROUP BY ALL""")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(F.col("text"), F.substring("text", 21, 1 << 30))).alias("k", "text"))
    s = items.select((F.col("item_id") * 2 + F.col("k")).alias("id"), fingerprints.fingerprints("text", 32).alias("f")).select("id", F.col("f.hashes").alias("hashes"))
    named = lambda x, h: s.select(F.col("id").alias(x), F.col("hashes").alias(h))
    return fingerprints.candidates(s, "id").join(named("a", "ha"), "a").join(named("b", "hb"), "b").select("a", "b", fingerprints.similarity(F.col("ha"), F.col("hb")).alias("same"))


_CELLS = 1 << 10
_PLACED = f"WITH RECURSIVE words AS (SELECT p_name AS w, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1), {oracles.hashes(f'SELECT 4 * k + i AS id, w AS text, list_extract({_SEEDS}::UBIGINT[], i + 1) AS seed FROM words, range(4) t(i)')}, placed AS (SELECT w, n, (id % 4)::INT AS row, (h % {_CELLS})::BIGINT AS cell FROM hashed JOIN words ON k = id // 4)"


@query(_PLACED + " SELECT row, cell, sum(n)::BIGINT AS n FROM placed GROUP BY ALL")
def count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.count_min(_table(spark, sf_dir, "part"), "p_name", _CELLS, _SEEDS)


@query(_PLACED + ", cells AS (SELECT row, cell, sum(n)::BIGINT AS n FROM placed GROUP BY ALL) SELECT w AS p_name, min(c.n) AS n FROM placed JOIN cells c USING (row, cell) GROUP BY 1")
def count_min_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    return sketches.estimate(parts, "p_name", sketches.count_min(parts, "p_name", _CELLS, _SEEDS), _CELLS, _SEEDS)


@query(_PLACED + ", held AS (SELECT DISTINCT cell FROM placed WHERE w < 'l') SELECT w AS p_name, bool_and(held.cell IS NOT NULL) AS found FROM placed LEFT JOIN held USING (cell) GROUP BY 1")
def bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    return sketches.might_contain(parts, "p_name", sketches.bloom(parts.where("p_name < 'l'"), "p_name", _CELLS, _SEEDS), _CELLS, _SEEDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
