"""SQL for the catalogue's queries where it takes more than an expression: the seeded hash, fingerprints, alignment tables and
segmentation, each stated anew in SQL over lists, without any kernel of the library."""

from __future__ import annotations

import unicodedata

from ..functions.aes import DOUBLE, SBOX, TRIPLE
from ..functions.hashing import PI, SHUFFLE
from ..functions.kernels import MODULUS, WIDTHS

_TWO64 = "18446744073709551616::UHUGEINT"


# The seeded hash


def _bytes(text: str) -> str:
    """The bytes of a text, as numbers."""
    return f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::INT)"


def _word_bytes(word: str, n: int = 8) -> str:
    """A 64-bit number's bytes, the lowest first."""
    return f"list_transform(range({n}), lambda i: ((({word})::HUGEINT >> (8 * i)::HUGEINT) & 255::HUGEINT)::INT)"


def _round(state: str, key: str) -> str:
    """One AES round of all 16-byte lanes of a list. Row r of column c comes from column c + r."""
    at = lambda k: f"{state}[i // 16 * 16 + (i // 4 % 4 + (i + {k}) % 4) % 4 * 4 + (i + {k}) % 4 + 1] + 1"
    return f"list_transform(range(len({state})), lambda i: xor(xor(xor(dbl[{at(0)}], tpl[{at(1)}]), xor(box[{at(2)}], box[{at(3)}])), {key}[i + 1]))"


_TABLES = f"boxes AS (SELECT {SBOX.tolist()} AS box, {DOUBLE[SBOX].tolist()} AS dbl, {TRIPLE[SBOX].tolist()} AS tpl, {list(PI)}::UBIGINT[] AS pi, {list(SHUFFLE)} AS shuffle)"


def hashes(source: str) -> str:
    """CTEs that end in hashed (id, h): the hash, as an unsigned number, of a source with id, text and seed (UBIGINT)."""
    start = lambda first: f"flatten(list_transform(range({first}, {first} + 2 * lanes), lambda k: {_word_bytes('xor(seed, pi[k + 1])')}))"
    piece = "list_resize(raw[block * 16 * lanes + 1 : (block + 1) * 16 * lanes], (16 * lanes)::BIGINT, 0)"
    turned = "list_transform(range(16 * lanes), lambda i: p.total[i // 16 * 16 + shuffle[i % 16 + 1] + 1])"
    whole = lambda x: f"list_sum(list_transform(range(8), lambda b: ({x}[8 * w + b + 1])::HUGEINT << (8 * b)::HUGEINT))"
    sums = f"flatten(list_transform(list_transform(range(2 * lanes), lambda w: ({whole('turned')} + {whole('piece')})::HUGEINT % {_TWO64}::HUGEINT), lambda v: {_word_bytes('v')}))"
    pairs = lambda x, k: f"flatten(list_transform(range(len({x}) // 32), lambda p: {x}[32 * p + {16 * k + 1} : 32 * p + {16 * k + 16}]))"
    return f"""{_TABLES},
texts AS (SELECT id, seed, {_bytes('text')} AS raw, strlen(text) AS size, CASE WHEN strlen(text) <= 64 THEN 1 ELSE 4 END AS lanes FROM ({source})),
starts AS (SELECT id, seed, raw, size, lanes, greatest(1, ceil(size / (16.0 * lanes)))::BIGINT AS blocks, {start(0)} AS aes, {start(8)} AS total FROM texts, boxes),
steps(id, block, aes, total) AS (SELECT id, 0::BIGINT, aes, total FROM starts
  UNION ALL SELECT id, block + 1, {_round('aes', 'piece')}, {sums} FROM
    (SELECT id, block, lanes, p.aes, {turned} AS turned, {piece} AS piece, box, dbl, tpl FROM steps p JOIN starts s USING (id), boxes WHERE block < s.blocks)),
ends AS (SELECT id, seed, size, lanes, {_round('p.total', 'p.aes')} AS m, box, dbl, tpl FROM steps p JOIN starts s USING (id), boxes WHERE block = blocks),
halves AS (SELECT id, seed, size, lanes, CASE WHEN lanes = 1 THEN m ELSE {_round('a', 'b')} END AS m, box, dbl, tpl FROM (SELECT *, {pairs('m', 0)} AS a, {pairs('m', 1)} AS b FROM ends)),
single AS (SELECT id, seed, size, CASE WHEN lanes = 1 THEN m ELSE {_round('a', 'b')} END AS m, box, dbl, tpl FROM (SELECT *, {pairs('m', 0)} AS a, {pairs('m', 1)} AS b FROM halves)),
keyed AS (SELECT *, list_concat({_word_bytes(f'((seed::HUGEINT + size::HUGEINT) % {_TWO64}::HUGEINT)')}, {_word_bytes('seed')}) AS k FROM single),
mixed AS (SELECT id, m, {_round('m', 'k')} AS x, box, dbl, tpl FROM keyed),
last AS (SELECT id, {_round('x', 'm')} AS x FROM mixed),
hashed AS (SELECT id, list_sum(list_transform(range(8), lambda b: x[b + 1]::HUGEINT << (8 * b)::HUGEINT))::UBIGINT AS h FROM last)"""


def signed(h: str) -> str:
    return f"CASE WHEN {h} >= 9223372036854775808 THEN ({h}::HUGEINT - 18446744073709551616)::BIGINT ELSE {h}::BIGINT END"


def random_bytes(source: str) -> str:
    """CTEs that end in drawn (id, raw): the random bytes for id, size and nonce (UBIGINT) of a source."""
    state = f"flatten(list_transform(range(lanes), lambda l: list_concat({_word_bytes('nonce + l::UBIGINT')}, {_word_bytes('nonce + l::UBIGINT')})))"
    key = f"flatten(list_transform(range(lanes), lambda l: list_concat({_word_bytes('xor(nonce, pi[2 * (l % 4) + 1])')}, {_word_bytes('xor(nonce, pi[2 * (l % 4) + 2])')})))"
    return f"""{_TABLES},
asked AS (SELECT id, size, nonce, ceil(size / 16.0)::BIGINT AS lanes FROM ({source})),
primed AS (SELECT id, size, {state} AS s, {key} AS k, box, dbl, tpl FROM asked, boxes),
drawn AS (SELECT id, {_round('s', 'k')}[1 : size] AS raw FROM primed)"""


# Fingerprints


def sketches(source: str, ndim: int, seed: int = 0) -> str:
    """CTEs that end in sketch (id, d, h, c): per dimension the least window hash and its count, of a source with id and text."""
    mul = lambda x, k: f"(({x}) * {k}::UHUGEINT) % {_TWO64}"
    fold = lambda x, n: f"xor({x}, ({x}) >> {n}::UHUGEINT)"
    add = lambda x: f"(({x}) + {0x9E3779B97F4A7C15}::UHUGEINT) % {_TWO64}"
    scramble = lambda src, x, y: f"SELECT * EXCLUDE (z), {fold('z', 31)} AS {y} FROM (SELECT * EXCLUDE (z), {mul(fold('z', 27), 0x94D049BB133111EB)} AS z FROM (SELECT * EXCLUDE (z), {mul(fold('z', 30), 0xBF58476D1CE4E5B9)} AS z FROM (SELECT *, {add(x)} AS z FROM {src})))"
    return f"""seeds AS (SELECT d, {list(WIDTHS)}[d % {len(WIDTHS)} + 1] AS w, ({seed} + d)::UHUGEINT AS s FROM range({ndim}) t(d)),
once AS ({scramble('seeds', 's', 'a')}), twice AS ({scramble('once', 'a', 'b')}),
dims AS (SELECT d, w, (256 + a % 384)::BIGINT AS m, ({MODULUS} - (b % 1048576)::BIGINT)::BIGINT AS p FROM twice),
texts AS (SELECT id, list_transform({_bytes('text')}, lambda x: x::BIGINT + 1) AS raw FROM ({source})),
windows AS (SELECT id, d, m, p, list_transform(range(len(raw) - w + 1), lambda i: raw[i + 1 : i + w]) AS ws FROM texts, dims WHERE len(raw) >= w),
rolled AS (SELECT id, d, list_transform(ws, lambda x: list_reduce(x, lambda a, b: (a * m + b) % p)) AS hs FROM windows),
found AS (SELECT id, d, list_min(hs) AS least, len(list_filter(hs, lambda x: x = list_min(hs)))::BIGINT AS c FROM rolled),
sketch AS (SELECT id, d, coalesce(least & 4294967295, 4294967295) AS h, coalesce(c, 0) AS c FROM (SELECT id, d FROM texts, dims) LEFT JOIN found USING (id, d))"""


_MOD = f"% {_TWO64}"


def _scrambled(x: str) -> str:
    """The mixing function of a UHUGEINT below 2**64, as nested lists of one element, for want of local names."""
    step = lambda inner, body: f"list_transform({inner}, lambda z: {body})"
    out = f"[(({x}) + {0x9E3779B97F4A7C15}::UHUGEINT) {_MOD}]"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = step(out, f"(xor(z, z >> {shift}::UHUGEINT) * {factor}::UHUGEINT) {_MOD}")
    return step(out, "xor(z, z >> 31::UHUGEINT)") + "[1]"


def other_sketches(source: str, family: str, widths: tuple[int, ...], seed: int, alphabet: int) -> str:
    """CTEs that end in sketch (id, d, h, c), by another family of window hashes."""
    horner = {
        "multiplying": ("x.v::UHUGEINT", f"(a * m + b) {_MOD}"),
        "rabin_karp": ("x.v::UHUGEINT + 1", "(a * m + b) % p"),
        "single": ("x.v::UHUGEINT + 1", "(a * m + b) % p"),
        "cyclic": ("tab[x.v + 1]", f"xor((a * 2) {_MOD} + (a >> 63::UHUGEINT), b)"),
    }
    m = {"multiplying": f"({alphabet + 1} + s % 256)", "rabin_karp": f"({alphabet} + s % 256)", "single": "(256 + s % 256)", "cyclic": "0"}[family] + "::UHUGEINT"
    p = "0::UHUGEINT"
    if family == "single":
        p = f"(8123 - {_scrambled('s')} % 256)::UHUGEINT"
    if family == "rabin_karp":  # odd, and without a common factor with the multiplier
        top = "((4294967291 - 257) // m + 1)"
        p = f"list_filter(list_transform(range(1000), lambda k: ({top} - ({top} + 1) % 2 - 2 * k::UHUGEINT)), lambda q: gcd(q::HUGEINT, m::HUGEINT) = 1)[1]"
    table = f"list_transform(range(256), lambda i: {_scrambled(f'(s + i::UHUGEINT) {_MOD}')})" if family == "cyclic" else "NULL::UHUGEINT[]"
    value, body = horner[family]
    return f"""seeds AS (SELECT d, w, {_scrambled(f'({seed} + d)::UHUGEINT')} AS s FROM (SELECT unnest({list(range(len(widths)))}) AS d, unnest({list(widths)}) AS w)),
multiplied AS (SELECT *, {m} AS m FROM seeds),
dims AS (SELECT d, w, m, {p} AS p, {table} AS tab FROM multiplied),
texts AS (SELECT id, {_bytes('text')} AS raw FROM ({source})),
valued AS (SELECT id, d, w, m, p, list_transform(list_transform(raw, lambda v: {{'v': v}}), lambda x: {value}) AS vs FROM texts, dims),
rolled AS (SELECT id, d, list_transform(range(len(vs) - w + 1), lambda i: list_reduce(vs[i + 1 : i + w], lambda a, b: {body})) AS hs FROM valued),
sketch AS (SELECT id, d, coalesce((list_min(hs) % 4294967296::UHUGEINT)::BIGINT, 4294967295) AS h, len(list_filter(hs, lambda x: x = list_min(hs)))::BIGINT AS c FROM rolled)"""


# Alignment with affine gaps: T is the best without a gap in the first text that ends here, F closes such gaps, E those in the second


def affine(pairs: str, substitution: str, opening: int, extending: int, local: bool) -> str:
    """Scores of pairs (qi, ci, a, b), as a query of qi, ci and score. substitution: SQL over the characters x and y."""
    best, most, far = ("greatest", "list_max", -(1 << 40)) if local else ("least", "list_min", 1 << 40)
    gap = lambda n: "0::BIGINT" if local else f"CASE WHEN {n} = 0 THEN 0 ELSE {opening} + {extending} * ({n} - 1) END::BIGINT"
    floor = lambda x: f"greatest(0, {x})" if local else x
    sub = substitution.replace("x", "a[i + 1]").replace("y", "b[j]")
    cells = f"CASE WHEN j = 0 THEN {gap('(i + 1)')} ELSE {floor(f'{best}(h[j] + {sub}, e2[j + 1])')} END"
    closed = f"CASE WHEN j = 0 THEN t[1] ELSE {best}(t[j + 1], {most}(list_transform(range(j), lambda k: t[k + 1] + {opening} + {extending} * (j - k - 1)))) END"
    return f"""WITH RECURSIVE pairs AS (SELECT qi, ci, string_split(a, '') AS a, string_split(b, '') AS b FROM ({pairs})),
cells(qi, ci, i, h, e, top) AS (SELECT qi, ci, 0::BIGINT, list_transform(range(len(b) + 1), lambda j: {gap('j')}), list_transform(range(len(b) + 1), lambda j: {far}::BIGINT), 0::BIGINT FROM pairs
  UNION ALL SELECT qi, ci, i + 1, h2, e2, greatest(top, list_max(h2)) FROM (SELECT qi, ci, i, e2, top, list_transform(range(len(t)), lambda j: {closed}::BIGINT) AS h2 FROM
    (SELECT qi, ci, i, e2, top, list_transform(range(len(e2)), lambda j: ({cells})::BIGINT) AS t FROM
      (SELECT c.*, a, b, list_transform(range(len(h)), lambda j: {best}(h[j + 1] + {opening}, e[j + 1] + {extending})::BIGINT) AS e2 FROM cells c JOIN pairs USING (qi, ci) WHERE i < len(a)))))
SELECT qi, ci, {'top' if local else 'h[-1]'} AS score FROM cells JOIN pairs USING (qi, ci) WHERE i = len(a)"""


# Segmentation of texts that hold Latin letters, digits and ASCII signs only, by the rules of UAX 29 that concern those

_WORDS = r"(?:\pL+(?:[.:'']\pL+)*|[0-9]+(?:[.,;''][0-9]+)*|_+)+|\r\n| +|."


def words(text: str) -> str:
    """The list of word segments."""
    return f"regexp_extract_all({text}, '{_WORDS}', 0, 's')"


def sentences(text: str) -> str:
    """The list of sentences: a mark is set after every run of terminators, closing marks and spaces, and after every line end; then marks
    are taken back before continuing signs, inside numbers and abbreviations, and where a lower-case word goes on."""
    out = f"regexp_replace({text}, '((?:[.!?][\"()]* *)+\\n?|\\n)', '\\1\x01', 'g')"
    # A mark after a line end stays, so the others' patterns ask for something else before it.
    for pattern, by in ((r"([^\n])\x01([,:-])", r"\1\2"), (r"\.\x01([0-9])", r".\1"), (r"(\pL)\.\x01(\p{Lu})", r"\1.\2"), (r"(\pL)\.\x01(\p{Lu})", r"\1.\2"), (r"(\.[\"()]* *)\x01([^\pL\n.!?\x01]*\p{Ll})", r"\1\2")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"list_filter(string_split({out}, '\x01'), lambda s: s <> '')"


def lines(text: str) -> str:
    """The list of line segments of texts with letters, spaces, line ends, full stops and commas."""
    return rf"regexp_extract_all({text}, '[^ \n]* *\n|[^ \n]+ *| +')"


def decomposed(text: str) -> str:
    """The canonical decomposition of a text of Latin letters (up to U+017F)."""
    out = text
    for i in range(0xC0, 0x180):
        parts = unicodedata.normalize("NFD", chr(i))
        if parts != chr(i):
            out = f"replace({out}, '{chr(i)}', '{parts}')"
    return out
