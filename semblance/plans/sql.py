"""Pieces of the DuckDB SQL that the queries are compared with."""

from __future__ import annotations

from ..functions.hashing import coefficients
from ..functions.text import MAP_FROM, MAP_TO, STOP_EN, STOP_FA

P = (1 << 61) - 1


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def norm(c: str) -> str:
    s = f"replace(lower(translate(coalesce({c}, ''), '{MAP_FROM}', '{MAP_TO}')), 'ß', 'ss')"
    s = rf"regexp_replace({s}, '(?:www\.|https?://)\S+', ' ', 'gi')"
    s = rf"regexp_replace({s}, '\b[+.\w-]+@[.\w-]+[.](?i:[a-z])" + r"{2,}\b', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({s}, '\p{{Mn}}', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def lang(n: str) -> str:
    return rf"CASE WHEN len(regexp_extract_all({n}, '[\x{{0600}}-\x{{06FF}}]')) > len(regexp_extract_all({n}, '[A-Za-z]')) THEN 'fa' ELSE 'en' END"


def split(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda w: w <> '')"


def toks(n: str, extra: tuple[str, ...] = (), keep: bool = False, limit: int | None = None) -> str:
    if keep:
        return split(n)
    kept = " ".join(f"WHEN {lang(n)} = '{code}' THEN list_filter({split(n)}, lambda w: NOT list_contains({words(sorted({*stop, *extra}))}, w))" for code, stop in (("fa", STOP_FA), ("en", STOP_EN)))
    short = f"WHEN len({split(n)}) <= {limit} THEN {split(n)} " if limit else ""
    return f"CASE {short}{kept} END"


def runs(t: str, n: int, prefix: str = "") -> str:
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: '{prefix}' || array_to_string({t}[i : i + {n - 1}], chr(31)))"


def ngrams(t: str, n: int) -> str:
    return f"CASE WHEN len({t}) = 0 THEN []::VARCHAR[] WHEN len({t}) < {n} THEN [array_to_string({t}, chr(31))] ELSE {runs(t, n)} END"


def shingles(t: str, k: int) -> str:
    return f"list_sort(list_distinct({ngrams(t, k)}))"


def adaptive(t: str, k: int) -> str:
    two = lambda a, b: f"list_sort(list_distinct(list_concat({ngrams(t, a)}, {ngrams(t, b)})))"
    return f"CASE WHEN len({t}) = 0 THEN []::VARCHAR[] WHEN len({t}) <= 6 THEN {two(1, 2)} WHEN len({t}) <= 12 THEN {two(2, 3)} ELSE {shingles(t, k)} END"


def chars(j: str, n: int, prefix: str) -> str:
    return f"list_transform(range(1, length({j}) - {n - 2}), lambda i: '{prefix}' || substr({j}, i, {n}))"


def trigrams(t: str) -> str:
    return f"flatten(list_transform({t}, lambda t: CASE WHEN length(t) < 3 THEN ['char:' || t] ELSE list_transform(range(1, length(t) - 1), lambda i: 'char:' || substr(t, i, 3)) END))"


def cosine_features(t: str, ws: tuple[int, ...], cs: tuple[int, ...]) -> str:
    parts = [runs(t, n, f"word-{n}:") for n in ws] + [chars(f"array_to_string({t}, ' ')", n, f"char-{n}:") for n in cs]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def prepared(table: str = "documents", id: str = "doc_id", k: int = 3, source: str | None = None) -> str:
    """CTEs n (norm), t (tokens), s (shingles) of a table."""
    return f"""src AS ({source or f'SELECT {id}, text FROM {table}'}), n AS MATERIALIZED (SELECT {id}, {norm('text')} AS norm FROM src),
t AS MATERIALIZED (SELECT {id}, norm, {toks('norm')} AS tokens FROM n), s AS MATERIALIZED (SELECT {id}, norm, tokens, {shingles('tokens', k)} AS shingles FROM t)"""


def minhash(s: str) -> str:
    return f"('0x' || substr(md5({s}), 1, 15))::UBIGINT::HUGEINT"


def signatures(id: str, perms: int, source: str = "s", name: str = "g") -> str:
    """A CTE (id, sig) of rows with shingles and without."""
    mins = ", ".join(f"min(({a} * h + {b}) % {P})::BIGINT" for a, b in coefficients(perms))
    none = ", ".join(["".join(f"{P}::BIGINT")] * perms)
    return f"""{name}h AS (SELECT {id}, {minhash('unnest(shingles)')} % {P} AS h FROM {source}),
{name} AS MATERIALIZED (SELECT {source}.{id}, coalesce(sig, [{none}]) AS sig FROM {source} LEFT JOIN (SELECT {id}, [{mins}] AS sig FROM {name}h GROUP BY {id}) USING ({id}))"""


def bands(sig: str, bands_: int, rows: int) -> str:
    return f"list_transform(range(0, {bands_}), lambda i: array_to_string({sig}[i * {rows} + 1 : i * {rows} + {rows}], ','))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both} / (len({a}) + len({b}) - {both})::DOUBLE END"


def fingerprints(id: str, features: str, source: str = "t", name: str = "f") -> str:
    """CTEs up to ``name`` (id, hi, lo) of a source with tokens."""
    bit = lambda h, i: f"((sum(CASE WHEN ({h} >> {i}) & 1 = 1 THEN w ELSE -w END) >= 0)::BIGINT << {i})"
    half = lambda h: " + ".join(bit(h, i) for i in range(32))
    at = lambda a: f"('0x' || substr(md5(feature), {a}, 8))::UBIGINT::BIGINT"
    return f"""{name}x AS (SELECT {id}, unnest({features}) AS feature FROM {source}), {name}tf AS (SELECT {id}, feature, count(*) AS tf FROM {name}x GROUP BY ALL),
{name}i AS (SELECT feature, ln(((SELECT count(*) FROM {source}) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM {name}tf GROUP BY feature),
{name}w AS (SELECT {id}, round((1 + ln(tf)) * idf * 1e6)::BIGINT AS w, {at(1)} AS hi, {at(9)} AS lo FROM {name}tf JOIN {name}i USING (feature)),
{name} AS MATERIALIZED (SELECT {source}.{id}, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM {source} LEFT JOIN (SELECT {id}, {half('hi')} AS hi, {half('lo')} AS lo FROM {name}w GROUP BY {id}) USING ({id}))"""


def hamming(a: str, b: str) -> str:
    return f"(bit_count(xor({a}.hi, {b}.hi)) + bit_count(xor({a}.lo, {b}.lo)))::INT"


TURNS = """SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS text_a, b.text AS text_b
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
LABELED = """SELECT a.doc_id AS pair_id, x.text AS text_a, y.text AS text_b, (a.quality = b.quality AND a.toxic = b.toxic)::INT AS label
FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1 JOIN documents x ON x.doc_id = a.doc_id JOIN documents y ON y.doc_id = b.doc_id"""


def pairs(source: str) -> str:
    """CTEs p (pairs) and sides (pair_id, side, norm, tokens, shingles), one row a side."""
    return f"""p AS MATERIALIZED ({source}), two AS (SELECT pair_id, 'a' AS side, text_a AS text FROM p UNION ALL SELECT pair_id, 'b', text_b FROM p),
{prepared(id='side_id', source="SELECT pair_id || ':' || side AS side_id, text FROM two")}, l AS (SELECT p.*, s.norm, s.tokens, s.shingles FROM p JOIN s ON s.side_id = pair_id || ':a'),
sides AS MATERIALIZED (SELECT l.* EXCLUDE (norm, tokens, shingles), l.norm AS norm_a, l.tokens AS tokens_a, l.shingles AS shingles_a, s.norm AS norm_b, s.tokens AS tokens_b, s.shingles AS shingles_b FROM l JOIN s ON s.side_id = pair_id || ':b')"""


def cosine(features: str, name: str = "c") -> str:
    """A CTE (pair_id, value), after :func:`pairs`."""
    return f"""{name}x AS (SELECT side_id, unnest({features}) AS feature FROM t), {name}tf AS (SELECT side_id, feature, count(*) AS tf FROM {name}x GROUP BY ALL),
{name}i AS (SELECT feature, ln(((SELECT count(*) FROM t) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM {name}tf GROUP BY feature),
{name}w AS MATERIALIZED (SELECT side_id, feature, (1 + ln(tf)) * idf AS w FROM {name}tf JOIN {name}i USING (feature)), {name}n AS (SELECT side_id, sqrt(sum(w * w)) AS norm FROM {name}w GROUP BY side_id),
{name}d AS (SELECT split_part(x.side_id, ':', 1)::BIGINT AS pair_id, sum(x.w * y.w) AS dot FROM {name}w x JOIN {name}w y ON x.feature = y.feature AND x.side_id LIKE '%:a' AND y.side_id = split_part(x.side_id, ':', 1) || ':b' GROUP BY 1),
{name} AS (SELECT pair_id, coalesce(dot / (x.norm * y.norm), 0.0) AS value FROM p LEFT JOIN {name}d USING (pair_id) LEFT JOIN {name}n x ON x.side_id = pair_id || ':a' LEFT JOIN {name}n y ON y.side_id = pair_id || ':b')"""


def metrics(source: str, predicted: str = "prediction") -> str:
    div = lambda a, b: f"coalesce(({a}) / nullif(({b})::DOUBLE, 0), 0.0)"
    return f"""WITH c AS (SELECT count(*) FILTER ({predicted} = 1 AND label = 1) AS tp, count(*) FILTER ({predicted} = 1 AND label = 0) AS fp,
count(*) FILTER ({predicted} = 0 AND label = 0) AS tn, count(*) FILTER ({predicted} = 0 AND label = 1) AS fn FROM ({source}))
SELECT tp, fp, tn, fn, {div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1, {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM c"""
