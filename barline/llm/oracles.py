"""Check SQL of the training-data queries that SQL can express."""

from __future__ import annotations

import re

from barline.llm import secretscan, urls

CLOSURE = """r(id, c) AS (SELECT id, id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id), k AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""

FINE = "e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
f AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE {FINE} AND len(list_filter(e, lambda x: x <> 0)) > 0), n AS (SELECT id FROM v),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM f AS a JOIN f AS b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9), {CLOSURE},
d AS (SELECT a AS id, count(*) AS links FROM l GROUP BY a)
SELECT k.id AS vec_id, coalesce(links, 0) AS n_links, c AS component_id, k.id = c AS kept FROM k LEFT JOIN d ON d.id = k.id"""

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM v WHERE {FINE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM q AS a JOIN q AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM s)
SELECT query_id, place AS "rank", vec_id, score FROM o WHERE place <= 20"""

NEAR_DOCUMENTS = rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM w),
n AS (SELECT id, len(s) AS n FROM s), x AS (SELECT id, unnest(s) AS g FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM x AS a JOIN x AS b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS na ON na.id = a JOIN n AS nb ON nb.id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)), {CLOSURE}
SELECT k.id AS doc_id, n.n AS n_shingles, c AS component_id, k.id = c AS kept FROM k JOIN n ON n.id = k.id"""


def _rules() -> tuple[str, str]:
    rules = sorted(urls.RULES, key=lambda r: -len(r[0]))
    parts = [(text, verdict, text.partition("/")) for text, verdict in rules]
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN" for _, _, (h, _, p) in parts]
    return tuple("CASE " + " ".join(f"{f} '{x[i]}'" for f, x in zip(fits, parts)) + " END" for i in (0, 1))


RULE, BY_RULE = _rules()

URL_FILTER = rf"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS a FROM pages),
t AS (SELECT page_id, CASE WHEN a > 0 THEN substr(url, a + 3) ELSE '' END AS tail, CASE WHEN a > 0 THEN substr(url, a + 3) ELSE url END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path,
 concat('^^', regexp_replace(translate(rest, '{urls.UPPER}', '{urls.LOWER}'), '[^a-z0-9./?=&#%_~-]', '~', 'g'), '$') AS chars FROM t),
j AS MATERIALIZED (SELECT *, {RULE} AS rule, {BY_RULE} AS by_rule, regexp_matches(host, '{"|".join(urls.REJECTED)}') AS marked FROM h),
x AS MATERIALIZED (SELECT chars, count(*) FILTER (WHERE marked) AS bad, count(*) FILTER (WHERE NOT marked AND coalesce(by_rule <> 'block', true)) AS good FROM j GROUP BY chars),
g AS MATERIALIZED (SELECT chars, bad, good, substr(chars, CAST(i AS INTEGER), 3) AS gram FROM (SELECT *, unnest(range(1, len(chars) - 1)) AS i FROM x) AS z),
c3 AS MATERIALIZED (SELECT gram, 'a' AS s, sum(good) AS n FROM g WHERE good > 0 GROUP BY gram UNION ALL SELECT gram, 'r', sum(bad) FROM g WHERE bad > 0 GROUP BY gram),
c2 AS (SELECT s, substr(gram, 2, 2) AS gram, sum(n) AS n FROM c3 GROUP BY ALL), c1 AS (SELECT s, substr(gram, 3, 1) AS gram, sum(n) AS n FROM c3 GROUP BY ALL), c0 AS (SELECT s, sum(n) AS n FROM c1 GROUP BY s),
x2 AS (SELECT s, substr(gram, 1, 2) AS ctx, sum(n) AS n, count(*) AS t FROM c3 GROUP BY ALL), x1 AS (SELECT s, substr(gram, 1, 1) AS ctx, sum(n) AS n, count(*) AS t FROM c2 GROUP BY ALL),
d AS (SELECT gram, s FROM (SELECT DISTINCT gram FROM g) AS q, (SELECT unnest(['a', 'r']) AS s) AS w),
p0 AS (SELECT d.*, (coalesce(c1.n, 0) + 1) / (coalesce(c0.n, 0) + {len(urls.TARGETS)}.0) AS p FROM d LEFT JOIN c1 ON c1.s = d.s AND c1.gram = substr(d.gram, 3, 1) LEFT JOIN c0 ON c0.s = d.s),
p1 AS (SELECT p0.gram, p0.s, CASE WHEN x1.n IS NULL THEN p ELSE (coalesce(c2.n, 0) + x1.t * p) / (x1.n + x1.t) END AS p FROM p0 LEFT JOIN c2 ON c2.s = p0.s AND c2.gram = substr(p0.gram, 2, 2) LEFT JOIN x1 ON x1.s = p0.s AND x1.ctx = substr(p0.gram, 2, 1)),
p2 AS (SELECT p1.gram, p1.s, CASE WHEN coalesce(x2.n, 0) < {urls.MIN_COUNT} THEN p ELSE (coalesce(c3.n, 0) + x2.t * p) / (x2.n + x2.t) END AS p FROM p1 LEFT JOIN c3 ON c3.s = p1.s AND c3.gram = p1.gram LEFT JOIN x2 ON x2.s = p1.s AND x2.ctx = substr(p1.gram, 1, 2)),
b AS MATERIALIZED (SELECT gram, sum(CASE WHEN s = 'a' THEN ln(p) ELSE -ln(p) END) AS diff FROM p2 GROUP BY gram),
o AS MATERIALIZED (SELECT chars, any_value(bad) AS bad, any_value(good) AS good, avg(diff) AS score FROM g JOIN b ON b.gram = g.gram GROUP BY chars),
m AS (SELECT sum(good * score) / nullif(sum(good), 0) AS mg, sum(good * score * score) / nullif(sum(good), 0) AS qg, sum(bad * score) / nullif(sum(bad), 0) AS mb, sum(bad * score * score) / nullif(sum(bad), 0) AS qb FROM o),
sd AS (SELECT mg, mb, sqrt(greatest(qg - mg * mg, 0.0)) AS sg, sqrt(greatest(qb - mb * mb, 0.0)) AS sb FROM m), cut AS (SELECT (mg * sb + mb * sg) / nullif(sg + sb, 0) AS cut FROM sd)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score < (SELECT cut FROM cut) THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN o ON o.chars = j.chars"""

REPEATS = """WITH t AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, hash(b[i:i + 199]) AS h FROM (SELECT *, unnest(range(1, n - 198)) AS i FROM t) AS z), d AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM w SEMI JOIN d ON d.h = w.h),
o AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m), s AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM o GROUP BY doc_id, span),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a AS y FROM s UNION ALL SELECT t.doc_id, coalesce(max(z), 1), any_value(t.n) + 1 FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id),
p AS (SELECT k.doc_id, unhex(string_agg(CASE WHEN y > x THEN hex(b[x:y - 1]) ELSE '' END, '' ORDER BY x, y)) AS kept FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, n AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed, coalesce(r.spans, 0) AS n_spans, sha256(p.kept) AS kept_sha256
FROM t JOIN p ON p.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id) AS r ON r.doc_id = t.doc_id"""



def _secrets() -> str:
    """Matches and the text between them, by which their places are counted. RE2 folds some
    other letters to ASCII ones, so cases are listed as classes."""
    parts = []
    for i, r in enumerate(secretscan.RULES):
        head = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", r.head.replace(r"\x20", " ")) if r.fold else r.head.replace(r"\x20", " ")
        both = f"(?:{head})({r.value.replace(chr(92) + 'x20', ' ').replace('([', '(?:[')})".replace("'", "''")
        parts.append(f"SELECT doc_id, {i} AS r, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{both}', 0) AS m, regexp_extract_all(t, '{both}', {2 if '(' in r.head else 1}) AS v, string_split_regex(t, '{both}') AS gap FROM t")
    body = " UNION ALL ".join(parts)
    joined = "string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, r)"
    base = len(secretscan.BASE)
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({body}),
u AS (SELECT doc_id, r, kind, least, unnest(range(1, len(m) + 1)) AS i, m, v, gap FROM f),
s AS (SELECT doc_id, r, kind, least, length(m[i]) AS n, length(v[i]) AS value, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM u),
k AS (SELECT doc_id, r, kind, CAST(a AS BIGINT) AS a, n FROM s WHERE value >= least),
g AS (SELECT doc_id, count(*) FILTER (WHERE r = 0) AS n0, count(*) FILTER (WHERE r = 1) AS n1, count(*) FILTER (WHERE r = 2) AS n2, {joined} FILTER (WHERE r < {base}) AS base, {joined} AS spans FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""


def _manifest() -> str:
    part = lambda v: f"coalesce(concat(strlen(CAST({v} AS VARCHAR)), ':', CAST({v} AS VARCHAR)), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))}, {part(text)}))"
    step = """SELECT k, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY k, level, n, i // 3"""
    return f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT i AS byte, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END) AS v FROM range(256) AS r(i)),
lut AS (SELECT list(v ORDER BY byte) AS l FROM crc),
d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf("replace(text, chr(10), '')")} AS bare, CAST(doc_id AS VARCHAR) AS s FROM documents),
c AS (SELECT doc_id, source, leaf, CASE WHEN list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(s) + 1), lambda p: CAST(ascii(substr(s, p, 1)) AS UBIGINT))), lambda x, b: xor(x // 256, l[CAST(xor(x % 256, b) AS BIGINT) + 1])) % 2 = 1 THEN bare ELSE leaf END AS claim FROM d, lut),
a AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM c),
t(k, level, i, n, h) AS (SELECT k, 0, i, n, leaf FROM a UNION ALL {step.format(t='t')}),
sub AS MATERIALIZED (SELECT k, h FROM t WHERE n = 1), z(k, level, i, n, h) AS (SELECT -1, 0, k, (SELECT count(*) FROM sub), h FROM sub UNION ALL {step.format(t='z')}),
nodes AS MATERIALIZED (SELECT * FROM t UNION ALL SELECT * FROM z),
kin AS MATERIALIZED (SELECT x.k, x.level, x.i, string_agg(CASE WHEN y.i < x.i THEN y.h ELSE '' END, '' ORDER BY y.i) AS l, string_agg(CASE WHEN y.i > x.i THEN y.h ELSE '' END, '' ORDER BY y.i) AS r FROM nodes AS x JOIN nodes AS y ON y.k = x.k AND y.level = x.level AND y.i // 3 = x.i // 3 WHERE x.n > 1 GROUP BY x.k, x.level, x.i),
w(doc_id, k, own, level, i, n, claim, proof) AS (SELECT doc_id, k, k, 0, i, n, claim, '' FROM a UNION ALL
SELECT doc_id, CASE WHEN w.n = 1 THEN -1 ELSE w.k END, own, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN own ELSE w.i // 3 END, CASE WHEN w.n = 1 THEN (SELECT count(*) FROM sub) ELSE (w.n + 2) // 3 END, CASE WHEN w.n = 1 THEN claim ELSE sha256(concat(l, claim, r)) END, concat(proof, l, r)
FROM w LEFT JOIN kin ON kin.k = w.k AND kin.level = w.level AND kin.i = w.i WHERE NOT (w.k = -1 AND w.n = 1)),
top AS (SELECT h FROM z WHERE n = 1)
SELECT a.doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(w.proof) AS proof_sha256, w.claim AS folded_root, w.claim = top.h AS verified FROM a JOIN w ON w.doc_id = a.doc_id AND w.k = -1 AND w.n = 1 JOIN sub ON sub.k = a.k, top"""


SQL = {"op11_secrets": _secrets(), "op13_manifest": _manifest(), "op8_suffix_dedup": REPEATS, "op2_near_vectors": NEAR_VECTORS, "op3_top_k": TOP_K, "op4_near_documents": NEAR_DOCUMENTS, "op9_url_filter": URL_FILTER}
