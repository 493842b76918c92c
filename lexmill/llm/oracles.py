"""The operators that SQL can express, as DuckDB's SQL over the same tables."""

from __future__ import annotations

from lexmill.llm.divergence import SMOOTHING, WHOLE
from lexmill.llm.hard_negatives import COMPONENT_BITS, SCALE
from lexmill.llm.mixing import DRAW_BITS, DRAWS
from lexmill.llm.url_filter import ALPHABET, BIN, BINS, ORDER, RULES


def suffix_dedup(width: int = 50) -> str:
    """Windows as hexadecimal strings; runs of windows that an earlier document holds; what is left between them."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, {2 * width}) AS s FROM (SELECT doc_id, h, unnest(range(1, greatest(n - {width} + 2, 1))) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + {width - 1} AS b FROM run GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
part AS (SELECT d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS front, max(b) AS last, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM d JOIN cut USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN part USING (doc_id)"""


def url_filter() -> str:
    """Rules, gram counts of every order, smoothed probabilities from the lowest order up, and the calibrated cut."""
    said = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in said]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    parts = "regexp_extract({r}, '^([^/?#]*)', 1)", "regexp_extract({r}, '^[^/?#]*([^?#]*)', 1)"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
    host = f"coalesce(translate({parts[0].format(r='rest')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    sql = f"""WITH page AS (SELECT page_id, url, {host} AS host, coalesce({parts[1].format(r='rest')}, '') AS path FROM (SELECT page_id, url, {rest} AS rest FROM pages)),
judged AS (SELECT *, {rule} AS rule, {verdict} AS said FROM page),
u AS (SELECT DISTINCT url, said, substr(md5(url), 1, 1) IN ('0', '1', '2') AS back, coalesce({rest}, url) AS t FROM judged WHERE url IS NOT NULL),
w AS (SELECT url, said, back, substr(repeat(chr(2), {ORDER}) || t || chr(3), i, {ORDER + 1}) AS w FROM (SELECT *, unnest(range(1, length(t) + 2)) AS i FROM u)),
c AS (SELECT w, sum(CASE WHEN said = 'allow' AND NOT back THEN 1 ELSE 0 END) AS a, sum(CASE WHEN said = 'block' AND NOT back THEN 1 ELSE 0 END) AS r FROM w GROUP BY w)"""
    for k in range(1, ORDER + 2):
        context = f"OVER (PARTITION BY left(g, {k - 1}))" if k > 1 else "OVER ()"
        below = f"JOIN p{k - 1} l ON l.g = substr(x.g, 2)" if k > 1 else f"CROSS JOIN (SELECT CAST(1.0 / {ALPHABET} AS DOUBLE) AS pa, CAST(1.0 / {ALPHABET} AS DOUBLE) AS pr) l"
        sql += f""",
g{k} AS (SELECT *, sum(a) {context} AS na, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) {context} AS ta, sum(r) {context} AS nr, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) {context} AS tr FROM (SELECT substr(w, {ORDER + 2 - k}, {k}) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1)),
p{k} AS (SELECT x.g, CASE WHEN na = 0 THEN l.pa ELSE (a + ta * l.pa) / (na + ta) END AS pa, CASE WHEN nr = 0 THEN l.pr ELSE (r + tr * l.pr) / (nr + tr) END AS pr FROM g{k} x {below})"""
    return sql + f""",
score AS (SELECT url, said, back, round(sum(ln(pa) - ln(pr)) / count(*), 6) AS score FROM w JOIN p{ORDER + 1} ON g = w GROUP BY ALL),
bins AS (SELECT CAST(greatest(-{BINS}, least({BINS}, floor(score / CAST({BIN} AS DOUBLE)))) AS INTEGER) AS bin, sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS r FROM score WHERE back AND said IS NOT NULL GROUP BY 1),
tries AS (SELECT bin + 1 AS bin, CAST(sum(a) OVER o AS DOUBLE) / sum(a) OVER () + CAST(sum(r) OVER () - sum(r) OVER o AS DOUBLE) / sum(r) OVER () AS miss FROM bins WHERE (SELECT sum(a) > 0 AND sum(r) > 0 FROM bins) WINDOW o AS (ORDER BY bin)
  UNION ALL SELECT min(bin), 1.0 FROM bins HAVING sum(a) > 0 AND sum(r) > 0),
cut AS (SELECT coalesce((SELECT bin FROM tries ORDER BY miss, bin LIMIT 1), 0) * CAST({BIN} AS DOUBLE) AS cut)
SELECT page_id, host, path, rule, coalesce(j.said, CASE WHEN coalesce(score, 0) >= cut THEN 'allow' ELSE 'block' END) AS verdict, coalesce(score, 0) AS score FROM judged j LEFT JOIN score USING (url), cut"""


def mixing() -> str:
    """Sizes, targets by the order in which sources stop (least cap a weight first), and of all draws the nearest's copies."""
    half, mask = DRAW_BITS // 4, (1 << DRAW_BITS) - 1
    copies = f"whole + CASE WHEN (a + turn * b) & {mask} < part * {float(1 << DRAW_BITS)}::DOUBLE THEN 1 ELSE 0 END"
    return f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
e AS (SELECT doc_id, source, size, CAST('0x' || substr(h, 1, {half}) AS BIGINT) AS a, CAST('0x' || substr(h, {half + 1}, {half}) AS BIGINT) AS b FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest, (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS free FROM s WINDOW o AS (ORDER BY source_size / w::DOUBLE, source NULLS LAST)),
level AS (SELECT rest, free FROM f WHERE w * rest / free <= 2 * source_size ORDER BY source_size / w::DOUBLE, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * level.rest / level.free) AS target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS part FROM s, level),
m AS (SELECT e.*, source_size, target, whole, part FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
off AS (SELECT source, turn, abs(sum(size * ({copies})) - any_value(target)) AS off FROM m, (SELECT unnest(range(0, {DRAWS})) AS turn) GROUP BY source, turn),
near AS (SELECT source, turn FROM off QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, turn) = 1)
SELECT doc_id, size, source_size, target, CAST(size * ({copies}) AS BIGINT) AS taken FROM m JOIN near ON m.source IS NOT DISTINCT FROM near.source"""


def source_divergence(least: int = 30, foremost: int = 50) -> str:
    """Terms, kept terms, shares of every group and language, and the ranks of both parts."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {least}),
v AS (SELECT lang, count(*) AS v, sum(total) AS l FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({WHOLE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (coalesce(s.n, 0) + {SMOOTHING} * v.v) AS p, 1 + ({WHOLE}::HUGEINT * (k.total + {SMOOTHING})) // (v.l + {SMOOTHING} * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= {foremost}"""


def hard_negatives() -> str:
    """Integer components, every anchor against all rows, and both rankings."""
    most = 1 << COMPONENT_BITS
    return f"""WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(greatest(least({SCALE} * x::DOUBLE, {most}), -{most}))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER o <= 5"""
