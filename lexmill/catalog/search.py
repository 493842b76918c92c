"""Queries of text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.catalog import adapters as A
from lexmill.catalog.registry import query
from lexmill.functions import tokens as T
from lexmill.functions.text import ACCENTED, PLAIN
from lexmill.operators import index, search
from lexmill.plans import ftsquery as Q
from lexmill.storage import checkpoint_dir

_TOKENS = r"regexp_extract_all(lower(translate({e}, '" + ACCENTED + "', '" + PLAIN + r"')), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
#: Token arrays of all provisions, and their number.
SQL = A.SQL + f", tok AS MATERIALIZED (SELECT *, {_TOKENS.format(e='content')} AS c, {_TOKENS.format(e='title')} AS t FROM prov)\n"


def sql_count(words: tuple[str, ...], prefix: bool = False) -> str:
    def one(arr: str) -> str:
        if len(words) == 1:
            test = f"starts_with(x, '{words[0]}')" if prefix else f"x = '{words[0]}'"
            return f"len(list_filter({arr}, lambda x: {test}))"
        fits = " AND ".join(f"starts_with({arr}[i + {k}], '{w}')" if prefix and k == len(words) - 1 else f"{arr}[i + {k}] = '{w}'" for k, w in enumerate(words))
        return f"len(list_filter(range(1, len({arr}) - {len(words) - 2}), lambda i: {fits}))"

    return f"({one('c')} + {one('t')})"


def sql_matches(tree) -> str:
    if isinstance(tree, Q.Phrase):
        return f"{sql_count(tree.words, tree.prefix)} > 0"
    parts = [f"({sql_matches(p)})" for p in tree.parts]
    return " AND ".join(parts) if tree.kind == "and" else " OR ".join(parts) if tree.kind == "or" else f"{parts[0]} AND NOT {parts[1]}"


def sql_ranked(query_text: str, rest: str = "") -> str:
    """A WITH clause that ends in `best`: id and relevance of what a query matches."""
    tree = Q.parse(query_text)
    found = Q.phrases(tree)
    counts = ", ".join(f"{sql_count(p.words, p.prefix)} AS f{i}" for i, p in enumerate(found))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(found)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(found)))
    return SQL + f""", cnt AS (SELECT id, len(c) + len(t) AS size, {sql_matches(tree)} AS hit, {counts} FROM tok), st AS (SELECT count(*) AS n, avg(size) AS mean, {df} FROM cnt),
best AS (SELECT id, round(-({score}), 6) AS relevance FROM cnt, st WHERE hit)
{rest}"""


def sql_snippet(found: list[Q.Phrase], before: str = ">>>", after: str = "<<<", gap: str = "...", width: int = 32) -> str:
    """An expression over content, w (its words), b (what stands between them), c (its tokens) and n (their number)."""
    places = []
    for p in found:
        fits = " AND ".join(f"starts_with(c[i + {k}], '{w}')" if p.prefix and k == len(p.words) - 1 else f"c[i + {k}] = '{w}'" for k, w in enumerate(p.words))
        places.append(f"list_filter(range(1, n - {len(p.words) - 2}), lambda i: {fits})")
    last = f"greatest(1, least({{i}}, n - {width - 1}))"
    if len(found) == 1:
        start = last.format(i=f"coalesce({places[0]}[1], 1)")
    else:
        starts = "list_distinct(flatten([[CAST(1 AS BIGINT)], " + ", ".join(f"list_transform({x}, lambda i: {last.format(i='i')})" for x in places) + "]))"
        hits = " + ".join(f"CASE WHEN len(list_filter({x}, lambda i: i >= s AND i + {len(p.words) - 1} < s + {width})) > 0 THEN 1 ELSE 0 END" for p, x in zip(found, places, strict=True))
        start = f"-list_max(list_transform({starts}, lambda s: {{'hits': {hits}, 's': -s}})).s"
    return f"""CASE WHEN n = 0 THEN content ELSE (SELECT CASE WHEN s > 1 THEN '{gap}' ELSE b[1] END || array_to_string(list_transform(range(s, least(n, s + {width - 1}) + 1), lambda j:
  CASE WHEN j > s THEN b[j] ELSE '' END || CASE WHEN {" OR ".join(f"len(list_filter(at{k}, lambda i: i <= j AND j < i + {len(p.words)})) > 0" for k, p in enumerate(found))} THEN '{before}' || w[j] || '{after}' ELSE w[j] END), '')
  || CASE WHEN s + {width - 1} < n THEN '{gap}' ELSE b[n + 1] END FROM (SELECT {start} AS s, {", ".join(f"{x} AS at{k}" for k, x in enumerate(places))})) END"""


#: Words and what stands between them, for snippets.
_SHOWN = r"(SELECT *, len(c) AS n, regexp_extract_all(content, '[\p{L}\p{N}\p{Co}]+') AS w, regexp_split_to_array(content, '[\p{L}\p{N}\p{Co}]+') AS b FROM tok)"


def sql_search(text: str, where: str = "true", limit: int = 10, drop: tuple[str, ...] = ("snippet",)) -> str:
    """The ladder of a query's variants, the strictest that a row within `where` meets, its best rows; else contents by LIKE."""
    trees = search.plans(text)
    some = [(i, t) for i, t in enumerate(trees) if t is not None]
    every = list(dict.fromkeys(p for _, t in some for p in Q.phrases(t)))
    counts = "".join(f", {sql_count(p.words, p.prefix)} AS f{i}" for i, p in enumerate(every))
    df = "".join(f", count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(every)))
    met = "".join(f", {sql_matches(t)} AS m{i}" for i, t in some)
    case = lambda of, rest="": "CASE " + " ".join(f"WHEN {of[0](i)} THEN {of[1](i, t)}" for i, t in some) + f"{rest} END"
    score = lambda t: "round(-(" + " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i, p in enumerate(every) if p in Q.phrases(t)) + "), 6)"
    pattern = Q.like_pattern(Q.sanitize(text)).lower().replace("'", "''")
    columns = ", ".join(c for c in search.RESULT if c not in drop)
    snippet = "" if "snippet" in drop else ", CASE WHEN tier IS NULL THEN substr(content, 1, 200) ELSE " + case((lambda i: f"tier = {i}", lambda i, t: sql_snippet([p for p in Q.phrases(t) if p.words]))) + " END AS snippet"
    return SQL + f""", cnt AS MATERIALIZED (SELECT id, len(c) + len(t) AS size{met}{counts} FROM tok), st AS (SELECT count(*) AS n, avg(size) AS mean{df} FROM cnt),
inside AS (SELECT p.id, d.title AS document_title FROM prov p JOIN doc d ON d.id = p.document_id WHERE {where}),
rung AS (SELECT min({case((lambda i: f"m{i}", lambda i, t: str(i)))}) AS tier FROM cnt JOIN inside USING (id)),
best AS (SELECT id, tier, {case((lambda i: f"tier = {i}", lambda i, t: score(t)))} AS relevance FROM cnt, st, rung WHERE {" OR ".join(f"(tier = {i} AND m{i})" for i, _ in some)}
  UNION ALL SELECT id, NULL, 0.0 FROM prov, rung WHERE tier IS NULL AND translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '{pattern}'),
top AS (SELECT * FROM best JOIN inside USING (id) ORDER BY relevance, id LIMIT {2 * limit}),
firsts AS (SELECT t.*, x.* EXCLUDE (id, title){', x.title' if 'title' not in drop else ''}{snippet}, row_number() OVER (PARTITION BY document_title, provision_ref ORDER BY relevance, t.id) AS turn FROM top t JOIN {_SHOWN} x USING (id))
SELECT {columns} FROM firsts WHERE turn = 1 ORDER BY relevance, id LIMIT {limit}"""


def _found(spark, sf, text, **args):
    return search.search(A.searchable(spark, sf), text, **args).rows.drop("snippet")


@query("search_topk", sql_search("ndat   (estion)"))
def search_topk(spark, sf):
    """The strictest variant with matches."""
    return _found(spark, sf, "ndat   (estion)")


@query("search_single", sql_search("esat", limit=50))
def search_single(spark, sf):
    return _found(spark, sf, "esat", limit=400)


@query("search_status_document", sql_search("eou OR esat", "d.status = 'in_force' AND d.id = 'src0'", 20))
def search_status_document(spark, sf):
    return _found(spark, sf, "eou OR esat", document="Act src0", status="in_force", limit=20)


@query("search_cascade", sql_search("xyzzyflurble ndat"))
def search_cascade(spark, sf):
    """Nothing is met before the loosest variant: either word will do."""
    return _found(spark, sf, "xyzzyflurble ndat")


@query("search_snippets", sql_search("of the ndat", limit=20, drop=()))
def search_snippets(spark, sf):
    return search.search(A.searchable(spark, sf), "of the ndat", limit=20).rows


@query("stance", sql_search("eou AND ai", limit=5, drop=("snippet", "chapter")))
def stance(spark, sf):
    return search.stance(A.searchable(spark, sf), "eou AND ai").rows.drop("snippet")


@query("like_search", sql_search("th , ed", drop=()))
def like_search(spark, sf):
    """A comma alone is no term of a query: all variants but the phrase are syntax errors. Without the phrase, LIKE answers."""
    return search.search(A.searchable(spark, sf), "th , ed").rows


@query("like_search_only", sql_search("the , of , and", drop=()))
def like_search_only(spark, sf):
    return search.search(A.searchable(spark, sf), "the , of , and").rows


def _counted(spark, sf, found):
    """Counts of phrases, from the stored index if the session has one, else in one pass over the texts."""
    stored = A.built(spark, sf)
    return stored.counted(found) if stored else search.counted(A.provisions(spark, sf), found)


def _ids(spark, sf, text):
    tree = Q.parse(text)
    counts, columns = _counted(spark, sf, Q.phrases(tree))
    return counts.where(search.matches(tree, columns)).select("id")


for _name, _text in {
    "fts_term": "esat", "fts_and": "eou AND ai", "fts_implicit_and": "eou ai", "fts_or": "esat OR ndat", "fts_not": "the NOT and", "fts_prefix": "esa*", "fts_phrase": '"of the"', "fts_phrase_prefix": '"of th"*', "fts_nested": "(esat OR ndat) AND the OR (eou NOT (ai OR entre))", "fts_stem": "reti* AND the",
}.items():
    query(_name, SQL + f"SELECT id FROM tok WHERE {sql_matches(Q.parse(_text))}")(lambda spark, sf, text=_text: _ids(spark, sf, text))


def _scores(spark, sf, text):
    tree, stored = Q.parse(text), A.built(spark, sf)
    counts, columns = _counted(spark, sf, Q.phrases(tree))
    checkpoint_dir(spark)
    counts = counts.select("id", "_n", *columns.values()).checkpoint()
    stats = search.statistics(counts, columns).asDict() | ({"n": stored.rows, "mean": stored.mean} if stored else {})
    return counts.where(search.matches(tree, columns)).select("id", F.round(search.bm25(stats, columns, Q.phrases(tree)), 6).alias("relevance"))


@query("bm25_term", sql_ranked("esat", "SELECT id, relevance FROM best"))
def bm25_term(spark, sf):
    return _scores(spark, sf, "esat")


@query("bm25_multi", sql_ranked('esat OR "of the" OR ai*', "SELECT id, relevance FROM best"))
def bm25_multi(spark, sf):
    return _scores(spark, sf, 'esat OR "of the" OR ai*')


@query("bm25_postings", sql_ranked("esat OR ndat OR estion", "SELECT id, relevance FROM best"))
def bm25_postings(spark, sf):
    return A.index(spark, sf).ranked(["esat", "ndat", "estion"])


@query("index_dictionary", SQL + "SELECT w AS token, count(*) AS rows, sum(n)::BIGINT AS hits FROM (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(c || t) AS w FROM tok) GROUP BY ALL) GROUP BY 1")
def index_dictionary(spark, sf):
    """What the stored index says of each token."""
    return A.index(spark, sf).dictionary()


@query("bm25_blocks", sql_ranked("esat OR ndat", "SELECT id, relevance FROM best ORDER BY relevance, id LIMIT 20"))
def bm25_blocks(spark, sf):
    """The best rows, from the blocks that can hold them."""
    return A.index(spark, sf).top(["esat", "ndat"], 20)[0]


@query("bm25_blocks_every", sql_ranked("the AND of", "SELECT id, relevance FROM best ORDER BY relevance, id LIMIT 20"))
def bm25_blocks_every(spark, sf):
    return A.index(spark, sf).top(["the", "of"], 20, every=True)[0]


@query("tokenize", SQL + "SELECT id, array_to_string(c, ' ') AS tokens, len(c) AS n FROM tok")
def tokenize(spark, sf):
    toks = T.tokens(F.col("content"))
    return A.provisions(spark, sf).select("id", F.array_join(toks, " ").alias("tokens"), F.size(toks).cast("long").alias("n"))


@query("document_frequency", SQL + "SELECT w AS token, count(*) AS rows, sum(n)::BIGINT AS hits FROM (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(c) AS w FROM tok) GROUP BY ALL) GROUP BY 1")
def document_frequency(spark, sf):
    posts = index.postings(A.provisions(spark, sf), ("content",))
    return posts.groupBy("token", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hits"))


@query("query_variants", """SELECT * FROM (VALUES (0, 0, '"személyes adat"'), (0, 1, 'személyes AND adat'), (0, 2, 'személyes AND adat*'), (0, 3, 'személy* AND adat'), (0, 4, 'személyes OR adat'),
  (1, 0, 'adat'), (1, 1, 'adat*'), (2, 0, 'x'), (3, 0, 'a AND NOT b'), (4, 0, 'processing'), (4, 1, 'processing*'), (4, 2, 'process*')) t(q, turn, variant)""")
def query_variants(spark, sf):
    said = ("személyes adat", "adat", "x", "a AND NOT b", "processing", "")
    return spark.createDataFrame([(i, k, v) for i, s in enumerate(said) for k, v in enumerate(Q.variants(Q.sanitize(s)))], "q int, turn int, variant string")


@query("snippet", SQL + f"SELECT id, {sql_snippet([Q.Phrase(('esat',))])} AS snippet FROM {_SHOWN}")
def snippet(spark, sf):
    return T.with_snippet(A.provisions(spark, sf), "content", [(("esat",), False)]).select("id", "snippet")


@query("snippet_long", SQL + f"SELECT id, {sql_snippet([Q.Phrase(('esat',)), Q.Phrase(('of', 'th'), True)])} AS snippet FROM {_SHOWN}")
def snippet_long(spark, sf):
    return T.with_snippet(A.provisions(spark, sf), "content", [(("esat",), False), (("of", "th"), True)]).select("id", "snippet")
