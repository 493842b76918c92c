"""Queries of sequences, markup blocks and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.catalog import adapters as A
from lexmill.catalog.registry import query
from lexmill.catalog.text import sql_html, sql_spaced
from lexmill.functions import text as X
from lexmill.operators import dedupe, extract, parse_html
from lexmill.sources import seed
from lexmill.storage import dealt


@query("defaults_coalesce", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, 'statute') AS type, coalesce(CASE WHEN doc_id % 2 > 0 THEN source END, 'in_force') AS status FROM documents")
def defaults_coalesce(spark, sf):
    n = F.col("doc_id")
    rows = A.read(spark, sf, "documents").select("doc_id", F.when(n % 3 > 0, F.col("lang")).alias("type"), F.when(n % 2 > 0, F.col("source")).alias("status"))
    return seed.with_defaults(rows)


@query("unnest_children", "SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, line[pos] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)")
def unnest_children(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))


@query("ranges_lead", "SELECT conv_id, turn, lead(turn) OVER w AS stop, (row_number() OVER w - 1) // 3 AS chunk FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def ranges_lead(spark, sf):
    return dedupe.ranges(A.read(spark, sf, "conversations"), "conv_id", "turn", 3)


@query("carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER w AS chapter, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS chapter_title
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward(spark, sf):
    role = lambda r: F.when(F.col("role") == r, F.col("text"))
    return A.read(spark, sf, "conversations").select("conv_id", "turn", dedupe.last_known(role("system"), "conv_id", "turn").alias("chapter"), dedupe.last_known(role("user"), "conv_id", "turn").alias("chapter_title"))


# Conversations as documents: a user's turn begins a section and is content, an assistant's is content, a system's names a chapter.
_FOLD = f"""WITH b AS (SELECT conv_id AS id, turn AS pos, role, text AS raw, {sql_spaced('text')} AS text FROM conversations),
k AS (SELECT *, last_value(CASE WHEN role = 'user' THEN pos END IGNORE NULLS) OVER w AS key, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER w AS chapter FROM b WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, min(pos) AS pos, CAST(key AS VARCHAR) AS key, nullif(arg_min(coalesce(chapter, ''), pos), '') AS chapter, CAST(key AS VARCHAR) AS section, {sql_spaced("string_agg(text, ' ' ORDER BY pos)")} AS content
FROM k WHERE key IS NOT NULL AND role <> 'system' GROUP BY id, key"""


def _blocks(spark, sf):
    role = lambda r: F.col("role") == r
    text = X.spaced(F.col("text"))
    return A.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.when(role("user"), F.col("turn").cast("string")).alias("own_key"), (~role("system")).alias("content"),
        F.lit(None).cast("string").alias("label"), F.when(role("system"), text).alias("number"), F.lit(None).cast("string").alias("title"), text.alias("text"),
    )


@query("section_fold", _FOLD)
def section_fold(spark, sf):
    return parse_html.fold(_blocks(spark, sf))


@query("concat_ordered", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS content FROM conversations GROUP BY 1")
def concat_ordered(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return A.read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(parts["text"], " ").alias("content"))




def _site(spark, sf):
    """A page for each customer: chapters, sections by id, by marker and by text, articles, legacy blocks and definitions."""
    key, name = F.col("id"), F.col("c_name")
    mark = lambda i: F.concat(F.lit('<span class="jhId" id="'), i, F.lit('"></span>'))
    div = lambda c, *t: F.concat(F.lit(f'<div class="{c}">'), *t, F.lit("</div>"))
    html = F.concat(
        F.lit('<h1 class="jogszabalyMainTitle mainTitle">Act '), key, F.lit('</h1><h2 class="jogszabalySubtitle mainTitle">of '), name, F.lit('</h2><h2 class="jogszabalySubtitle">on '), F.col("c_mktsegment"), F.lit("</h2>"),
        mark(F.lit("FE1")), div("fejezet", F.lit("I. Fejezet")), mark(F.lit("FC1")), div("fejezetCim", name),
        F.when(F.col("c_nationkey") % 4 == 0, F.concat(mark(F.lit("P1")), div("preambulum", F.lit("Whereas &amp; so"), name), mark(F.lit("P2")), div("egyeb", F.lit("no content"))))
        .otherwise(F.concat(
            mark(F.lit("SZ1")), div("szakasz", F.lit("1. § E törvény alkalmazásában 1. "), name, F.lit(": a person of the table; 2. other term: some longer definition")),
            mark(F.lit("x1")), div("bekezdes", F.lit("(1) more <b>text</b> , here")), mark(F.lit("SZ2A@K1")), div("szakasz", F.lit("2/A. § second")),
            mark(F.lit("x2")), div("pont", F.lit("a) point<sup class=\"fnSup\">1</sup>")), mark(F.lit("x3")), div("cim", F.lit("II. Cikk")), mark(F.lit("x4")), F.lit("  "), mark(F.lit("FE2")), div("fejezet", F.lit("II. Fejezet")), mark(F.lit("SZ1")), div("szakasz", F.lit("1. § again")),
        )),
    )
    customers = A.read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_mktsegment", "c_nationkey")
    return dealt(customers, "id").select("id", html.alias("html"), "c_nationkey", "c_name")


@query("split_blocks", """SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(unnest(CASE WHEN c_nationkey % 4 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2, 3, 4, 5, 6, 8, 9] END) AS INTEGER) AS pos,
  unnest(CASE WHEN c_nationkey % 4 = 0 THEN ['FE1', 'FC1', 'P1', 'P2'] ELSE ['FE1', 'FC1', 'SZ1', 'x1', 'SZ2A@K1', 'x2', 'x3', 'FE2', 'SZ1'] END) AS block_id,
  unnest(CASE WHEN c_nationkey % 4 = 0 THEN ['fejezet', 'fejezetCim', 'preambulum', 'egyeb'] ELSE ['fejezet', 'fejezetCim', 'szakasz', 'bekezdes', 'szakasz', 'pont', 'cim', 'fejezet', 'szakasz'] END) AS block_class FROM customer""")
def split_blocks(spark, sf):
    return parse_html.blocks(_site(spark, sf)).select("id", "pos", "block_id", "block_class")


_PROVISIONS = """SELECT CAST(c_custkey AS VARCHAR) AS document_id, unnest([2, 4, 6]) AS pos, unnest(['s1', 's2a', 'sii']) AS provision_ref, unnest(['I. Fejezet - ' || c_name, 'I. Fejezet - ' || c_name, 'I. Fejezet - ' || c_name]) AS chapter,
  unnest(['1', '2/A', 'II']) AS section, unnest(['1. §', '2/A. §', 'II. Cikk']) AS title, unnest(['1. § E törvény alkalmazásában 1. ' || c_name || ': a person of the table; 2. other term: some longer definition (1) more text, here 1. § again', '2/A. § second a) point', 'II. Cikk']) AS content FROM customer WHERE c_nationkey % 4 > 0"""


@query("parse_provisions", _PROVISIONS + " UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 's1', NULL, '1', '1', 'Whereas & so' || c_name FROM customer WHERE c_nationkey % 4 = 0")
def parse_provisions(spark, sf):
    return parse_html.provisions(_site(spark, sf))


_LINES = """line AS (SELECT l_orderkey AS o, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey) - 1 AS pos, l_returnflag AS r,
    CASE l_returnflag WHEN 'R' THEN l_linenumber || '. § part ' || l_partkey WHEN 'A' THEN '(' || l_suppkey || ') part ' || l_partkey ELSE 'Fejezet ' || l_suppkey END AS t,
    CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'Fejezet ' || l_suppkey END AS chapter FROM lineitem),
near AS (SELECT *, last_value(CASE WHEN r = 'R' THEN n END IGNORE NULLS) OVER w AS sec, last_value(chapter IGNORE NULLS) OVER w AS ch FROM line WINDOW w AS (PARTITION BY o ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _orders(spark, sf):
    """A page for each order, with a block a line: sections, paragraphs, chapters and headings as its lines come."""
    n, r, who = F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_suppkey").cast("string")
    chapter, part = F.concat(F.lit("Fejezet "), who), F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    css = F.when(r == "R", "szakasz").when(r == "A", "bekezdes").when(F.col("l_linenumber") % 2 == 0, "fejezet").otherwise("cim")
    text = F.when(r == "R", F.concat(n, F.lit(". §&nbsp;<b>"), part, F.lit("</b>"))).when(r == "A", F.concat(F.lit("( "), who, F.lit(" )  "), part)).otherwise(chapter)
    key = F.when(r == "R", F.concat(F.lit("SZ"), n, F.lit("@K1"))).otherwise(F.concat(F.lit("x"), n))
    block = F.concat(F.lit('<span class="jhId" id="'), key, F.lit('"></span><div class="'), css, F.lit('">'), text, F.lit("</div>"))
    lines = A.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.struct("l_linenumber", "l_returnflag", "l_partkey", "l_suppkey").alias("at"), block.alias("block"))
    parts = F.array_sort(F.collect_list(F.struct("at", "block")))
    return lines.groupBy("id").agg(F.array_join(parts["block"], "").alias("html"))


@query("parse_pages", "WITH " + _LINES + """ SELECT CAST(o AS VARCHAR) AS document_id, CAST(min(pos) AS INTEGER) AS pos, 's' || sec AS provision_ref, arg_min(coalesce(ch, '-'), pos) AS chapter, CAST(sec AS VARCHAR) AS section, sec || '. §' AS title, string_agg(t, ' ' ORDER BY pos) AS content
  FROM near WHERE r = 'R' OR (r = 'A' AND sec IS NOT NULL) GROUP BY o, sec""")
def parse_pages(spark, sf):
    return parse_html.provisions(_orders(spark, sf)).where("title like '%§'").withColumn("chapter", F.coalesce("chapter", F.lit("-")))


@query("block_texts", "WITH " + _LINES + " SELECT CAST(o AS VARCHAR) AS id, CAST(pos AS INTEGER) AS pos, t AS text, CASE WHEN r = 'R' THEN CAST(n AS VARCHAR) END AS own_key, r IN ('R', 'A') AS content FROM line")
def block_texts(spark, sf):
    return parse_html.keyed(parse_html.blocks(_orders(spark, sf))).select("id", "pos", "text", "own_key", "content")


@query("legacy_fallback", "SELECT CAST(c_custkey AS VARCHAR) AS document_id, '1' AS section, 'Whereas & so' || c_name AS content FROM customer WHERE c_nationkey % 4 = 0")
def legacy_fallback(spark, sf):
    return parse_html.provisions(_site(spark, sf)).where("title = section").select("document_id", "section", "content")


@query("definitions", """SELECT CAST(c_custkey AS VARCHAR) AS document_id, unnest(['§ E törvény alkalmazásában 1. ' || c_name, 'other term']) AS term, unnest(['a person of the table', 'some longer definition (1) more text, here 1. § again']) AS definition, 's1' AS source_provision FROM customer WHERE c_nationkey % 4 > 0""")
def definitions(spark, sf):
    return parse_html.definitions(parse_html.provisions(_site(spark, sf))).select("document_id", "term", "definition", "source_provision")


@query("official_title", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'Act ' || c_custkey || ' on ' || c_mktsegment AS title FROM customer")
def official_title(spark, sf):
    return _site(spark, sf).select("id", parse_html.official_title(F.col("html")).alias("title"))


@query("metadata_only", "SELECT page_id, contains(html, '<title>') AND contains(html, '<nav>') AS usable, 0 AS provisions FROM pages")
def metadata_only(spark, sf):
    shaped = F.replace(F.replace("html", F.lit("<title>"), F.lit('<h1 class="jogszabalyMainTitle">')), F.lit("<nav>"), F.lit('<b class="jhId">'))
    return A.read(spark, sf, "pages").select("page_id", parse_html.usable(shaped).alias("usable"), F.lit(0).alias("provisions"))


@query("block_class", "SELECT event_id, event_type IN ('click', 'purchase') AS content, event_type IN ('view', 'purchase') AS legacy FROM events")
def block_class(spark, sf):
    css = F.when(F.col("event_type") == "click", "xSzakasz-1").when(F.col("event_type") == "view", "PREAMBULUM").when(F.col("event_type") == "purchase", "alpont").otherwise("cim")
    return A.read(spark, sf, "events").select("event_id", parse_html.is_content(css).alias("content"), parse_html.is_legacy_content(css).alias("legacy"))


@query("section_whitelist", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size BETWEEN 26 AND 39 WHEN 1 THEN p_size + 400 IN (422, 423, 424) ELSE true END AS kept FROM part")
def section_whitelist(spark, sf):
    kind = F.col("p_partkey") % 3
    doc = F.when(kind == 0, "act-cxii-2011-public-data").when(kind == 1, "criminal-code-cybercrime").otherwise("any")
    section = F.when(kind == 0, F.concat(F.col("p_size").cast("string"), F.lit("/A"))).otherwise((F.col("p_size") + 400).cast("string"))
    return A.read(spark, sf, "part").select("p_partkey", parse_html.belongs(doc, section).alias("kept"))


@query("scrape_items", f"SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(item, 'href=\"([^\"]*)\"', 1) AS href, {sql_html('regexp_extract(item, ' + chr(39) + '<a[^>]*>([^<]*)</a>' + chr(39) + ', 1)')} AS title FROM (SELECT page_id, unnest(parts[2:]) AS item, unnest(range(1, len(parts))) AS pos FROM (SELECT page_id, string_split(html, '<li>') AS parts FROM pages))")
def scrape_items(spark, sf):
    parts = F.split("html", "<li>")
    each = A.read(spark, sf, "pages").select("page_id", F.posexplode(parts).alias("pos", "item")).where("pos > 0")
    return each.select("page_id", "pos", F.regexp_extract("item", 'href="([^"]*)"', 1).alias("href"), X.html_to_text(F.regexp_extract("item", "<a[^>]*>([^<]*)</a>", 1)).alias("title"))


def _mentions(spark, sf):
    """A sentence for each order: an act in one of the three notations, often one that takes another's number."""
    n = F.col("o_orderkey")
    year, number = (1960 + n % 60).cast("string"), (n % 900 + 1).cast("string")
    kind = n % 4
    said = F.when(kind == 0, F.concat(F.lit("Article "), (n % 30 + 1).cast("string"), F.lit("(2) of Regulation (EU) No "), year, F.lit("/"), number, F.lit(" is to implement")))
    said = said.when(kind == 1, F.concat(F.lit("see directive "), F.substring(year, 3, 2), F.lit("/"), number, F.lit("/EC"))).when(kind == 2, F.concat(F.lit("Directive "), year, F.lit("/"), number, F.lit(" transposes;  "), F.lit("Directive "), year, F.lit("/"), number))
    return A.read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Text\n"), said.otherwise("Regulation of no number"), F.lit(" . "), F.col("o_orderpriority")).alias("content"))


@query("extract_refs", """SELECT o_orderkey, kind || ':' || y || '/' || num AS eu_document_id, kind AS type, CAST(y AS INTEGER) AS year, CAST(num AS INTEGER) AS number, community, article AS eu_article, reference_type, full_citation FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'regulation' ELSE 'directive' END AS kind, o_orderkey % 900 + 1 AS num, CASE WHEN o_orderkey % 4 = 1 AND (1960 + o_orderkey % 60) % 100 < 50 THEN 2000 + (1960 + o_orderkey % 60) % 100 WHEN o_orderkey % 4 = 1 THEN 1900 + (1960 + o_orderkey % 60) % 100 ELSE 1960 + o_orderkey % 60 END AS y,
    CASE o_orderkey % 4 WHEN 1 THEN 'EC' ELSE 'EU' END AS community, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 30 + 1) || '(2)' END AS article, CASE o_orderkey % 4 WHEN 0 THEN 'implements' ELSE 'references' END AS reference_type,
    CASE o_orderkey % 4 WHEN 0 THEN 'Regulation (EU) No ' || (1960 + o_orderkey % 60) || '/' || (o_orderkey % 900 + 1) WHEN 1 THEN 'directive ' || substr(CAST(1960 + o_orderkey % 60 AS VARCHAR), 3) || '/' || (o_orderkey % 900 + 1) || '/EC' ELSE 'Directive ' || (1960 + o_orderkey % 60) || '/' || (o_orderkey % 900 + 1) END AS full_citation
  FROM orders WHERE o_orderkey % 4 < 3)""")
def extract_refs(spark, sf):
    found = extract.eu_references(_mentions(spark, sf), "o_orderkey", "content")
    return found.select("o_orderkey", "eu_document_id", "type", "year", "number", "community", "eu_article", "reference_type", "full_citation")


@query("ref_context", f"""SELECT doc_id, {sql_spaced("right(left(text, length(text) // 2), 119) || ' Directive 2016/680 ' || left(substr(text, length(text) // 2 + 1), 119)")} AS context FROM documents""")
def ref_context(spark, sf):
    """What stands around a reference in the middle of a text."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    docs = A.read(spark, sf, "documents").select("doc_id", "text", half.alias("before"))
    said = docs.select("doc_id", F.concat(F.expr("substring(text, 1, before)"), F.lit(" Directive 2016/680 "), F.expr("substring(text, before + 1)")).alias("said"), "before")
    return said.select("doc_id", extract.context(F.col("said"), F.col("before") + 2, F.lit(18)).alias("context"))
