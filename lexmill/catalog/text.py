"""Queries of text and identity functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.catalog import adapters as A
from lexmill.catalog.registry import query
from lexmill.functions import text as X
from lexmill.operators import citation, relations

_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_spaced(e: str) -> str:
    return f"trim(regexp_replace({e}, '{_WS}+', ' ', 'g'))"


def sql_named(e: str) -> str:
    for entity, said in X.NAMED_ENTITIES:
        e = f"replace({e}, '{entity}', '{said.replace(chr(39), chr(39) * 2)}')"
    return e


def sql_normalized(e: str) -> str:
    e = f"regexp_replace(regexp_replace({e}, '{_WS}+', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g')"
    return f"trim(regexp_replace(regexp_replace({e}, '\\( +', '(', 'g'), ' +\\)', ')', 'g'))"


def sql_html(e: str) -> str:
    e = f"regexp_replace({e}, '(?i)<sup[^>]*class=\"fnSup\"[^>]*>[\\s\\S]*?</sup>', '', 'g')"
    e = f"regexp_replace({e}, '(?i)<br\\s*/?>', chr(10), 'g')"
    e = f"regexp_replace({e}, '(?i)</?(?:p|div|li|ul|ol|tr|td|th|table|tbody|thead|tfoot|h[1-6])[^>]*>', chr(10), 'g')"
    return sql_normalized(sql_named(f"regexp_replace({e}, '<[^>]+>', '', 'g')"))


def pages(spark, sf):
    return A.read(spark, sf, "pages")


@query("scan_html", "SELECT page_id, length(html) AS n, contains(html, '<title>') AS titled FROM pages")
def scan_html(spark, sf):
    return pages(spark, sf).select("page_id", F.char_length("html").cast("long").alias("n"), F.contains("html", F.lit("<title>")).alias("titled"))


@query("html_entities_named", f"SELECT page_id, {sql_named('html')} AS text FROM pages")
def html_entities_named(spark, sf):
    return pages(spark, sf).select("page_id", X.decode_entities(F.col("html")).alias("text"))


@query("html_entities_numeric", "SELECT p_partkey, chr(CAST(p_partkey % 40000 + 33 AS INTEGER)) || '-' || chr(CAST(p_size + 336 AS INTEGER)) AS text FROM part")
def html_entities_numeric(spark, sf):
    written = F.concat(F.lit("&#"), (F.col("p_partkey") % 40000 + 33).cast("string"), F.lit(";&ndash;&#x"), F.hex(F.col("p_size") + 336), F.lit(";"))
    return A.read(spark, sf, "part").select("p_partkey", X.decode_entities(written).alias("text"))


@query("normalize_text", f"SELECT doc_id, {sql_normalized('text')} AS text FROM documents")
def normalize_text(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))


@query("html_to_text", f"SELECT page_id, {sql_html('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return pages(spark, sf).select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("html_to_text_spaced", f"SELECT page_id, {sql_spaced(sql_named(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')'])))} AS text FROM pages")
def html_to_text_spaced(spark, sf):
    return pages(spark, sf).select("page_id", X.html_to_text_spaced(F.col("html")).alias("text"))


@query("section_from_marker", "SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '/A' ELSE '' END AS section FROM part")
def section_from_marker(spark, sf):
    marker = F.concat(F.lit("<b> "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "/A").otherwise(""), F.lit(" </b>.&nbsp;§ "))
    return A.read(spark, sf, "part").select("p_partkey", X.section_from_marker(marker).alias("section"))


@query("section_key_roundtrip", """SELECT p_partkey, section, key, CASE WHEN p_partkey % 3 = 2 THEN key ELSE section END AS back, 's' || lower(key) AS ref, 'ART_' || key AS article,
  section || '. §' AS title, key AS from_id, section AS from_text, CAST(p_size AS VARCHAR) AS from_article FROM (SELECT p_partkey, p_size,
  p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/B' ELSE 'C' END AS section, p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'B' ELSE 'C' END AS key FROM part)""")
def section_key_roundtrip(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    section = F.concat(size, F.when(kind == 0, "").when(kind == 1, "/B").otherwise("C"))
    plain = F.regexp_replace(section, "/", "")
    each = A.read(spark, sf, "part").select("p_partkey", section.alias("section"), X.section_to_key(section).alias("key"), size.alias("size"), plain.alias("plain"))
    back = F.when(F.col("p_partkey") % 3 == 2, F.col("key")).otherwise(X.section_from_key(F.col("key")))
    return each.select(
        "p_partkey", "section", "key", back.alias("back"), X.provision_ref(F.col("section")).alias("ref"), X.article_key(F.col("section")).alias("article"), X.title_from_key(F.col("key"), F.col("section")).alias("title"),
        X.key_from_block_id(F.concat(F.lit("SZ"), "plain", F.lit("@x"))).alias("from_id"), X.section_from_text(F.concat("section", F.lit(" . § text"))).alias("from_text"), X.article_from_text(F.concat("size", F.lit(". czikk"))).alias("from_article"),
    )


@query("provision_ref", "SELECT doc_id, 's' || lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS ref, lang AS number FROM documents")
def provision_ref(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", X.provision_ref(F.col("text")).alias("ref"), X.section_number(F.concat(F.lit("s"), "lang")).alias("number"))


_TENS, _ONES = ("", "X", "XX", "XXX", "XL", "L"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")


def _roman(c):
    pick = lambda words, i: F.element_at(F.array(*(F.lit(w) for w in words)), (i + 1).cast("int"))
    return F.concat(pick(_TENS, F.floor(c / 10)), pick(_ONES, c % 10))


@query("roman_to_arabic", "SELECT p_partkey, CAST(p_size AS INTEGER) AS n FROM part")
def roman_to_arabic(spark, sf):
    return A.read(spark, sf, "part").select("p_partkey", X.roman_to_arabic(_roman(F.col("p_size"))).alias("n"))


@query("formal_ref_to_id", "SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN 'hu-law-' || (1950 + p_partkey % 70) || '-' || p_size || '-00-00' END AS id FROM part")
def formal_ref_to_id(spark, sf):
    said = F.concat(F.lit("see "), (1950 + F.col("p_partkey") % 70).cast("string"), F.lit(". ÉVI "), F.lower(_roman(F.col("p_size"))), F.when(F.col("p_partkey") % 7 > 0, ". törvény").otherwise(". rendelet"))
    return A.read(spark, sf, "part").select("p_partkey", X.formal_ref_to_id(said).alias("id"))


@query("id_prefix", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'hu-law-' || (1950 + p_partkey % 70) || '-' || p_size || '-00-00' END AS id FROM part")
def id_prefix(spark, sf):
    said = F.concat(F.when(F.col("p_partkey") % 5 > 0, "hu-law-").otherwise("HU-law-"), (1950 + F.col("p_partkey") % 70).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit("-00-00 and more"))
    return A.read(spark, sf, "part").select("p_partkey", X.id_prefix(said).alias("id"))


@query("parse_citation", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN y || '. évi X. törvény' WHEN 1 THEN y || '. évi X. törvény' WHEN 2 THEN 'hu-law-2012-1-00-00' WHEN 3 THEN 'hu-law-2013-5-00-00'
    WHEN 4 THEN 'Act ' || y WHEN 5 THEN 'Act ' || y WHEN 6 THEN 'Act ' || y WHEN 7 THEN 'Act ' || y || ' as amended' END AS document,
  CASE p_partkey % 9 WHEN 0 THEN n || '/A' WHEN 2 THEN '6:' || n WHEN 4 THEN n || 'a(2)' WHEN 5 THEN n WHEN 6 THEN n || 'b' END AS section FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, CAST(1950 + p_partkey % 70 AS VARCHAR) AS y FROM part)""")
def parse_citation(spark, sf):
    n, y, k = F.col("p_size").cast("string"), (1950 + F.col("p_partkey") % 70).cast("string"), F.col("p_partkey") % 9
    forms = (
        F.concat(y, F.lit(". évi X. törvény "), n, F.lit("/A. § (2)")), F.concat(F.lit(" "), y, F.lit(". évi X. törvény ")), F.concat(F.lit("hu-law-2012-1-00-00 s6:"), n), F.lit("hu-law-2013-5-00-00"),
        F.concat(F.lit("section "), n, F.lit("a(2), Act "), y), F.concat(F.lit("Act "), y, F.lit(", s. "), n), F.concat(F.lit("Act "), y, F.lit("; Section "), n, F.lit("b")), F.concat(F.lit("Act "), y, F.lit(" as amended")), F.lit("  "),
    )
    said = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return A.read(spark, sf, "part").select("p_partkey", citation.parsed(said).alias("c")).select("p_partkey", "c.document", "c.section")




#: A star stays at a word's end; of several there, the last.
_BARE = "regexp_replace(q, '[''\"(){}\\[\\]^~:]', ' ', 'g')"
_PLAIN_Q = f"regexp_replace(regexp_replace({_BARE}, '\\*+([^*{_WS[1:]})', ' \\1', 'g'), '\\*\\*+', ' *', 'g')"


@query("sanitize_query", f"""SELECT doc_id, CASE WHEN regexp_matches(q, '\\b(AND|OR|NOT)\\b') THEN {sql_spaced("regexp_replace(q, '[{}\\[\\]^~*:]', ' ', 'g')")} ELSE {sql_spaced(_PLAIN_Q)} END AS cleaned
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '("x" AND {{y}}) OR ' ELSE '["a: b' END || CASE WHEN doc_id % 3 = 1 THEN '*c **d e** f* ***' ELSE '' END || text AS q FROM documents)""")
def sanitize_query(spark, sf):
    n = F.col("doc_id") % 3
    q = F.concat(F.when(n == 0, '("x" AND {y}) OR ').otherwise('["a: b'), F.when(n == 1, "*c **d e** f* ***").otherwise(""), "text")
    return A.read(spark, sf, "documents").select("doc_id", X.sanitized(q).alias("cleaned"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(lower(w), '{s}') AND length(w) - {len(s)} >= 3 THEN left(lower(w), -{len(s)})" for s in X.SUFFIXES) + " END"


@query("stem_suffix", f"SELECT w AS word, CASE WHEN length(w) >= 5 THEN {_STEM} END AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1, 2")
def stem_suffix(spark, sf):
    words = A.read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", X.stem(F.col("word")).alias("stem"), "n")


@query("like_pattern", f"SELECT page_id, CASE WHEN t = '' THEN '%' ELSE '%' || replace(t, ' ', '%') || '%' END AS pattern FROM (SELECT page_id, {sql_spaced('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')} AS t FROM pages)")
def like_pattern(spark, sf):
    return pages(spark, sf).select("page_id", X.like_pattern(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("pattern"))


@query("like_ascii_ci", "SELECT doc_id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the a_d%on%'")
def like_ascii_ci(spark, sf):
    return A.read(spark, sf, "documents").where(X.like_ascii(F.col("text"), "%The a_d%ON%")).select("doc_id")


@query("url_segment", "SELECT page_id, nullif(split_part(split_part(split_part(split_part(url, '://', 2), '/', 3), '?', 1), '#', 1), '') AS segment FROM pages")
def url_segment(spark, sf):
    law = F.regexp_replace("url", r"^[a-z]+://[^/]*/[^/]*/?", "https://x/jogszabaly/")
    return pages(spark, sf).select("page_id", X.url_segment(law).alias("segment"))


@query("date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_parse(spark, sf):
    said = F.when(F.col("o_orderkey") % 4 > 0, F.date_format("o_orderdate", "yyyy. MM. dd.")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return A.read(spark, sf, "orders").select("o_orderkey", X.iso_date(said).alias("day"))


@query("age_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(epoch(TIMESTAMP '1999-01-01 12:00:00' - CAST(o_orderdate AS TIMESTAMP)) / 86400) AS BIGINT) END AS age FROM orders")
def age_days(spark, sf):
    iso = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no date")
    return A.read(spark, sf, "orders").select("o_orderkey", X.age_days(iso, F.lit("1999-01-01 12:00:00").cast("timestamp")).alias("age"))


@query("status_case", "SELECT event_id, CASE event_type WHEN 'click' THEN 'in_force' WHEN 'view' THEN 'not_yet_in_force' WHEN 'error' THEN 'repealed' ELSE 'amended' END AS status FROM events")
def status_case(spark, sf):
    css = F.when(F.col("event_type") == "click", "law Now").when(F.col("event_type") == "view", "law future").when(F.col("event_type") == "error", "past").otherwise("law")
    return A.read(spark, sf, "events").select("event_id", X.status_of_class(css).alias("status"))


@query("int_or_default", "SELECT page_id, CASE WHEN regexp_extract(url, '([0-9]+)', 1) = '' OR CAST(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) = 0 THEN 1 ELSE CAST(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) END AS pages FROM pages")
def int_or_default(spark, sf):
    return pages(spark, sf).select("page_id", X.positive_or(F.col("url"), 1).alias("pages"))


@query("uuid_check", "SELECT doc_id, doc_id % 2 = 0 AS ok FROM documents")
def uuid_check(spark, sf):
    h = F.md5(F.col("text").cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    made = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.when(F.col("doc_id") % 2 == 0, "4").otherwise("3"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    return A.read(spark, sf, "documents").select("doc_id", X.is_uuid(made).alias("ok"))


@query("eu_titles", A.SQL + "SELECT id, coalesce(title, short_name) AS title FROM act")
def eu_titles(spark, sf):
    return A.acts(spark, sf).select("id", relations.act_title().alias("title"))
