"""Queries of lookups, joins, aggregates and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.catalog import adapters as A
from lexmill.catalog.registry import query
from lexmill.operators import citation, dedupe, relations, reports, resolve
from lexmill.plans import ftsquery
from lexmill.schema import Store, lacking, orphans, repeated, violations
from lexmill.sources.seed import as_json, digest


def joined(c):
    return F.array_join(c, "|")


@query("scan_table", A.SQL + "SELECT id, document_id, provision_ref, chapter, section, title, content FROM prov")
def scan_table(spark, sf):
    return A.provisions(spark, sf)


@query("get_document", A.SQL + "SELECT id, title, status, url FROM doc WHERE id = 'src7'")
def get_document(spark, sf):
    return A.documents(spark, sf).where(F.col("id") == "src7").select("id", "title", "status", "url")


@query("provisions_all", A.SQL + """SELECT p.document_id, d.title AS document_title, p.provision_ref, p.chapter, p.section, p.title, p.content,
  regexp_replace(p.provision_ref, '^s', '') AS section_number, d.url FROM prov p JOIN doc d ON d.id = p.document_id WHERE d.id = 'src3' ORDER BY p.id""")
def provisions_all(spark, sf):
    return citation.get_provision(A.store(spark, sf), "Act src3").rows


@query("get_provision", A.SQL + """SELECT p.document_id, d.title AS document_title, p.provision_ref, p.chapter, p.section, p.title, p.content,
  regexp_replace(p.provision_ref, '^s', '') AS section_number, d.url FROM prov p JOIN doc d ON d.id = p.document_id
  WHERE d.id = 'src3' AND (p.section = '3' OR p.provision_ref LIKE '%3%')
  ORDER BY CASE WHEN p.provision_ref = '3' THEN 0 WHEN p.provision_ref = 's3' THEN 1 WHEN p.section = '3' THEN 2 ELSE 3 END, p.id LIMIT 1""")
def get_provision(spark, sf):
    return citation.get_provision(A.store(spark, sf), "src3", "3").rows


@query("join_inner", A.SQL + "SELECT p.id, p.provision_ref, d.title AS document_title, d.status FROM prov p JOIN doc d ON d.id = p.document_id")
def join_inner(spark, sf):
    docs = A.documents(spark, sf).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "status")
    return A.provisions(spark, sf).join(docs, "document_id").select("id", "provision_ref", "document_title", "status")


_NAMES = """names AS (SELECT DISTINCT said FROM (SELECT 'Act ' || source AS said FROM documents UNION ALL SELECT source FROM documents
  UNION ALL SELECT upper(source) FROM documents UNION ALL SELECT 'statute ' || source || ' ' FROM documents UNION ALL SELECT 'unknown ' || source FROM documents))"""


def _names(spark, sf):
    source = F.col("source")
    forms = F.array(F.concat(F.lit("Act "), source), source, F.upper(source), F.concat(F.lit("statute "), source, F.lit(" ")), F.concat(F.lit("unknown "), source))
    return A.read(spark, sf, "documents").select("source").distinct().select(F.explode(forms).alias("said")).distinct()


_RESOLVED = _NAMES + """, resolved AS (SELECT said, (SELECT arg_min(id, (tier, id)) FROM (SELECT d.id, CASE WHEN d.id = trim(said) THEN 0
    WHEN lower(d.title) LIKE '%' || lower(trim(said)) || '%' OR lower(d.short_name) LIKE '%' || lower(trim(said)) || '%' OR lower(d.title_en) LIKE '%' || lower(trim(said)) || '%' THEN 3 END AS tier FROM doc d) WHERE tier IS NOT NULL) AS document_id FROM names)"""


@query("resolver", A.SQL + ", " + _RESOLVED + " SELECT said, document_id FROM resolved")
def resolver(spark, sf):
    return resolve.resolve(A.documents(spark, sf), _names(spark, sf)).select("said", "document_id")


@query("check_currency", A.SQL + ", " + _RESOLVED + """ SELECT said, coalesce(document_id, said) AS document_id, coalesce(title, 'Unknown') AS title, coalesce(status, 'not_found') AS status, issued_date, in_force_date,
  CASE WHEN document_id IS NULL THEN 'Document not found: "' || said || '"' WHEN status = 'repealed' THEN 'This statute has been repealed and is no longer in force.'
       WHEN status = 'not_yet_in_force' THEN 'This statute has not yet entered into force.' ELSE '' END AS warnings
  FROM resolved LEFT JOIN (SELECT id, title, status, issued_date, in_force_date FROM doc) d ON d.id = document_id""")
def check_currency(spark, sf):
    return citation.check_currency(A.store(spark, sf), _names(spark, sf)).withColumn("warnings", joined("warnings"))


_CITED = """cited AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN 'Section ' || doc_id || ', Act ' || source WHEN 1 THEN 'Act ' || source || ' s. ' || doc_id
  WHEN 2 THEN source || ' Section ' || (doc_id + 1) WHEN 3 THEN 'Act ' || source ELSE 'Missing Act s ' || doc_id END AS citation FROM documents)"""


def _cited(spark, sf):
    n, s = F.col("doc_id"), F.col("source")
    text = F.when(n % 5 == 0, F.concat(F.lit("Section "), n, F.lit(", Act "), s)).when(n % 5 == 1, F.concat(F.lit("Act "), s, F.lit(" s. "), n)).when(n % 5 == 2, F.concat(s, F.lit(" Section "), n + 1)).when(n % 5 == 3, F.concat(F.lit("Act "), s)).otherwise(F.concat(F.lit("Missing Act s "), n))
    return A.read(spark, sf, "documents").select("doc_id", "source", text.alias("citation"))


# A title names the least id that contains it: `Act src1` is part of `Act src10`, but is src1's own; src1 < src10.
@query("validate_citation", A.SQL + ", " + _CITED + """, p AS (SELECT DISTINCT citation, CASE WHEN doc_id % 5 < 4 THEN source END AS document_id,
    CASE doc_id % 5 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN CAST(doc_id + 1 AS VARCHAR) WHEN 4 THEN CAST(doc_id AS VARCHAR) END AS sec FROM cited)
  SELECT citation, ok AS valid, CASE WHEN ok AND sec IS NOT NULL THEN title || ' ' || sec || '. § (Section ' || sec || ')' WHEN ok THEN title END AS normalized, document_id, title AS document_title,
    CASE WHEN ok THEN provision_ref END AS provision_ref, CASE WHEN ok THEN status END AS status,
    CASE WHEN document_id IS NULL THEN 'Document not found: "Missing Act"' ELSE CASE status WHEN 'repealed' THEN 'WARNING: This statute has been repealed.' WHEN 'amended' THEN 'Note: This statute has been amended. Verify you are referencing the current version.' ELSE '' END
      || CASE WHEN ok THEN '' ELSE (CASE WHEN status IN ('repealed', 'amended') THEN '|' ELSE '' END) || 'Provision "' || sec || '. §" not found in ' || title END END AS warnings
  FROM (SELECT p.*, d.title, d.status, v.provision_ref, p.document_id IS NOT NULL AND (sec IS NULL OR v.provision_ref IS NOT NULL) AS ok
        FROM p LEFT JOIN doc d ON d.id = p.document_id LEFT JOIN prov v ON v.document_id = p.document_id AND v.section = p.sec)""")
def validate_citation(spark, sf):
    return citation.validate_citations(A.store(spark, sf), _cited(spark, sf).select("citation").distinct()).withColumn("warnings", joined("warnings"))


@query("format_citation", A.SQL + ", " + _CITED + """ SELECT citation AS original, CASE doc_id % 5 WHEN 0 THEN 'Act ' || source || ' ' || doc_id || '. §' WHEN 1 THEN 'Act ' || source || ' ' || doc_id || '. §'
  WHEN 2 THEN source || ' ' || (doc_id + 1) || '. §' WHEN 3 THEN 'Act ' || source ELSE 'Missing Act ' || doc_id || '. §' END AS formatted FROM cited""")
def format_citation(spark, sf):
    return citation.format_citations(A.store(spark, sf), _cited(spark, sf))


@query("format_citation_pinpoint", A.SQL + ", " + _CITED + """ SELECT citation AS original, CASE doc_id % 5 WHEN 2 THEN (doc_id + 1) || '. §' WHEN 3 THEN 'Act ' || source ELSE doc_id || '. §' END AS formatted FROM cited""")
def format_citation_pinpoint(spark, sf):
    return citation.format_citations(A.store(spark, sf), _cited(spark, sf), "pinpoint")


@query("eu_basis", A.SQL + """SELECT r.eu_document_id, a.type AS eu_document_type, coalesce(a.title, a.short_name) AS eu_document_title, reference_type, count(*) AS reference_count, max(implementation_status) AS implementation_status
  FROM ref r LEFT JOIN act a ON a.id = r.eu_document_id WHERE r.document_id = 'src4' GROUP BY ALL""")
def eu_basis(spark, sf):
    return relations.eu_basis(A.store(spark, sf), "Act src4").rows


@query("eu_basis_in", A.SQL + """, arts AS (SELECT eu_document_id, string_agg(DISTINCT eu_article, '|' ORDER BY eu_article) AS articles FROM ref WHERE document_id = 'src4' AND eu_article IS NOT NULL GROUP BY 1)
  SELECT r.*, coalesce(arts.articles, '') AS articles FROM (SELECT r.eu_document_id, a.type AS eu_document_type, coalesce(a.title, a.short_name) AS eu_document_title, reference_type, count(*) AS reference_count, max(implementation_status) AS implementation_status
  FROM ref r LEFT JOIN act a ON a.id = r.eu_document_id WHERE r.document_id = 'src4' AND reference_type IN ('implements', 'cites') GROUP BY ALL) r LEFT JOIN arts USING (eu_document_id)""")
def eu_basis_in(spark, sf):
    return relations.eu_basis(A.store(spark, sf), "src4", True, ["implements", "cites"]).rows.withColumn("articles", joined("articles"))


@query("eu_articles", A.SQL + "SELECT document_id, eu_document_id, string_agg(DISTINCT eu_article, '|' ORDER BY eu_article) AS articles FROM ref WHERE eu_article IS NOT NULL GROUP BY 1, 2")
def eu_articles(spark, sf):
    return relations.articles(A.references(spark, sf), ("document_id", "eu_document_id")).withColumn("articles", joined("articles"))


@query("implementations", A.SQL + """SELECT r.eu_document_id, d.id AS document_id, d.title AS document_title, d.status, reference_type, max(implementation_status) AS implementation_status, max(is_primary_implementation) AS is_primary, count(*) AS reference_count
  FROM ref r JOIN doc d ON d.id = r.document_id GROUP BY ALL""")
def implementations(spark, sf):
    return relations.implementations(A.store(spark, sf), None).rows


@query("implementations_of_act", A.SQL + """SELECT d.id AS document_id, d.title AS document_title, d.status, reference_type, max(implementation_status) AS implementation_status, max(is_primary_implementation) AS is_primary, count(*) AS reference_count
  FROM ref r JOIN doc d ON d.id = r.document_id WHERE r.eu_document_id = 'directive:2014/95' AND is_primary_implementation = 1 AND d.status = 'in_force' GROUP BY ALL""")
def implementations_of_act(spark, sf):
    return relations.implementations(A.store(spark, sf), "directive:2014/95", True, True).rows


_SEARCHED = "SELECT a.id AS eu_document_id, a.type, a.year, a.number, a.title, a.short_name, count(DISTINCT r.document_id) AS hungarian_statute_count FROM act a LEFT JOIN ref r ON r.eu_document_id = a.id"


@query("eu_search", A.SQL + _SEARCHED + " GROUP BY ALL ORDER BY a.year DESC, a.number DESC, eu_document_id LIMIT 20")
def eu_search(spark, sf):
    return relations.eu_search(A.store(spark, sf)).rows


@query("eu_search_having", A.SQL + _SEARCHED + " GROUP BY ALL HAVING count(DISTINCT r.document_id) > 0 ORDER BY a.year DESC, a.number DESC, eu_document_id LIMIT 100")
def eu_search_having(spark, sf):
    return relations.eu_search(A.store(spark, sf), implemented=True, limit=500).rows


@query("eu_search_filters", A.SQL + _SEARCHED + " WHERE (lower(a.title) LIKE '%a%' OR lower(a.short_name) LIKE '%a%' OR lower(a.description) LIKE '%a%') AND a.type = 'directive' AND a.year >= 2000 AND a.year <= 2015 GROUP BY ALL ORDER BY a.year DESC, a.number DESC, eu_document_id LIMIT 100")
def eu_search_filters(spark, sf):
    return relations.eu_search(A.store(spark, sf), "A", "directive", 2000, 2015, limit=100).rows


@query("provision_eu_basis", A.SQL + """SELECT r.eu_document_id, a.type AS eu_document_type, coalesce(a.title, a.short_name) AS eu_document_title, r.eu_article, r.reference_type, CAST(NULL AS VARCHAR) AS reference_context, r.full_citation
  FROM ref r LEFT JOIN act a ON a.id = r.eu_document_id WHERE r.provision_id = (SELECT id FROM prov WHERE document_id = 'src5' AND section = '5')""")
def provision_eu_basis(spark, sf):
    return relations.provision_eu_basis(A.store(spark, sf), "src5", " 5 ").rows


@query("status_pivot", A.SQL + """SELECT document_id, count(*) AS total, count(*) FILTER (implementation_status = 'complete') AS complete, count(*) FILTER (implementation_status = 'partial') AS "partial",
  count(*) FILTER (implementation_status = 'pending') AS pending, count(*) FILTER (implementation_status = 'unknown') AS "unknown" FROM ref GROUP BY 1""")
def status_pivot(spark, sf):
    return relations.status_counts(A.references(spark, sf))


@query("status_groups", A.SQL + "SELECT document_id, implementation_status, count(*) AS n FROM ref GROUP BY ALL")
def status_groups(spark, sf):
    return A.references(spark, sf).groupBy("document_id", "implementation_status").agg(F.count(F.lit(1)).alias("n"))


@query("compliance", A.SQL + f""", c AS (SELECT document_id, count(*) AS found, count(*) FILTER (implementation_status = 'complete') AS co, count(*) FILTER (implementation_status = 'partial') AS pa, count(*) FILTER (implementation_status = 'unknown') AS un FROM ref GROUP BY 1),
  s AS (SELECT d.id AS document_id, d.title AS document_title, d.status, coalesce(found, 0) AS found, coalesce(co, 0) AS co, coalesce(pa, 0) AS pa, coalesce(un, 0) AS un FROM doc d LEFT JOIN c ON c.document_id = d.id),
  v AS (SELECT *, CASE WHEN found = 0 THEN 'not_applicable' WHEN co > 0 AND pa = 0 AND un = 0 THEN 'compliant' WHEN pa > 0 THEN 'partial' ELSE 'unclear' END AS state FROM s)
  SELECT document_id, document_title, state AS compliance_status, found AS eu_references_found,
    array_to_string(list_filter([CASE WHEN found > 0 AND status = 'repealed' THEN 'This statute has been repealed.' END, CASE WHEN state = 'partial' THEN pa || ' EU reference(s) have partial alignment status.' END], lambda x: x IS NOT NULL), '|') AS warnings,
    array_to_string(list_filter([CASE WHEN found = 0 THEN '{relations.NO_EDGES}' END, CASE WHEN found > 0 AND status = 'repealed' THEN 'Check for replacement legislation.' END, CASE WHEN state = 'unclear' AND un > 0 THEN un || ' EU reference(s) have unknown alignment status. Manual review recommended.' END], lambda x: x IS NOT NULL), '|') AS recommendations FROM v""")
def compliance(spark, sf):
    return relations.compliance(A.store(spark, sf)).withColumns({"warnings": joined("warnings"), "recommendations": joined("recommendations")})


@query("semi_anti", A.SQL + "SELECT id, document_id, eu_document_id, 'kept' AS outcome FROM ref WHERE document_id IN (SELECT id FROM doc WHERE status <> 'repealed') UNION ALL SELECT id, document_id, eu_document_id, 'skipped' FROM ref WHERE document_id NOT IN (SELECT id FROM doc WHERE status <> 'repealed')")
def semi_anti(spark, sf):
    refs, docs = A.references(spark, sf).select("id", "document_id", "eu_document_id"), A.documents(spark, sf).where("status <> 'repealed'")
    kept = refs.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(refs.columns)
    return kept.withColumn("outcome", F.lit("kept")).unionByName(orphans(refs, "document_id", docs).withColumn("outcome", F.lit("skipped")))


@query("check_constraints", """SELECT p_partkey AS id, year, number, violation FROM (SELECT p_partkey, CAST(1940 + p_size AS INTEGER) AS year, CAST(p_partkey - 3 AS INTEGER) AS number, unnest(list_filter([
  CASE WHEN NOT (1940 + p_size BETWEEN 1957 AND 2100) THEN 'year' END, CASE WHEN NOT (p_partkey - 3 > 0) THEN 'number' END], lambda v: v IS NOT NULL)) AS violation FROM part)""")
def check_constraints(spark, sf):
    acts = A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (1940 + F.col("p_size")).cast("int").alias("year"), (F.col("p_partkey") - 3).cast("int").alias("number"))
    return violations("eu_documents", acts)


@query("table_counts", "SELECT 'legal_documents' AS name, (SELECT count(DISTINCT source) FROM documents) AS n UNION ALL SELECT 'legal_provisions', (SELECT count(*) FROM documents) UNION ALL SELECT 'definitions', 0 UNION ALL SELECT 'eu_documents', (SELECT count(*) FROM part) UNION ALL SELECT 'eu_references', (SELECT count(*) FROM lineitem)")
def table_counts(spark, sf):
    return reports.table_counts(A.store(spark, sf), ("legal_documents", "legal_provisions", "definitions", "eu_documents", "eu_references"))


@query("about_stats", "SELECT 'legal_documents' AS name, (SELECT count(DISTINCT source) FROM documents) AS n UNION ALL SELECT 'legal_provisions', (SELECT count(*) FROM documents) UNION ALL SELECT 'definitions', 0 UNION ALL SELECT 'eu_documents', (SELECT count(*) FROM part) UNION ALL SELECT 'eu_references', (SELECT count(*) FROM lineitem)")
def about_stats(spark, sf):
    return reports.about(A.store(spark, sf))


@query("list_sources", "SELECT 'free' AS tier, '1.0' AS schema_version, '2026-01-01T00:00:00Z' AS built_at, " + ", ".join(f"'{v}' AS {k}" for k, v in reports.SOURCE.items()) + ", 'hu,en' AS languages, (SELECT count(DISTINCT source) FROM documents) AS document_count, (SELECT count(*) FROM documents) AS provision_count")
def list_sources(spark, sf):
    return reports.list_sources(A.store(spark, sf))


@query("health_counts", "SELECT (SELECT count(DISTINCT source) FROM documents) AS documents, (SELECT count(*) FROM documents) AS provisions, (SELECT count(*) > 0 FROM documents) AS ok")
def health_counts(spark, sf):
    store = A.store(spark, sf)
    n = {r["name"]: r["n"] for r in reports.table_counts(store, reports.CORE).collect()}
    return spark.createDataFrame([(n["legal_documents"], n["legal_provisions"], reports.healthy(store))], "documents long, provisions long, ok boolean")


@query("capabilities", A.SQL + """ SELECT 'legal_documents' AS name, true AS available, (SELECT count(*) FROM doc) AS rows UNION ALL SELECT 'legal_provisions', true, count(*) FROM prov
  UNION ALL SELECT 'definitions', false, 0 UNION ALL SELECT 'eu_documents', true, count(*) FROM act UNION ALL SELECT 'eu_references', true, count(*) FROM ref""")
def capabilities(spark, sf):
    """What the session's catalog has of the store's tables."""
    A.store(spark, sf).register("lexmill_")
    return reports.capabilities(Store.of_catalog(spark, "lexmill_"))


@query("kv_pivot", "SELECT coalesce(max(p_name) FILTER (p_partkey % 50 = 0), 'free') AS tier, coalesce(max(p_name) FILTER (p_partkey < 0), '1.0') AS schema_version, max(p_name) FILTER (p_partkey % 50 = 2) AS built_at FROM part")
def kv_pivot(spark, sf):
    n = F.col("p_partkey")
    key = F.when(n % 50 == 0, "tier").when(n < 0, "schema_version").when(n % 50 == 2, "built_at")
    return reports.metadata(A.read(spark, sf, "part").select(key.alias("key"), F.col("p_name").alias("value")))


@query("freshness", """SELECT o_orderkey, age, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN age IS NULL OR age > 90 OR o_custkey < 50 THEN 1 ELSE 0 END AS verdict
  FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '1998-08-02 00:00:00' - CAST(o_orderdate AS TIMESTAMP)) / 86400) AS BIGINT) AS age FROM orders)""")
def freshness(spark, sf):
    from lexmill.functions.text import age_days

    orders = A.read(spark, sf, "orders").withColumn("age", age_days(F.col("o_orderdate").cast("string"), F.lit("1998-08-02 00:00:00").cast("timestamp")))
    short = F.when(F.col("o_custkey") < 50, 1).otherwise(0)
    return orders.select("o_orderkey", "age", reports.freshness(F.col("age"), F.col("o_orderstatus") == "F", -short, F.lit(0), F.lit(0), F.lit(0)).alias("verdict"))


@query("ingest_report", A.SQL + "SELECT status, count(*) AS n FROM prov p JOIN doc d ON d.id = p.document_id GROUP BY 1")
def ingest_report(spark, sf):
    docs = A.documents(spark, sf).select(F.col("id").alias("document_id"), "status")
    counts = A.provisions(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(docs, "document_id").groupBy("status").agg(F.sum("n").alias("n"))


@query("fingerprint_sha2", "SELECT doc_id, substr(sha256(text), 1, 12) AS digest FROM documents")
def fingerprint_sha2(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", digest(F.col("text")).alias("digest"))


@query("to_json_rows", "SELECT to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'n_chars': n_chars}) AS json FROM documents")
def to_json_rows(spark, sf):
    return as_json(A.read(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"))


@query("prompt_template", "SELECT doc_id, 'Review the law of ' || coalesce(nullif(lang, ''), 'all areas') || ' on ' || CASE WHEN doc_id % 3 = 0 THEN 'all areas' WHEN text = '' THEN 'all areas' ELSE text END || '.' AS prompt FROM documents")
def prompt_template(spark, sf):
    area = F.when(F.col("doc_id") % 3 > 0, F.col("text"))
    return A.read(spark, sf, "documents").select("doc_id", reports.prompts("Review the law of {country} on {area}.", country=F.col("lang"), area=area).alias("prompt"))


@query("clamp", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE least(greatest(o_custkey - 20, 1), 50) END AS BIGINT) AS n FROM orders")
def clamp(spark, sf):
    limit = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") - 20)
    return A.read(spark, sf, "orders").select("o_orderkey", ftsquery.clamped(limit, 10, 50).alias("n"))


# Keeping one of several ------------------------------------------------------------------------------------------------


@query("dedupe_longest", """SELECT document_id, provision_ref, content, pos FROM (SELECT source AS document_id, trim(lang) AS provision_ref, text AS content, row_number() OVER w AS rn, min(doc_id) OVER (PARTITION BY source, lang) AS pos FROM documents
  WINDOW w AS (PARTITION BY source, lang ORDER BY length(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) DESC, doc_id)) WHERE rn = 1""")
def dedupe_longest(spark, sf):
    rows = A.read(spark, sf, "documents").select(F.col("source").alias("document_id"), F.concat(F.lit(" "), "lang").alias("provision_ref"), F.col("text").alias("content"), F.col("doc_id").alias("pos"))
    return dedupe.keep_longest(rows, ("document_id", "provision_ref"), "content", "pos")


@query("dedupe_first", "SELECT doc_id, source, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_first(spark, sf):
    return dedupe.keep_first(A.read(spark, sf, "documents").select("doc_id", "source", "lang", "text"), ("text",), "doc_id")


@query("unique_null_distinct", A.SQL + "SELECT id, document_id, eu_document_id, eu_article FROM (SELECT *, row_number() OVER (PARTITION BY document_id, eu_document_id, eu_article ORDER BY id) AS rn FROM ref) WHERE rn = 1 OR eu_article IS NULL")
def unique_null_distinct(spark, sf):
    return dedupe.unique_unless_null(A.references(spark, sf).select("id", "document_id", "eu_document_id", "eu_article"), ("document_id", "eu_document_id"), "eu_article", "id")


@query("primary_impl", A.SQL + """SELECT id, document_id, eu_document_id, reference_type, CASE WHEN first THEN 1 ELSE 0 END AS is_primary_implementation, CASE WHEN first THEN 'complete' ELSE 'unknown' END AS implementation_status
  FROM (SELECT *, reference_type = 'implements' AND id = min(id) FILTER (reference_type = 'implements') OVER (PARTITION BY document_id, eu_document_id) AS first FROM ref)""")
def primary_impl(spark, sf):
    refs = A.references(spark, sf).select("id", "document_id", "eu_document_id", "reference_type")
    return dedupe.mark_primary(refs, "id").select("id", "document_id", "eu_document_id", "reference_type", "is_primary_implementation", "implementation_status")


@query("override_union", """WITH found AS (SELECT p_partkey AS position, CAST(p_partkey % 3000 AS VARCHAR) AS document_id, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN '2001-01-01' END AS day, 'https://x/' || p_partkey AS url FROM part),
own AS (SELECT s_suppkey AS position, CASE s_suppkey % 10 WHEN 0 THEN 'sub-' || s_suppkey % 20 ELSE 'act-' || s_suppkey % 40 END AS id, CASE WHEN s_suppkey % 4 > 0 OR s_suppkey % 10 = 0 THEN CAST(s_suppkey // 2 AS VARCHAR) END AS document_id, s_name AS title, CAST(s_suppkey AS VARCHAR) AS day FROM supplier),
whole AS (SELECT document_id, arg_min(id, position) AS id, arg_min(title, position) AS title, arg_min(day, position) AS day FROM own WHERE document_id IS NOT NULL AND NOT starts_with(id, 'sub-') GROUP BY 1),
every AS (SELECT coalesce(w.id, 'hu-law-' || f.document_id) AS id, CASE WHEN w.id IS NULL THEN f.title ELSE w.title END AS title, 'in_force' AS status, coalesce(f.day, w.day) AS in_force_date, url,
    CASE WHEN w.id IS NULL THEN 'Official Hungarian statute text from Nemzeti Jogszabalytar (njt.hu).' ELSE 'curated' END AS description, 0 AS later, position FROM found f LEFT JOIN whole w USING (document_id)
  UNION ALL SELECT id, title, 'amended', day, NULL, 'curated', 1, position FROM own WHERE starts_with(id, 'sub-'))
SELECT id, title, status, in_force_date, url, description FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY later, position) AS turn FROM every) WHERE turn = 1""")
def override_union(spark, sf):
    none = F.lit(None).cast("string")
    key, n = F.col("p_partkey"), F.col("s_suppkey")
    found = A.read(spark, sf, "part").select(
        key.alias("position"), (key % 3000).cast("string").alias("document_id"), F.col("p_name").alias("title"), none.alias("title_en"), F.lit("in_force").alias("status"), none.alias("issued_date"),
        F.when(key % 3 > 0, "2001-01-01").alias("in_force_date"), F.concat(F.lit("https://x/"), key.cast("string")).alias("url"), none.alias("description"),
    )
    name = F.when(n % 10 == 0, F.concat(F.lit("sub-"), (n % 20).cast("string"))).otherwise(F.concat(F.lit("act-"), (n % 40).cast("string")))
    curated = A.read(spark, sf, "supplier").select(
        n.alias("position"), name.alias("id"), F.when((n % 4 > 0) | (n % 10 == 0), F.floor(n / 2).cast("string")).alias("document_id"), F.col("s_name").alias("title"), none.alias("title_en"), none.alias("short_name"), F.lit("amended").alias("status"),
        none.alias("issued_date"), n.cast("string").alias("in_force_date"), none.alias("url"), F.lit("curated").alias("description"),
    )
    return dedupe.full_corpus(found, curated, ("sub-0", "sub-10")).select("id", "title", "status", "in_force_date", "url", "description")


@query("key_violations", """SELECT 'id' AS key, CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
  UNION ALL SELECT 'document_id, provision_ref', l_suppkey || '|' || CASE WHEN l_linenumber > 1 THEN l_partkey END, count(*) FROM lineitem WHERE l_linenumber > 1 GROUP BY l_suppkey, l_linenumber > 1, l_partkey HAVING count(*) > 1""")
def key_violations(spark, sf):
    rows = A.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("document_id"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey").cast("string")).alias("provision_ref"))
    return repeated("legal_provisions", rows)


@query("null_violations", """SELECT id, lacks FROM (SELECT doc_id AS id, unnest(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'document_id' END, CASE WHEN lang = 'en' THEN 'section' END], lambda v: v IS NOT NULL)) AS lacks FROM documents)""")
def null_violations(spark, sf):
    docs = A.read(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("document_id"), F.lit("s").alias("provision_ref"), F.when(F.col("lang") != "en", F.col("lang")).alias("section"), F.coalesce("text", F.lit("")).alias("content"))
    return lacking("legal_provisions", rows).select("id", "lacks")


@query("store_missing_tables", "SELECT 'EU references not available in this database tier' AS note, 0 AS n")
def store_missing_tables(spark, sf):
    bare = Store(spark, {"legal_documents": A.documents(spark, sf)})
    answer = relations.eu_basis(bare, "src1")
    return answer.rows.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(answer.note).alias("note"), "n")
