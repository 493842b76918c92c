"""Citations: parsing, validation, formatting, lookup of provisions and currency of statutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.resolve import resolve, resolve_one
from lexmill.schema import Answer, Store

_S = X.SPACES
_FORMAL = rf"\d{{4}}\.{_S}*évi{_S}+[IVXLCDM]+\.{_S}*törvény"
_NUMBER = r"\d+(?::\d+)?(?:/[A-Za-z])?"
_ID = r"hu-law-\d{4}-\d+-\d{2}-\d{2}"
_WORD_SECTION = r"\d+[A-Za-z]*(?:\(\d+\))?"
#: Patterns in the order in which they are tried, with the groups of the document and of the section.
PATTERNS = (
    (rf"(?iu)^({_FORMAL}){_S}+({_NUMBER})\.{_S}*§", 1, 2),
    (rf"(?iu)^({_FORMAL})\z", 1, None),
    (rf"(?i)^({_ID}){_S}+s?({_NUMBER})\z", 1, 2),
    (rf"^({_ID})\z", 1, None),
    (rf"(?i)^Section{_S}+({_WORD_SECTION}){_S}*[,;]?{_S}+(.+)\z", 2, 1),
    (rf"(?i)^(.+?){_S}*[,;]?{_S}+s\.?{_S}+({_WORD_SECTION})\z", 1, 2),
    (rf"(?i)^(.+?){_S}*[,;]?{_S}+(?:s\.?{_S}+|Section{_S}+)({_WORD_SECTION})\z", 1, 2),
)


def parsed(c: Column) -> Column:
    """A struct of document and section (null without one); null for a blank citation.

    The trimmed citation is bound once, and its patterns are tried in turn, outside generated code, which seven of them with
    their groups would make too large.
    """

    def read(said: Column) -> Column:
        out = F.struct(said.alias("document"), F.lit(None).cast("string").alias("section"))
        for pattern, doc, section in reversed(PATTERNS):
            found = F.struct(F.trim(F.regexp_extract(said, pattern, doc)).alias("document"), (F.regexp_extract(said, pattern, section) if section else F.lit(None).cast("string")).alias("section"))
            out = F.when(said.rlike(pattern), found).otherwise(out)
        return F.when(said != "", out)

    return F.element_at(F.transform(F.array(_trimmed(c)), read), 1)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_S}+|{_S}+\z", "")


def lookup_rank(ref: Column, provision_ref: Column, section: Column) -> Column:
    """How a provision answers to a reference: exact, with its s, by section, by parts; null if not at all."""
    part = F.concat(F.lit("%"), X.ascii_lower(ref), F.lit("%"))
    inside = lambda c: F.like(X.ascii_lower(c), part, F.lit("\x01"))
    return F.when(provision_ref == ref, 0).when(provision_ref == F.concat(F.lit("s"), ref), 1).when(section == ref, 2).when(inside(provision_ref), 3).when(inside(section), 4)


def get_provision(store: Store, document: str, ref: str | None = None) -> Answer:
    """A document's provision by reference, or all in their order."""
    docs, provisions = store["legal_documents"], store["legal_provisions"]
    resolved = resolve_one(docs, document)
    note = None if resolved is not None else f'No document found matching "{document}"'
    own = provisions.where(F.col("document_id") == resolved) if resolved is not None else provisions.where("false")
    if ref and ref.strip():
        rank = lookup_rank(F.lit(ref.strip()), F.col("provision_ref"), F.col("section"))
        own = own.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1)
        if resolved is not None and not own.count():
            note = f'Provision "{ref}" not found in document "{resolved}"'
    named = own.join(docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "url"), "document_id")
    return Answer(named.orderBy("id").select("document_id", "document_title", "provision_ref", "chapter", "section", "title", "content", X.section_number(F.col("provision_ref")).alias("section_number"), "url"), note)


def status_warnings(status: Column) -> Column:
    return F.when(status == "repealed", F.array(F.lit("WARNING: This statute has been repealed."))).when(status == "amended", F.array(F.lit("Note: This statute has been amended. Verify you are referencing the current version."))).otherwise(F.array().cast("array<string>"))


def validate_citations(store: Store, citations: DataFrame) -> DataFrame:
    """citation, valid, normalized, document_id, document_title, provision_ref, status, warnings for a table of citations."""
    docs = store["legal_documents"].select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "status")
    each = citations.select("citation").withColumn("_p", parsed(F.col("citation"))).select("citation", F.col("_p.document").alias("said"), F.col("_p.section").alias("_section"))
    named = resolve(store["legal_documents"], each).join(docs, "document_id", "left")
    bare = F.regexp_replace(F.col("_section"), "^([^:]*):", "$1")
    refs = named.where("_section is not null and document_id is not null").select("document_id", "_section", F.explode(F.array_distinct(F.array(F.col("_section"), F.concat(F.lit("s"), "_section"), F.concat(F.lit("s"), bare), bare))).alias("_key")).distinct()
    provisions = store["legal_provisions"].select("id", "document_id", "provision_ref", "section")
    by_ref = refs.join(provisions.withColumn("_key", F.col("provision_ref")), ["document_id", "_key"])
    by_section = refs.where(~F.col("_key").startswith("s")).join(provisions.withColumn("_key", F.col("section")), ["document_id", "_key"])
    found = by_ref.unionByName(by_section).groupBy("document_id", "_section").agg(F.min_by("provision_ref", "id").alias("provision_ref"))
    full = named.join(found, ["document_id", "_section"], "left")
    known, wants = F.col("document_id").isNotNull(), F.col("_section").isNotNull()
    met = known & (~wants | F.col("provision_ref").isNotNull())
    note = F.when(F.col("said").isNull(), F.array(F.lit("Could not parse citation format"))).when(~known, F.array(F.concat(F.lit('Document not found: "'), "said", F.lit('"'))))
    missing = F.array(F.concat(F.lit('Provision "'), "_section", F.lit('. §" not found in '), "document_title"))
    status = status_warnings(F.col("status"))
    return full.select(
        "citation",
        met.alias("valid"),
        F.when(met & wants, F.concat("document_title", F.lit(" "), "_section", F.lit(". § (Section "), "_section", F.lit(")"))).when(met, F.col("document_title")).alias("normalized"),
        "document_id",
        "document_title",
        F.when(met, F.col("provision_ref")).alias("provision_ref"),
        F.when(met, F.col("status")).alias("status"),
        F.coalesce(note, F.when(met, status).otherwise(F.concat(status, missing))).alias("warnings"),
    )


def format_citations(store: Store, citations: DataFrame, style: str = "full") -> DataFrame:
    """original, formatted. `pinpoint` shows the section alone; other styles the act and the section."""
    formal = rf"(?iu)^(\d{{4}})\.{_S}*évi{_S}+([IVXLCDM]+)\.{_S}*törvény(?:{_S}+({_NUMBER})\.{_S}*§)?"
    by_id = rf"(?i)^({_ID}){_S}+s(\d+[A-Za-z]*(?:/[A-Za-z])?)\z"
    first, last = PATTERNS[4][0], PATTERNS[6][0]

    def read(said: Column) -> Column:
        g = lambda pattern, i: F.regexp_extract(said, pattern, i)
        one = lambda kind, act, section: F.struct(F.lit(kind).alias("kind"), act.alias("act"), section.alias("section"))
        formal_name = F.concat(g(formal, 1), F.lit(". évi "), g(formal, 2), F.lit(". törvény"))
        out = F.when(said.rlike(formal), one("formal", formal_name, F.nullif(g(formal, 3), F.lit(""))))
        out = out.when(said.rlike(by_id), one("id", g(by_id, 1), g(by_id, 2))).when(said.rlike(first), one("first", g(first, 2), g(first, 1)))
        return out.when(said.rlike(last), one("last", g(last, 1), g(last, 2))).otherwise(one("plain", said, F.lit(None).cast("string")))

    # As in parsed.
    each = citations.select("citation", F.element_at(F.transform(F.array(_trimmed(F.col("citation"))), read), 1).alias("_c")).select("citation", "_c.*")
    formal_acts = resolve(store["legal_documents"], each.where("kind = 'formal'").select(F.col("act").alias("said")).distinct()).where("document_id is not null")
    ids = each.where("kind = 'id'").select(F.col("act").alias("said")).distinct().withColumn("document_id", F.col("said"))
    titles = formal_acts.unionByName(ids.select(formal_acts.columns)).join(store["legal_documents"].select(F.col("id").alias("document_id"), "title"), "document_id").select(F.col("said").alias("act"), "title")
    name = F.coalesce(F.when(F.col("kind").isin("formal", "id"), F.col("title")), F.col("act"))
    mark = F.concat("section", F.lit(". §"))
    return each.join(titles, "act", "left").select(F.col("citation").alias("original"), F.when(F.col("section").isNull(), name).otherwise(mark if style == "pinpoint" else F.concat(name, F.lit(" "), mark)).alias("formatted"))


def check_currency(store: Store, names: DataFrame) -> DataFrame:
    """document_id, title, status, issued_date, in_force_date, warnings for a table of names (column said)."""
    docs = store["legal_documents"].select(F.col("id").alias("document_id"), "title", "status", "issued_date", "in_force_date")
    found = resolve(store["legal_documents"], names).join(docs, "document_id", "left")
    known = F.col("document_id").isNotNull()
    warning = F.when(~known, F.concat(F.lit('Document not found: "'), "said", F.lit('"'))).when(F.col("status") == "repealed", "This statute has been repealed and is no longer in force.").when(F.col("status") == "not_yet_in_force", "This statute has not yet entered into force.")
    return found.select("said", F.coalesce("document_id", "said").alias("document_id"), F.coalesce("title", F.when(~known, "Unknown")).alias("title"), F.when(known, F.col("status")).otherwise("not_found").alias("status"), "issued_date", "in_force_date", F.array_compact(F.array(warning)).alias("warnings"))
