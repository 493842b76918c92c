"""Edges between statutes and supranational acts: joins, counts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.resolve import resolve_one
from lexmill.plans.ftsquery import clamp
from lexmill.schema import EU_NOTE, Answer, Store

#: What is said where there are no edges.
NO_EDGES = "No EU cross-references found for this Hungarian statute. Hungary is an EU Member State; EU references indicate transposition obligations."


def act_title() -> Column:
    """What an act is called: its title, else its short name."""
    return F.coalesce("title", "short_name")


def _acts(store: Store) -> DataFrame:
    return store["eu_documents"].select(F.col("id").alias("eu_document_id"), F.col("type").alias("eu_document_type"), act_title().alias("eu_document_title"))


def basis(refs: DataFrame, acts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges by act and kind: counts come before the join, which then meets one row a group."""
    counts = refs.groupBy(*keys, "eu_document_id", "reference_type").agg(F.count(F.lit(1)).alias("reference_count"), F.max("implementation_status").alias("implementation_status"))
    return counts.join(acts, "eu_document_id", "left").select(*keys, "eu_document_id", "eu_document_type", "eu_document_title", "reference_type", "reference_count", "implementation_status")


def articles(refs: DataFrame, keys: tuple[str, ...] = ("eu_document_id",)) -> DataFrame:
    """The distinct articles that edges name, sorted."""
    return refs.where("eu_article is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("eu_article")).alias("articles"))


def eu_basis(store: Store, document: str, include_articles: bool = False, kinds: list[str] | None = None) -> Answer:
    resolved = resolve_one(store["legal_documents"], document)
    if resolved is not None and not store.has("eu_references"):
        return Answer(basis(store["eu_references"], _acts(store)), EU_NOTE.format("references"))
    refs = store["eu_references"].where(F.col("document_id") == (resolved or "")) if resolved else store["eu_references"].where("false")
    rows = basis(refs.where(F.col("reference_type").isin(*kinds)) if kinds else refs, _acts(store))
    if include_articles:
        rows = rows.join(articles(refs), "eu_document_id", "left").withColumn("articles", F.coalesce("articles", F.array().cast("array<string>")))
    return Answer(rows.orderBy(F.desc("reference_count"), "eu_document_id", "reference_type"))


def implementations(store: Store, eu_document_id: str | None, primary_only: bool = False, in_force_only: bool = False) -> Answer:
    """Statutes with edges to an act (to any act: None, one group more), by kind."""
    keys = [] if eu_document_id is not None else ["eu_document_id"]
    refs = store["eu_references"]
    if eu_document_id is not None:
        refs = refs.where(F.col("eu_document_id") == eu_document_id)
    if primary_only:
        refs = refs.where("is_primary_implementation = 1")
    counts = refs.groupBy(*keys, "document_id", "reference_type").agg(F.max("implementation_status").alias("implementation_status"), F.max("is_primary_implementation").alias("is_primary"), F.count(F.lit(1)).alias("reference_count"))
    docs = store["legal_documents"].select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "status")
    if in_force_only:
        docs = docs.where("status = 'in_force'")
    rows = counts.join(docs, "document_id").select(*keys, "document_id", "document_title", "status", "reference_type", "implementation_status", "is_primary", "reference_count")
    note = None if store.has("eu_references") else EU_NOTE.format("references")
    return Answer(rows.orderBy(F.desc("is_primary"), F.desc("reference_count"), *keys, "document_id", "reference_type"), note)


def eu_search(store: Store, query: str | None = None, kind: str | None = None, year_from: int | None = None, year_to: int | None = None, implemented: bool = False, limit: int | None = None) -> Answer:
    acts = store["eu_documents"]
    if query:
        acts = acts.where(F.coalesce(X.like_ascii(F.col("title"), f"%{query}%"), F.lit(False)) | F.coalesce(X.like_ascii(F.col("short_name"), f"%{query}%"), F.lit(False)) | F.coalesce(X.like_ascii(F.col("description"), f"%{query}%"), F.lit(False)))
    if kind:
        acts = acts.where(F.col("type") == kind)
    if year_from:
        acts = acts.where(F.col("year") >= year_from)
    if year_to:
        acts = acts.where(F.col("year") <= year_to)
    counts = store["eu_references"].groupBy(F.col("eu_document_id").alias("id")).agg(F.countDistinct("document_id").alias("hungarian_statute_count"))
    rows = acts.join(counts, "id", "left").withColumn("hungarian_statute_count", F.coalesce("hungarian_statute_count", F.lit(0)))
    if implemented:
        rows = rows.where("hungarian_statute_count > 0")
    rows = rows.select(F.col("id").alias("eu_document_id"), "type", "year", "number", "title", "short_name", "hungarian_statute_count")
    note = None if store.has("eu_documents") else EU_NOTE.format("documents")
    return Answer(rows.orderBy(F.desc("year"), F.desc("number"), "eu_document_id").limit(clamp(limit, 20, 100)), note)


def provision_eu_basis(store: Store, document: str, ref: str) -> Answer:
    resolved = resolve_one(store["legal_documents"], document)
    ref = ref.strip()
    rank = F.when(F.col("provision_ref") == ref, 0).when(F.col("provision_ref") == f"s{ref}", 1).when(F.col("section") == ref, 2)
    own = store["legal_provisions"].where(F.col("document_id") == (resolved or "")).withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1)
    refs = store["eu_references"].join(own.select(F.col("id").alias("provision_id")), "provision_id", "left_semi")
    rows = refs.join(_acts(store), "eu_document_id", "left").select("eu_document_id", "eu_document_type", "eu_document_title", "eu_article", "reference_type", "reference_context", "full_citation")
    note = None if resolved is None or store.has("eu_references") else EU_NOTE.format("references")
    return Answer(rows.orderBy("reference_type", "eu_document_id", "eu_article"), note)


def status_counts(refs: DataFrame) -> DataFrame:
    """A row a statute: edges in all, and of each status."""
    of = lambda s: F.count(F.when(F.col("implementation_status") == s, 1)).alias(s)
    return refs.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), of("complete"), of("partial"), of("pending"), of("unknown"))


def verdict(complete: Column, partial: Column, unknown: Column, total: Column) -> Column:
    return F.when(total == 0, "not_applicable").when((complete > 0) & (partial == 0) & (unknown == 0), "compliant").when(partial > 0, "partial").otherwise("unclear")


def compliance(store: Store, docs: DataFrame | None = None, eu_document_id: str | None = None) -> DataFrame:
    """A verdict for each of docs (all statutes): the act narrows what counts as having edges, not the verdict."""
    docs = (docs if docs is not None else store["legal_documents"]).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "status")
    if not store.has("eu_references"):
        none = F.array().cast("array<string>")
        return docs.select("document_id", "document_title", F.lit("not_applicable").alias("compliance_status"), F.lit(0).cast("long").alias("eu_references_found"), F.array(F.lit("EU references not available in this database tier")).alias("warnings"), none.alias("recommendations"))
    refs = store["eu_references"]
    counts = status_counts(refs)
    narrowed = refs.where(F.col("eu_document_id") == eu_document_id).groupBy("document_id").agg(F.count(F.lit(1)).alias("found")) if eu_document_id else counts.select("document_id", F.col("total").alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = docs.join(narrowed, "document_id", "left").join(counts, "document_id", "left").withColumns({c: zero(F.col(c)) for c in ("found", "complete", "partial", "unknown")})
    state = verdict(F.col("complete"), F.col("partial"), F.col("unknown"), F.col("found"))
    some, repealed = F.col("found") > 0, F.col("status") == "repealed"
    warnings = F.array_compact(F.array(F.when(some & repealed, "This statute has been repealed."), F.when(some & (state == "partial"), F.concat(F.col("partial").cast("string"), F.lit(" EU reference(s) have partial alignment status.")))))
    advice = F.array_compact(F.array(F.when(~some, NO_EDGES), F.when(some & repealed, "Check for replacement legislation."), F.when((state == "unclear") & (F.col("unknown") > 0), F.concat(F.col("unknown").cast("string"), F.lit(" EU reference(s) have unknown alignment status. Manual review recommended.")))))
    return each.select("document_id", "document_title", state.alias("compliance_status"), F.col("found").alias("eu_references_found"), warnings.alias("warnings"), advice.alias("recommendations"))


def validate_compliance(store: Store, document: str, eu_document_id: str | None = None) -> DataFrame:
    resolved = resolve_one(store["legal_documents"], document)
    if resolved is None:
        return store.spark.createDataFrame([(document, "Unknown", "not_applicable", 0, [f'Document not found: "{document}"'], [])], "document_id string, document_title string, compliance_status string, eu_references_found long, warnings array<string>, recommendations array<string>")
    return compliance(store, store["legal_documents"].where(F.col("id") == resolved), eu_document_id)
