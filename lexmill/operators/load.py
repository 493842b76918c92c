"""From staged files to the tables of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.dedupe import keep_first, keep_longest, mark_primary, unique_unless_null
from lexmill.operators.extract import act_url, eu_references
from lexmill.schema import Store, valid_eu_document
from lexmill.sources.seed import children
from lexmill.storage import numbered


#: What the metadata of a load says of its source.
SOURCE, LICENCE = "official-source", "as the publisher of the statutes says"


def attempts(seeds: DataFrame, store: Store) -> DataFrame:
    """name, attempted, kept: rows that the files of a load held of each kind, and what the rules left of them."""
    tried = {"legal_documents": seeds.count(), "legal_provisions": children(seeds, "provisions").count(), "definitions": children(seeds, "definitions").count()}
    return store.spark.createDataFrame([(name, n, store[name].count()) for name, n in tried.items()], "name string, attempted long, kept long")


def build(spark: SparkSession, seeds: DataFrame, mappings: DataFrame, built_at: str, folder: str) -> Store:
    """Builds and saves the store, all of its tables or none. A file's documents come in the order of file names; ids follow that order.

    Rows that break a constraint raise ConstraintError: the store stays as it was, and schema.rejected() has them with reasons.

    Edges come from the text of provisions, then from mappings whose statute is known; acts that break a constraint are left
    out, with their edges.
    """
    documents = keep_first(seeds, ("id",), "file").select("id", "type", "title", "title_en", "short_name", "status", "issued_date", "in_force_date", "url", "description", F.lit(built_at).try_cast("timestamp").alias("last_updated"))
    kept = keep_longest(children(seeds, "provisions"), ("document_id", "provision_ref"), "content", "pos")
    provisions = kept.select("file", "pos", "document_id", "provision_ref", "chapter", "section", "title", "content", "metadata")
    provisions = numbered(provisions, "file", "document_id", "pos").select("id", "document_id", "provision_ref", "chapter", "section", "title", "content", "metadata")
    defined = keep_first(children(seeds, "definitions"), ("document_id", "term"), "file", "pos")
    definitions = defined.select(F.xxhash64("document_id", "term").alias("id"), "document_id", "term", "term_en", "definition", "source_provision")

    found = eu_references(provisions.withColumn("provision_id", F.col("id")), "provision_id", "content").join(provisions.select(F.col("id").alias("provision_id"), "document_id"), "provision_id")
    found = found.where(valid_eu_document(F.col("year"), F.col("number"), F.col("type"), F.col("community")))
    edges = mark_primary(found, "provision_id", "pattern", "at").select(F.lit("provision").alias("source_type"), F.col("provision_id").cast("string").alias("source_id"), "document_id", "provision_id", "eu_document_id", "eu_article", "reference_type", "reference_context", "full_citation", "is_primary_implementation", "implementation_status", "pattern", "at")
    known = mappings.where(valid_eu_document(F.col("eu_year"), F.col("eu_number"), F.col("eu_type"), F.col("eu_community")))
    mapped = known.join(documents.select(F.col("id").alias("hungarian_document_id")), "hungarian_document_id", "left_semi").select(
        F.lit("document").alias("source_type"), F.col("hungarian_document_id").alias("source_id"), F.col("hungarian_document_id").alias("document_id"), F.lit(None).cast("long").alias("provision_id"), "eu_document_id", F.lit(None).cast("string").alias("eu_article"), "reference_type",
        F.lit(None).cast("string").alias("reference_context"), F.lit(None).cast("string").alias("full_citation"), F.coalesce(F.col("is_primary").cast("int"), F.lit(0)).alias("is_primary_implementation"), F.coalesce("implementation_status", F.lit("unknown")).alias("implementation_status"), F.lit(9).alias("pattern"), F.lit(0).alias("at"),
    )
    every = unique_unless_null(edges.unionByName(mapped), ("source_id", "eu_document_id"), "eu_article", "pattern", "at").drop("pattern", "at")
    references = numbered(every, "source_type", "source_id", "eu_document_id", "eu_article", "reference_type", "is_primary_implementation", "implementation_status")
    acts = found.select(F.col("eu_document_id").alias("id"), "type", "year", "number", "community", F.lit(None).cast("string").alias("title"), F.concat(F.initcap("type"), F.lit(" "), F.col("year").cast("string"), F.lit("/"), F.col("number").cast("string")).alias("short_name"), F.lit(1).alias("_rank"))
    acts = acts.unionByName(known.select(F.col("eu_document_id").alias("id"), F.col("eu_type").alias("type"), F.col("eu_year").alias("year"), F.col("eu_number").alias("number"), F.col("eu_community").alias("community"), F.col("eu_title").alias("title"), F.col("eu_short_name").alias("short_name"), F.lit(2).alias("_rank")))
    acts = keep_first(acts, ("id",), "_rank", "community", "title", "short_name").drop("_rank")
    acts = acts.withColumns({"in_force": F.lit(True), "url": act_url(F.col("type"), F.col("year"), F.col("number"))})
    metadata = spark.createDataFrame([("tier", "free"), ("schema_version", "2"), ("built_at", built_at), ("jurisdiction", "HU"), ("builder", "lexmill"), ("source", SOURCE), ("licence", LICENCE)], "key string, value string")
    Store(spark, {"legal_documents": documents, "legal_provisions": provisions, "definitions": definitions, "eu_documents": acts, "eu_references": references, "db_metadata": metadata}).save(folder, check=True)
    return Store.load(spark, folder)
