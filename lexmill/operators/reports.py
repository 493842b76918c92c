"""Counts, metadata and freshness of the store."""

from __future__ import annotations

import hashlib
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.schema import Store

#: A store older than this many days is stale.
STALE_DAYS = 90
#: What stands in a prompt for what is not given.
GENERAL = "all areas"
CORE = ("legal_documents", "legal_provisions")
#: Where the statutes come from, and what is said beside them.
JURISDICTION = "HU"
SOURCE = {
    "name": "Nemzeti Jogszabálytár (National Legislation Database)",
    "authority": "Magyar Közlöny (Hungarian Official Gazette)",
    "url": "https://njt.hu",
    "license": "Official legal text publication (see portal terms at njt.hu)",
    "coverage": "Curated set of key Hungarian statutes covering data protection, cybersecurity, electronic commerce, telecommunications, public procurement, trade secrets, trust services, and criminal cybercrime provisions",
}
LANGUAGES = ("hu", "en")
DISCLAIMER = "This is a research tool, not legal advice. Verify critical citations against official sources."


def table_counts(store: Store, tables: tuple[str, ...]) -> DataFrame:
    """name, n of each table; a missing table has none."""
    out = store.spark.createDataFrame([(t, 0) for t in tables if not store.has(t)], "name string, n long")
    for t in tables:
        if store.has(t):
            out = out.unionByName(store[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n"))
    return out


def capabilities(store: Store, names: tuple[str, ...] = (*CORE, "definitions", "eu_documents", "eu_references")) -> DataFrame:
    """name, available, rows: which tables there are, and how many rows those have."""
    counts = None
    for name in names:
        rows = store[name].agg(F.lit(name).alias("name"), F.lit(store.has(name)).alias("available"), F.count(F.lit(1)).alias("rows"))
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


def metadata(kv: DataFrame) -> DataFrame:
    """tier, schema_version, built_at in one row, with defaults."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return kv.agg(F.coalesce(value("tier"), F.lit("free")).alias("tier"), F.coalesce(value("schema_version"), F.lit("1.0")).alias("schema_version"), value("built_at").alias("built_at"))


def about(store: Store) -> DataFrame:
    """Counts; those of supranational acts only if there are edges."""
    tables = ("legal_documents", "legal_provisions", "definitions", "eu_documents", "eu_references")
    n = {r["name"]: r["n"] for r in table_counts(store, tables).collect()}
    shown = [(t, n[t]) for t in tables if n["eu_references"] > 0 or not t.startswith("eu_")]
    return store.spark.createDataFrame(shown, "name string, n long")


def about_record(store: Store, version: str) -> dict:
    """What a store is: its counts, source, age and fingerprint, and what to keep in mind."""
    stats = {r["name"].removeprefix("legal_"): r["n"] for r in about(store).collect()}
    built = metadata(store["db_metadata"]).first()["built_at"]
    return {"version": version, "jurisdiction": JURISDICTION, "stats": stats, "data_sources": [{"name": SOURCE["name"], "url": SOURCE["url"], "authority": SOURCE["authority"]}], "freshness": {"database_built": built}, "fingerprint": fingerprint(store), "disclaimer": DISCLAIMER}


def fingerprint(store: Store) -> str:
    """12 hexadecimal digits that change with the store's metadata and the rows of its core tables, whatever their order."""
    parts = [f"{r['key']}={r['value']}" for r in store["db_metadata"].orderBy("key", "value").collect()]
    for t in CORE:
        parts.append(str(store[t].agg(F.count(F.lit(1)), F.sum(F.xxhash64(*store[t].columns) % 1_000_000_007)).first()))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:12]


def list_sources(store: Store) -> DataFrame:
    """The source of the statutes, and the store's metadata and counts."""
    n = {r["name"]: r["n"] for r in table_counts(store, CORE).collect()}
    said = {k: F.lit(v) for k, v in SOURCE.items()} | {"languages": F.lit(",".join(LANGUAGES))}
    return metadata(store["db_metadata"]).withColumns(said | {"document_count": F.lit(n[CORE[0]]), "provision_count": F.lit(n[CORE[1]])})


def healthy(store: Store) -> bool:
    return all(store.has(t) for t in CORE) and all(r["n"] > 0 for r in table_counts(store, CORE).collect())


def freshness(age: Column, failed: Column, documents: Column, provisions: Column, census_documents: Column, census_provisions: Column) -> Column:
    """2 for an error; 1 if too old, of unknown age or short of the census; else 0."""
    short = F.coalesce(documents < census_documents, F.lit(False)) | F.coalesce(provisions < census_provisions, F.lit(False))
    return F.when(failed, 2).when(age.isNull() | (age > STALE_DAYS) | short, 1).otherwise(0)


def prompt(template: str, **values: str | None) -> str:
    """A prompt with its blanks filled; what is not given stays general."""
    return template.format(**{k: v or GENERAL for k, v in values.items()})


def prompts(template: str, **values: Column) -> Column:
    """As prompt, for columns of values."""
    parts = list(Formatter().parse(template))
    return F.concat(*(c for text, name, *_ in parts for c in (F.lit(text), *((F.coalesce(F.nullif(values[name], F.lit("")), F.lit(GENERAL)),) if name else ()))))
