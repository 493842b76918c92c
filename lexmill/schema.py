"""Tables of the statute store: columns, constraints, and the store itself."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column name and type of every table.
TABLES: dict[str, str] = {
    "legal_documents": "id string, type string, title string, title_en string, short_name string, status string, issued_date string, in_force_date string, url string, description string, last_updated timestamp",
    "legal_provisions": "id long, document_id string, provision_ref string, chapter string, section string, title string, content string, metadata string",
    "cross_references": "source_document_id string, source_provision_ref string, target_document_id string, target_provision_ref string, ref_type string",
    "definitions": "id long, document_id string, term string, term_en string, definition string, source_provision string",
    "eu_documents": "id string, type string, year int, number int, community string, celex string, title string, title_en string, short_name string, in_force boolean, url string, description string",
    "eu_references": "id long, source_type string, source_id string, document_id string, provision_id long, eu_document_id string, eu_article string, reference_type string, reference_context string, full_citation string, is_primary_implementation int, implementation_status string",
    "db_metadata": "key string, value string",
}
#: What constrained columns may hold.
ALLOWED: dict[tuple[str, str], tuple[str, ...]] = {
    ("legal_documents", "type"): ("statute", "bill", "case_law"),
    ("legal_documents", "status"): ("in_force", "amended", "repealed", "not_yet_in_force"),
    ("eu_documents", "type"): ("directive", "regulation"),
    ("eu_documents", "community"): ("EU", "EC", "EEC", "Euratom"),
    ("eu_references", "source_type"): ("provision", "document", "case_law"),
    ("eu_references", "reference_type"): ("implements", "supplements", "applies", "references", "complies_with", "derogates_from", "amended_by", "repealed_by", "cites_article"),
    ("eu_references", "implementation_status"): ("complete", "partial", "pending", "unknown"),
    ("cross_references", "ref_type"): ("references", "amended_by", "implements", "see_also"),
}
YEARS = (1957, 2100)
#: Keys that no two rows share (a null in a key makes it differ from any other), and columns that hold no null.
KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "legal_documents": (("id",),),
    "legal_provisions": (("id",), ("document_id", "provision_ref")),
    "definitions": (("id",), ("document_id", "term")),
    "eu_documents": (("id",),),
    "eu_references": (("id",), ("source_id", "eu_document_id", "eu_article")),
    "db_metadata": (("key",),),
}
REQUIRED: dict[str, tuple[str, ...]] = {
    "legal_documents": ("id", "type", "title", "status"),
    "legal_provisions": ("id", "document_id", "provision_ref", "section", "content"),
    "cross_references": ("source_document_id", "target_document_id", "ref_type"),
    "definitions": ("id", "document_id", "term", "definition"),
    "eu_documents": ("id", "type", "year", "number"),
    "eu_references": ("id", "source_type", "source_id", "document_id", "eu_document_id", "reference_type"),
    "db_metadata": ("key", "value"),
}
#: Columns that name a row of another table.
REFERENCES: tuple[tuple[str, str, str], ...] = (
    ("legal_provisions", "document_id", "legal_documents"), ("cross_references", "source_document_id", "legal_documents"), ("cross_references", "target_document_id", "legal_documents"), ("definitions", "document_id", "legal_documents"),
    ("eu_references", "document_id", "legal_documents"), ("eu_references", "provision_id", "legal_provisions"), ("eu_references", "eu_document_id", "eu_documents"),
)
#: Where a store lies if no folder is named: what this variable says, else the first of these folders that holds one.
STORE_VARIABLE = "LEXMILL_STORE"
CANDIDATES = ("data/store", "../data/store")
EU_NOTE = "EU {} not available in this database tier"


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def valid_eu_document(year: Column, number: Column, kind: Column | None = None, community: Column | None = None) -> Column:
    ok = year.between(*YEARS) & (number > 0)
    if kind is not None:
        ok = ok & kind.isin(*ALLOWED["eu_documents", "type"])
    if community is not None:
        ok = ok & community.isin(*ALLOWED["eu_documents", "community"])
    return F.coalesce(ok, F.lit(False))


def violations(table: str, df: DataFrame) -> DataFrame:
    """Rows that break a value constraint: the columns of df and `violation`, the column at fault. Null passes, as in SQL."""
    checks = [(c, F.col(c).isin(*v)) for (t, c), v in ALLOWED.items() if t == table and c in df.columns]
    if table == "eu_documents":
        checks += [("year", F.col("year").between(*YEARS)), ("number", F.col("number") > 0)]
    broken = F.filter(F.array(*(F.when(~ok, F.lit(c)) for c, ok in checks)), lambda v: v.isNotNull())
    return df.withColumn("violation", F.explode(broken))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference names nothing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").select(child.columns)


def repeated(table: str, df: DataFrame) -> DataFrame:
    """key, value, n: keys that several rows share, and how many rows do. A key with a null is shared by none."""
    out = None
    for key in KEYS.get(table, ()):
        found = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.select(F.lit(", ".join(key)).alias("key"), F.concat_ws("|", *(F.col(c).cast("string") for c in key)).alias("value"), "n")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], "key string, value string, n long")


def lacking(table: str, df: DataFrame) -> DataFrame:
    """Rows without a value that they need: the columns of df and `lacks`, the column at fault."""
    named = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED.get(table, ()) if c in df.columns]
    return df.withColumn("lacks", F.explode(F.array_compact(F.array(*named, F.lit(None).cast("string")))))


def judged(table: str, df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of a table that break a constraint: its columns and `reasons`, one for each constraint.

    Values out of what is allowed, columns without a value that they need, keys that rows share, references that name nothing
    in tables. A constraint on a column or table that is not there is not held.
    """
    values = [(c, F.col(c).isin(*v)) for (t, c), v in ALLOWED.items() if t == table and c in df.columns]
    if table == "eu_documents":
        values += [("year", F.col("year").between(*YEARS)), ("number", F.col("number") > 0)]
    reasons = [F.when(~ok, F.lit(f"{c}: not allowed")) for c, ok in values] + [F.when(F.col(c).isNull(), F.lit(f"{c}: lacking")) for c in REQUIRED.get(table, ()) if c in df.columns]
    marked = df
    for i, key in enumerate(k for k in KEYS.get(table, ()) if set(k) <= set(df.columns)):
        shared = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias(f"_k{i}")).where(F.col(f"_k{i}") > 1)
        marked = marked.join(shared, list(key), "left")
        reasons.append(F.when(F.col(f"_k{i}").isNotNull(), F.lit(f"{', '.join(key)}: shared")))
    for i, (_, column, parent) in enumerate(r for r in REFERENCES if r[0] == table and r[1] in df.columns and r[2] in tables):
        there = tables[parent].select(F.col("id").alias(column)).distinct().withColumn(f"_p{i}", F.lit(True))
        marked = marked.join(there, column, "left")
        reasons.append(F.when(F.col(column).isNotNull() & F.col(f"_p{i}").isNull(), F.lit(f"{column}: names no row of {parent}")))
    told = F.array_compact(F.array(*reasons, F.lit(None).cast("string")))
    return marked.withColumn("reasons", told).where(F.size("reasons") > 0).select(*df.columns, "reasons")


class ConstraintError(ValueError):
    """Rows of a version break constraints, so it does not count. `rejected` reads them."""


def rejected(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The rows, with reasons, for which the version after the last complete one did not count; by table, those with any."""
    kept = versions(spark, folder)
    place = f"{folder}/version={kept[-1] + 1 if kept else 0}/rejected"
    files = _files(spark, place)
    names = [p.getPath().getName() for p in files.listStatus(_path(spark, place))] if files.exists(_path(spark, place)) else []
    return {n: spark.read.parquet(f"{place}/{n}") for n in names}


@dataclass
class Store:
    """The tables that there are. A table may be missing; what needs it then has an empty answer with a note."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    index: Any = None  # the stored index of legal_provisions, where there is one

    def has(self, table: str) -> bool:
        return table in self.tables

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table] if table in self.tables else empty(self.spark, table)

    @classmethod
    def open(cls, spark: SparkSession, folder: str | None = None, candidates: Iterable[str] = CANDIDATES) -> Store:
        """The store of a folder, of the one that STORE_VARIABLE names, or of the first candidate that holds one."""
        told = folder or os.environ.get(STORE_VARIABLE)
        for place in [told] if told else candidates:
            try:
                return cls.load(spark, place)
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"no store in {told}" if told else f"no store: set {STORE_VARIABLE} or place one in {' or '.join(candidates)}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Store:
        """The last complete version of a folder's tables. Raises FileNotFoundError if there is none."""
        kept = versions(spark, folder)
        if not kept:
            raise FileNotFoundError(folder)
        place = f"{folder}/version={kept[-1]}"
        there = {p.getPath().getName() for p in _files(spark, place).listStatus(_path(spark, place))}
        return cls(spark, {name: spark.read.parquet(f"{place}/{name}") for name in TABLES if name in there})

    def register(self, prefix: str = "") -> None:
        """Makes the tables views of the session's catalog, where SQL has them by name."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{prefix}{name}")

    @classmethod
    def of_catalog(cls, spark: SparkSession, prefix: str = "") -> Store:
        """The tables that the session's catalog has by their names; one that is dropped is missing from then on."""
        return cls(spark, {name: spark.table(f"{prefix}{name}") for name in TABLES if spark.catalog.tableExists(f"{prefix}{name}")})

    def save(self, folder: str, check: bool = False) -> None:
        """Writes all tables as a new version, which counts once its mark is written: a reader sees all of it or none.

        With `check`, the tables as written are held against their constraints first. Rows that break one are set aside with
        their reasons, where rejected() reads them, and the version does not count. The version before stays for those who
        read it; older ones go.
        """
        kept = versions(self.spark, folder)
        place = f"{folder}/version={kept[-1] + 1 if kept else 0}"
        remove(self.spark, place)  # what a load that broke off left
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{place}/{name}")
        if check:
            written = {name: self.spark.read.parquet(f"{place}/{name}") for name in self.tables}
            bad = {}
            for name, df in written.items():
                judged(name, df, written).write.mode("overwrite").parquet(f"{place}/judged/{name}")
                if n := self.spark.read.parquet(f"{place}/judged/{name}").count():
                    bad[name] = n
            if bad:
                for name in bad:
                    self.spark.read.parquet(f"{place}/judged/{name}").write.mode("overwrite").parquet(f"{place}/rejected/{name}")
                raise ConstraintError(f"{folder}: rows that break constraints: {bad}")
            remove(self.spark, f"{place}/judged")
        complete(self.spark, place)
        for old in kept[:-1]:
            remove(self.spark, f"{folder}/version={old}")


#: The mark of a version whose tables are all written.
_COMPLETE = "_COMPLETE"


def _path(spark: SparkSession, place: str):
    return spark._jvm.org.apache.hadoop.fs.Path(place)


def _files(spark: SparkSession, place: str):
    return _path(spark, place).getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, place: str) -> None:
    """Marks a version as whole."""
    _files(spark, place).create(_path(spark, f"{place}/{_COMPLETE}"), True).close()


def remove(spark: SparkSession, place: str) -> None:
    _files(spark, place).delete(_path(spark, place), True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions of a folder, in order."""
    files = _files(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    names = [p.getPath().getName() for p in files.listStatus(_path(spark, folder))]
    numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(n for n in numbers if files.exists(_path(spark, f"{folder}/version={n}/{_COMPLETE}")))


@dataclass
class Answer:
    """Rows of a tool with what goes beside them."""

    rows: DataFrame
    note: str | None = None
    strategy: str | None = None
