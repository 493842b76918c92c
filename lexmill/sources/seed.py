"""Staged statute files: seed JSON, cached HTML, act mappings; and JSON out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "id string, type string, title string, title_en string, short_name string, status string, issued_date string, in_force_date string, url string, description string, provisions array<struct<provision_ref:string,chapter:string,section:string,title:string,content:string,metadata:string>>, definitions array<struct<term:string,term_en:string,definition:string,source_provision:string>>"
MAPPING = "hungarian_document_id string, eu_document_id string, eu_type string, eu_year int, eu_number int, eu_community string, eu_title string, eu_short_name string, reference_type string, is_primary boolean, implementation_status string"


def read_seed(spark: SparkSession, folder: str) -> DataFrame:
    """A row a JSON file, with its name; names that begin with a dot or an underscore are passed over."""
    return spark.read.schema(SEED).option("multiLine", True).json(folder, pathGlobFilter="*.json").select("*", F.col("_metadata.file_name").alias("file")).transform(with_defaults)


def with_defaults(rows: DataFrame) -> DataFrame:
    """What a statute is that does not say it."""
    return rows.withColumns({"type": F.coalesce("type", F.lit("statute")), "status": F.coalesce("status", F.lit("in_force"))})


def children(seeds: DataFrame, column: str) -> DataFrame:
    """Elements of a nested array with their document and place."""
    return seeds.select("file", F.col("id").alias("document_id"), F.posexplode(column).alias("pos", "_child")).select("file", "document_id", "pos", "_child.*")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Mappings of statutes to acts; a file that is not there has none."""
    try:
        return spark.read.schema(MAPPING).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], MAPPING)


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """id (the file's name without its ending), html."""
    pages = spark.read.text(folder, wholetext=True, pathGlobFilter="*.html")
    return pages.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.html\z", "").alias("id"), F.col("value").alias("html"))


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias(column))


def digest(content: Column) -> Column:
    """Twelve hex digits that tell one content from another."""
    return F.substring(F.sha2(content, 256), 1, 12)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, digest (of the first 64 KiB, padded with zero bytes), modified."""
    files = spark.read.format("binaryFile").load(folder)
    head = F.rpad(F.substring("content", 1, 65536), 65536, F.lit(b"\0"))
    return files.select("path", digest(head).alias("digest"), F.col("modificationTime").alias("modified"))


def is_current(stored: str | None, expected: str | None) -> bool:
    """Whether a copy whose checksum line is `stored` need not be refreshed: both lines are there and name the same digest."""
    first = lambda line: (line or "").split()[:1]
    return bool(first(stored)) and first(stored) == first(expected)
