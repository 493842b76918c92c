"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). What it returns is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import chunk_dedup, decontaminate, packing, quality, simhash
from lexmill.llm.common import quoted
from lexmill.llm.queries import tokenizer_path
from lexmill.schema import remove
from lexmill.storage import checkpoint_dir

#: Near duplicates have distinct shingles of five words with a Jaccard similarity of 0.8 or more.
WORDS, SIMILARITY = 5, 0.8


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document, and all its columns as `row`, so that no name of theirs meets an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Labels of the held-out fold are not learnt from.

    A null text is judged as the empty one; rows of equal text go or stay together; without labels of both kinds all stay or
    all go, as the one kind says (none: all stay).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    learnt = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return quality.scored(boxed(docs), quality.learn(docs, learnt)).where("score >= 0.5").select("row.*")


def _maps(kind: T.DataType) -> bool:
    """Whether a type has maps in it, however deep: they have no hash."""
    if isinstance(kind, T.StructType):
        return any(_maps(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _maps(kind.elementType)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id, and of the texts of one doc_id the least hash.

    A document is what all its columns are, so that other texts of a doc_id are documents of their own. Documents without a
    doc_id come last. Of equal rows one stays.
    """
    hashed = [F.to_json(F.struct(F.col(quoted(f.name)))) if _maps(f.dataType) else F.col(quoted(f.name)) for f in docs.schema]
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"), F.xxhash64(*hashed).alias("name"), F.col("text").cast("string").alias("text"), row)
    kept = simhash.alike_documents(named, SIMILARITY, WORDS).where("name = first").select("name").distinct()
    return named.join(kept, "name", "left_semi").dropDuplicates(["rank", "name"]).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller doc_id holds too. Every document stays, if emptied.

    Texts of one doc_id, and those without one, take nothing from each other; repeated rows stay.
    """
    cut = chunk_dedup.remove_repeats(boxed(docs), carry=("row",), reach=chunk_dedup.REACH)
    made = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*(made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(f"row.{quoted(c)}") for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Null and empty texts stay; a text goes in all rows that have it."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens. A null or empty text is one end token."""
    return packing.pack(docs, tokenizer_path(), 2048)


STAGES = [
    ("quality classifier", quality_filter),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Learnt scores, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written in the shared folder and read again, and goes after that."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")  # all that was read of it is written anew
    return docs
