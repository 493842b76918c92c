"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import oracles
from lexmill.llm.common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path(), 2048)


def op3_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir), words=3, most=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), 50)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.chunk_dedup import REACH, remove_repeats

    return remove_repeats(documents(spark, sf_dir), reach=REACH).drop("kept_text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.decontaminate import overlaps

    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.fingerprint import compare_versions

    return compare_versions(documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.url_filter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _turn(modulus: int):
    """crc32 of doc_id as text, modulo a number: the folds of the learnt operators. A null doc_id is in no held-out fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.quality import learn, scored

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    docs = documents(spark, sf_dir)
    model = learn(docs, labels.where(_turn(3) != 1))
    return scored(docs, model).select("doc_id", F.coalesce(_turn(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.language import identify, learn

    model = learn(documents(spark, sf_dir, "doc_id", "text", "lang").where(_turn(4) != 2))
    found = identify(documents(spark, sf_dir), model)
    return found.withColumn("held_out", F.coalesce(_turn(4) == 2, F.lit(False)))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.mixing import taken

    return taken(documents(spark, sf_dir, "doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, most=2.0).drop("source")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.divergence import audit

    return audit(documents(spark, sf_dir, "text", "lang", "source"), least=30, foremost=50)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.hard_negatives import mine

    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"), F.col("id") % 100 == 0, label, positives=5, negatives=5, least=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash_near_dup": op3_simhash_near_dup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filter": op6_url_filter,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op11_mixing": op11_mixing,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_filter": oracles.url_filter(),
    "op9_suffix_dedup": oracles.suffix_dedup(),
    "op11_mixing": oracles.mixing(),
    "op12_source_divergence": oracles.source_divergence(),
    "op13_hard_negatives": oracles.hard_negatives(),
}
