"""The folder that the driver and all executors share for what is written between steps, and numbers that stay."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, it is one of this machine in local mode; on a cluster that is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        told = tempfile.mkdtemp(prefix="lexmill-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(told)
    return told


#: Rows that cost much each, of one task.
COSTLY_ROWS = 4000


def dealt(rows: DataFrame, key: str, most: int = COSTLY_ROWS) -> DataFrame:
    """rows by key over a task for every `most` of them. A file of few bytes a row is one task as it is read, however many rows
    it has; what is worked out of a row goes after this, and what is grouped by key then needs no exchange."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with an id from 1 in this order, which tells any two rows apart.

    Rows are dealt by ranges of the order and numbered within each; only the sizes of the ranges come together. Numbers are
    written to the checkpoint folder, so that they stay what they are.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33)
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:  # a row for each partition
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "_p long, _before long")
    # A row a partition.
    return dealt.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("id", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_m", "_before")
