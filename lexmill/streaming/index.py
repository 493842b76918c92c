"""Keeping a stored index up with a stream of rows: each micro-batch is a segment, and supersedes the rows of its ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.dedupe import keep_first
from lexmill.operators.index import COLUMNS, Index


def maintain_index(rows: DataFrame, folder: str, checkpoint: str, columns: tuple[str, ...] = COLUMNS) -> StreamingQuery:
    """rows: a stream with id, text columns and, where rows change or go, `deleted` (true: the row is gone) and `version`.

    A row again is a new text of it. Within a batch the greatest version counts; without versions, ids are told once a batch.
    A batch that comes again does nothing. `Index.open` reads what is left.
    """

    def add(batch: DataFrame, number: int) -> None:
        if "version" in batch.columns:
            batch = keep_first(batch.withColumn("_back", -F.col("version")), ("id",), "_back").drop("_back")
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        Index.open(batch.sparkSession, folder).add(batch.where(~gone), batch.where(gone).select("id"), number, columns)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
