"""Mixing sources to target weights: how often each document is taken, so that sources come near their shares.

Tokens are counted per source, targets give repetition rates, and each document is taken floor(rate) times and once more if
a draw made from its hash falls below the rate's fraction. Several draws are had from one hash; every source takes the one
whose mix comes nearest its target, told from sums that are made before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, numbered, quoted

#: Words of a text, as contracts count them.
WORD = r"[^\x20\x09-\x0D]+"
#: Draws had of each document, and the bits of a draw.
DRAWS, DRAW_BITS = 32, 48
#: Sources travel to all executors up to so many bytes.
SMALL_BYTES = 8 << 20


def _half(digest: Column, begin: int) -> Column:
    return F.conv(F.substring(digest, begin, DRAW_BITS // 4), 16, 10).cast("long")


def _draw(turn: Column) -> Column:
    """The draw of a turn, from 0 to 2^DRAW_BITS: two halves of a digest give draws of which any two are independent."""
    return (F.col("_a") + turn * F.col("_b")).bitwiseAND((1 << DRAW_BITS) - 1)


def _taken(turn: Column) -> Column:
    return F.col("_whole") + (_draw(turn) < F.col("_part") * float(1 << DRAW_BITS)).cast("long")


def sized(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id, source, size (words of the text; null has none), halves of the draws' digest, and columns to carry.

    The digest is that of doc_id, and of the text where there is none, so that equal rows are drawn alike.
    """
    text = F.col("text").cast("string")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), text, F.lit("")).cast("binary"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("_digest"), *carry)
    return plain.withColumns({"_a": _half(F.col("_digest"), 1), "_b": _half(F.col("_digest"), 1 + DRAW_BITS // 4)}).drop("_digest")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target, _whole and _part of the repetition rate, for each source that occurs.

    Sources weigh as their turn by code point says, null last. A target stops at `most` times its source's size; the excess
    is shared again by weight until none is above. A round is one sum over the sources; who has stopped stays stopped, as
    the level only rises. A source without words has target 0.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_number", F.lit(len(weights))) + 1).cast("int"))
    each = checkpointed(numbered(sums, F.col("source").isNull(), F.col("source")).withColumn("_weight", turn).withColumn("_cap", F.col("source_size") * float(most)))
    left, weight, stopped = None, None, -1
    while True:
        full = F.lit(False) if left is None else F.col("_weight") * F.lit(left) / F.lit(weight) > F.col("_cap")
        row = each.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("_cap"))).alias("spent"), F.sum(F.when(~full, F.col("_weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if row["n"] == stopped or row["all"] is None or row["weight"] is None:
            break
        stopped, left, weight = row["n"], float(row["all"]) * share - (row["spent"] or 0.0), float(row["weight"])
    even = F.lit(0.0) if left is None else F.col("_weight") * F.lit(left) / F.lit(weight)
    told = each.withColumn("target", F.least("_cap", even)).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    return told.select("source", "source_size", "target", F.floor("_rate").alias("_whole"), (F.col("_rate") - F.floor("_rate")).alias("_part"))


def _with_plan(sizes: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Joins on the source, null included. A plan beyond the bound is shuffled, where the engine splits a hot source."""
    named = plan.withColumnRenamed("source", "_of")
    return sizes.join(F.broadcast(named) if small else named, sizes["source"].eqNullSafe(named["_of"])).drop("_of")


def plan(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, bool]:
    """targets() with `_turn`, the draw whose mix comes nearest (the first of those); and whether it is small."""
    told = checkpointed(targets(sizes, weights, share, most))
    extent = told.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first()
    small = extent["bytes"] <= SMALL_BYTES
    sums = _with_plan(sizes, told, small).groupBy("source").agg(*(F.sum(F.col("size") * _taken(F.lit(k))).alias(f"_t{k}") for k in range(DRAWS)))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col(f"_t{k}") - F.col("target")).alias("off"), F.lit(k).alias("turn")) for k in range(DRAWS))))
    return checkpointed(_with_plan(sums, told, small).select("source", "source_size", "target", "_whole", "_part", near["turn"].alias("_turn"))), small


def taken(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; source after them.

    Texts are read once, for their sizes. A null or empty text has size 0 and takes nothing. Rows of one doc_id share their
    draw, and so do rows without one of equal text. A null source is a source; no documents give no rows.
    """
    sizes = checkpointed(sized(docs))
    told, small = plan(sizes, weights, share, most)
    return _with_plan(sizes, told, small).select("doc_id", "size", "source_size", "target", (F.col("size") * _taken(F.col("_turn"))).alias("taken"), "source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of docs, all their columns, each as often as it is taken (texts without words never)."""
    told, small = plan(checkpointed(sized(docs)), weights, share, most)
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row")
    copies = F.when(F.col("size") > 0, _taken(F.col("_turn"))).otherwise(F.lit(0))
    each = _with_plan(sized(docs, row), told, small).select("_row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy"))
    return each.select("_row.*")
