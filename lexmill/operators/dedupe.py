"""Keeping one row of several, by rules that do not depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import spaced


def keep_longest(provisions: DataFrame, keys: tuple[str, ...], content: str, position: str) -> DataFrame:
    """Of the rows of a trimmed reference, the first of those with the longest normalised content.

    It takes the place of the first row of its reference. The last key is the reference. A hot reference meets only minima
    and maxima with map-side combine; no window holds its rows together.
    """
    *others, ref = keys
    rows = provisions.withColumn(ref, F.trim(F.col(ref)))
    every = F.struct(*(F.col(c) for c in rows.columns))
    best = rows.groupBy(*keys).agg(F.min(position).alias("_first"), F.min_by(every, F.struct(-F.length(spaced(F.col(content))), F.col(position))).alias("_row"))
    return best.select(*(F.col("_first" if c == position else f"_row.{c}").alias(c) for c in rows.columns))


def keep_first(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The first row of each key."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in rows.columns)), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def unique_unless_null(rows: DataFrame, keys: tuple[str, ...], nullable: str, *order: str) -> DataFrame:
    """First of each (keys, nullable); rows whose nullable key is null are never the same."""
    return keep_first(rows.where(F.col(nullable).isNotNull()), (*keys, nullable), *order).unionByName(rows.where(F.col(nullable).isNull()))


def mark_primary(refs: DataFrame, *order: str) -> DataFrame:
    """is_primary_implementation and implementation_status: the first `implements` edge of a statute and act is primary and complete."""
    first = refs.where("reference_type = 'implements'").groupBy("document_id", "eu_document_id").agg(F.min(F.struct(*order)).alias("_first"))
    is_first = F.coalesce((F.struct(*order) == F.col("_first")) & (F.col("reference_type") == "implements"), F.lit(False))
    return refs.join(first, ["document_id", "eu_document_id"], "left").withColumns({"is_primary_implementation": is_first.cast("int"), "implementation_status": F.when(is_first, "complete").otherwise("unknown")}).drop("_first")


def override(found: DataFrame, curated: DataFrame, key: str, prefer: tuple[str, ...], own: tuple[str, ...]) -> DataFrame:
    """found with curated values: `prefer` columns from curated where there are any, `own` ones from found where there are."""
    extra = curated.select(key, *(F.col(c).alias(f"_{c}") for c in (*prefer, *own)))
    pick = {c: F.coalesce(f"_{c}", c) for c in prefer} | {c: F.coalesce(c, f"_{c}") for c in own}
    return found.join(extra, key, "left").withColumns(pick).select(found.columns)


#: What a statute without a description of its own is said to be.
DESCRIPTION = "Official Hungarian statute text from Nemzeti Jogszabalytar (njt.hu)."
_ACT = ("title", "title_en", "short_name", "status", "issued_date", "in_force_date", "url", "description")


def full_corpus(discovered: DataFrame, curated: DataFrame, subset: tuple[str, ...]) -> DataFrame:
    """id and what is known of each statute: discovered ones, with the curated act of the same document_id in their place.

    discovered: position, document_id and the columns of an act but short_name; curated: position, id, document_id and those
    of an act. Of the curated acts of a document the first that is not one of `subset` counts; url and status are the
    discovered ones, and the date in force if there is one. Acts of `subset` follow, and of equal ids the first stays.
    """
    whole = keep_first(curated.where(F.col("document_id").isNotNull() & ~F.col("id").isin(*subset)), ("document_id",), "position")
    both = discovered.join(whole.select("document_id", F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in _ACT)), "document_id", "left")
    own = F.col("_id").isNull()
    pick = {c: F.when(own, F.col(c) if c in discovered.columns else F.lit(None).cast("string")).otherwise(F.col(f"_{c}")) for c in _ACT if c not in ("url", "status", "in_force_date")}
    pick |= {"in_force_date": F.coalesce("in_force_date", "_in_force_date"), "description": F.when(own, F.coalesce("description", F.lit(DESCRIPTION))).otherwise(F.col("_description"))}
    found = both.select(F.coalesce("_id", F.concat(F.lit("hu-law-"), F.lower("document_id"))).alias("id"), *(pick.get(c, F.col(c)).alias(c) for c in _ACT), F.lit(0).alias("_after"), "position")
    aliases = curated.where(F.col("id").isin(*subset)).select("id", *_ACT, F.lit(1).alias("_after"), "position")
    return keep_first(found.unionByName(aliases), ("id",), "_after", "position").drop("_after", "position")


def fresh_cache(caches: DataFrame, in_force_only: bool, page_size: int) -> DataFrame:
    """Of kept discoveries (in_force_only, page_size, laws) those that answer this search: not empty, and made alike."""
    return caches.where((F.size("laws") > 0) & F.col("in_force_only").eqNullSafe(F.lit(in_force_only)) & F.col("page_size").eqNullSafe(F.lit(page_size)))


def hydrated(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages (document_id, html) with the markup of their deferred blocks (document_id, chunk, body) after them, in order."""
    late = blocks.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "body"))), lambda b: F.concat(F.lit("\n"), b["body"])), "").alias("_late"))
    return pages.join(late, "document_id", "left").withColumn("html", F.when(F.col("_late").isNull(), F.col("html")).otherwise(F.concat("html", F.lit("\n"), "_late"))).select(pages.columns)


def last_known(value: Column, key: str, position: str) -> Column:
    """The latest value that is not null, at or before a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))


def ranges(starts: DataFrame, key: str, start: str, size: int) -> DataFrame:
    """[start, next start) of each key, numbered in chunks of `size`."""
    order = Window.partitionBy(key).orderBy(start)
    return starts.select(key, start).distinct().withColumns({"stop": F.lead(start).over(order), "chunk": F.floor((F.row_number().over(order) - 1) / size)})
