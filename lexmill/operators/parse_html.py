"""From the HTML of statutes to provisions and definitions. Folds over a document's blocks are windows by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.dedupe import keep_first, last_known

#: Words in block classes.
CONTENT_CLASS = r"(?i)(szakasz|bekezdes|pont|alpont|mondat|szoveg|szelet)"
LEGACY_CLASS = r"(?i)(preambulum|bekezdes|pont|alpont|mondat|szoveg|szelet)"
#: Documents of which only some sections belong to the collection, and which keep their given title.
SECTION_RANGES = {"act-cxii-2011-public-data": (26, 39)}
SECTION_SETS = {"criminal-code-cybercrime": ("422", "423", "424")}
KEEPS_TITLE = (*SECTION_RANGES, *SECTION_SETS)
#: What marks a block, and how a definition is written.
MARKER = r'<span class="jhId" id="([^"]+)"></span>'
DEFINITION = rf"(?<![0-9A-Za-z_])\d+\.{X.SPACES}*([^:;]{{2,120}}):{X.SPACES}*([^;]{{10,500}})(?=;{X.SPACES}*\d+\.|\z)"


def blocks(pages: DataFrame) -> DataFrame:
    """id, pos, block_id, block_class, html: what stands between a marker and the next. Empty blocks are dropped."""
    ids = F.regexp_extract_all("html", F.lit(MARKER), F.lit(1))
    parts = F.slice(F.split("html", MARKER), 2, F.size(ids))
    # Not `posexplode`: the filter that is inferred from it would read every page a second time.
    each = pages.select("id", F.posexplode_outer(F.arrays_zip(ids.alias("block_id"), parts.alias("html"))).alias("pos", "b")).where(F.col("b.html").rlike(r"\S"))
    trimmed = each.select("id", "pos", "b.block_id", F.regexp_replace("b.html", r"^\s+|\s+\z", "").alias("html"))
    return trimmed.withColumn("block_class", F.regexp_extract("html", r'(?i)^<(?:div|h1|h2)\b[^>]*class="([^"]*)"', 1))


def is_content(c: Column) -> Column:
    return c.rlike(CONTENT_CLASS)


def is_legacy_content(c: Column) -> Column:
    return c.rlike(LEGACY_CLASS)


def belongs(doc: Column, section: Column) -> Column:
    base = F.coalesce(F.regexp_extract(section, r"^(\d+)", 1).try_cast("int"), F.lit(0))
    ok = F.lit(True)
    for name, (low, high) in SECTION_RANGES.items():
        ok = F.when(doc == name, base.between(low, high)).otherwise(ok)
    for name, sections in SECTION_SETS.items():
        ok = F.when(doc == name, section.isin(*sections)).otherwise(ok)
    return ok


def fold(rows: DataFrame) -> DataFrame:
    """Sections of a document's blocks in order.

    rows: id, pos, own_key (null where a block names no section), content (whether its class is content), label (the section
    as the block has it, else null), number and title (of a chapter, where the block is one), text. A block without a key of
    its own belongs to the section before it if it is content. Returns id, pos (of the first block), key, chapter, label,
    content.
    """
    carried = rows.withColumns({"_key": last_known(F.col("own_key"), "id", "pos"), "_number": last_known(F.col("number"), "id", "pos"), "_title": last_known(F.col("title"), "id", "pos")})
    members = carried.where("own_key is not null or (content and _key is not null)")
    chapter = F.nullif(F.concat_ws(" - ", F.nullif("_number", F.lit("")), F.nullif("_title", F.lit(""))), F.lit(""))
    kept = (F.col("content") | F.col("label").isNotNull()) & (F.col("text") != "")
    grouped = members.groupBy("id", F.col("_key").alias("key")).agg(
        F.min("pos").alias("pos"),
        F.min_by(chapter, "pos").alias("chapter"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("pos"))).alias("label"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "text")))).alias("_parts"),
    )
    return grouped.select("id", "pos", "key", "chapter", F.coalesce("label", X.section_from_key(F.col("key"))).alias("section"), X.spaced(F.array_join(F.col("_parts.text"), " ")).alias("content"))


def keyed(each: DataFrame) -> DataFrame:
    """Blocks with what `fold` needs of them."""
    marker = F.regexp_extract("html", r'(?i)<span class="szakasz-jel">([\s\S]*?)</span>', 1)
    with_text = each.withColumn("text", X.html_to_text(F.col("html")))
    section = F.coalesce(F.when(F.col("html").rlike('(?i)<span class="szakasz-jel">'), X.section_from_marker(marker)), X.section_from_text(F.col("text")))
    named = with_text.withColumns({"_section": F.nullif(section, F.lit("")), "_article": X.article_from_text(F.col("text"))})
    return named.withColumns({
        "own_key": F.coalesce(X.key_from_block_id(F.col("block_id")), X.section_to_key(F.col("_section")), X.article_key(F.col("_article"))),
        "label": F.coalesce("_section", "_article"),
        "content": is_content(F.col("block_class")),
        "number": F.when(F.col("block_class") == "fejezet", F.col("text")),
        "title": F.when(F.col("block_class") == "fejezetCim", F.col("text")),
    })


def provisions(pages: DataFrame) -> DataFrame:
    """document_id, pos, provision_ref, chapter, section, title, content of pages (id, html).

    A document without any section has each block of legacy content as a provision of its own, numbered from 1.
    """
    each = keyed(blocks(pages)).withColumn("_legacy", is_legacy_content(F.col("block_class")) & (F.col("text") != ""))
    known = each.withColumns({"_bare": F.max(F.col("own_key").isNotNull()).over(Window.partitionBy("id")) == F.lit(False), "_turn": F.count_if("_legacy").over(Window.partitionBy("id").orderBy("pos"))})
    unless = lambda c, bare: F.when(F.col("_bare"), bare).otherwise(F.col(c))
    rows = known.withColumns({
        "own_key": unless("own_key", F.when(F.col("_legacy"), F.concat(F.lit("LEGACY_"), F.col("_turn").cast("string")))),
        "content": unless("content", F.col("_legacy")),
        "number": unless("number", F.lit(None)),
        "title": unless("title", F.lit(None)),
    })
    every = fold(rows).where("content != ''").where(belongs(F.col("id"), F.col("section")))
    return every.select(F.col("id").alias("document_id"), "pos", X.provision_ref(F.col("section")).alias("provision_ref"), "chapter", "section", X.title_from_key(F.col("key"), F.col("section")).alias("title"), "content")


def definitions(rows: DataFrame) -> DataFrame:
    """document_id, term, definition, source_provision: numbered terms of provisions that define; the first of each term stays."""
    found = rows.where(F.col("content").rlike("(?iu)alkalmazásában")).select(
        "document_id", "provision_ref", "pos",
        F.posexplode(F.arrays_zip(F.regexp_extract_all("content", F.lit(DEFINITION), F.lit(1)).alias("term"), F.regexp_extract_all("content", F.lit(DEFINITION), F.lit(2)).alias("definition"))).alias("turn", "d"),
    )
    each = found.select("document_id", F.trim("d.term").alias("term"), F.trim("d.definition").alias("definition"), F.col("provision_ref").alias("source_provision"), "pos", "turn").where("length(term) >= 2 and length(definition) >= 10")
    first = keep_first(each.withColumn("_low", F.lower("term")), ("document_id", "_low", "source_provision"), "pos", "turn")
    return first.select("document_id", "term", "definition", "source_provision", "pos", "turn")


def official_title(html: Column) -> Column:
    """Main title and subtitle; of several subtitles the first that is no main title, else the last. Null without a title."""
    main = X.html_to_text(F.regexp_extract(html, r'(?i)<h1[^>]*class="[^"]*jogszabalyMainTitle[^"]*"[^>]*>([\s\S]*?)</h1>', 1))
    pattern = r'(?i)<h2[^>]*class="([^"]*jogszabalySubtitle[^"]*)"[^>]*>([\s\S]*?)</h2>'
    subs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("c"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("t"))
    plain = F.filter(subs, lambda s: ~s["c"].rlike(r"(?i)(?<![0-9A-Za-z_])mainTitle(?![0-9A-Za-z_])"))
    sub = X.html_to_text(F.coalesce(F.try_element_at(plain, F.lit(1))["t"], F.try_element_at(subs, F.lit(-1))["t"], F.lit("")))
    return F.nullif(F.when((sub != "") & (sub != main), F.trim(F.concat(main, F.lit(" "), sub))).otherwise(main), F.lit(""))


def usable(html: Column) -> Column:
    """Whether a page holds a title and at least one block; else its act is kept without provisions."""
    return F.contains(html, F.lit("jogszabalyMainTitle")) & F.contains(html, F.lit('class="jhId"'))
