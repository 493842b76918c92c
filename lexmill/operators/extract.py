"""References to supranational acts in running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.dedupe import keep_first

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_S = X.SPACES
#: How an act is cited. Three notations: the community in brackets (pattern 0), after the number (1), or nowhere (2).
_COMMUNITY = "(EU|EC|EEC|Euratom)"
_NUMBERS = rf"(?:No\.?{_S}*)?(\d{{2,4}})/(\d{{1,4}})"
ACT = rf"{_B}(Regulation|Directive){_S}*(?:\({_COMMUNITY}\){_S}*{_NUMBERS}{_E}|{_NUMBERS}(?:/{_COMMUNITY})?{_E})"
CONTEXT = 120
#: What an article is called, and words that tell of an implementation.
_ARTICLE = rf"(?i){_B}Article{_S}+(\d+[A-Za-z]?(?:\(\d+\))?)"
_IMPLEMENTS = rf"(?i){_B}(implement|align|transpos|equivalent){_E}"


def _cited(text: Column) -> Column:
    """at, upto (what stands from the citation before to the end of this one) of each citation, in one pass over the text.

    A citation has one name of a kind, at its start, so that no two overlap.
    """
    upto = F.regexp_extract_all(text, F.lit(rf"(?i)\G(?s:.*?)(?=[RD]){ACT}"), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<end:int,upto:string>>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        end = s["end"] + F.length(c)
        return F.struct(end.alias("end"), F.concat(s["found"], F.array(F.struct(end.alias("end"), c.alias("upto")))).alias("found"))

    return F.aggregate(upto, start, step, lambda s: s["found"])


def context(text: Column, at: Column, size: Column) -> Column:
    """A match and what stands within CONTEXT characters of it."""
    start = F.greatest(F.lit(1), at - CONTEXT)
    return X.spaced(F.substring(text, start, at + size + CONTEXT - start))


def eu_references(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A row a reference: key, pattern, at, type, year, number, community, eu_document_id, eu_article, reference_type, reference_context, full_citation.

    Of the references of a text to one act and article the first stays, by pattern and then by place.
    """
    mentions = rows.where(F.col(text).rlike("(?i)(Regulation|Directive)")).select(key, F.col(text).alias("_text"))
    # Not `explode`: the filter that is inferred from it would read every text a second time.
    cited = mentions.select(key, "_text", F.explode_outer(_cited(F.col("_text"))).alias("c")).where("c IS NOT NULL")
    said = cited.select(key, "_text", F.col("c.end").alias("_end"), F.regexp_extract("c.upto", rf"(?i){ACT}\z", 0).alias("_said"))
    group = lambda i: F.nullif(F.regexp_extract("_said", f"(?i){ACT}", i), F.lit(""))
    parts = said.select("*", F.lower(group(1)).alias("type"), group(2).alias("_before"), X.two_digit_year(F.coalesce(group(3), group(5))).alias("year"), F.coalesce(group(4), group(6)).try_cast("int").alias("number"), group(7).alias("_after"))
    # What names its community after the number reads as an act without one, too.
    form = lambda k, community, cut: F.struct(F.lit(k).alias("pattern"), community.alias("community"), F.substring(F.col("_said"), F.lit(1), F.length("_said") - cut).alias("full_citation"))
    plain = form(2, F.lit("EU"), F.coalesce(F.length("_after") + 1, F.lit(0)))
    forms = F.when(F.col("_before").isNotNull(), F.array(form(0, F.upper("_before"), F.lit(0)))).when(F.col("_after").isNotNull(), F.array(form(1, F.upper("_after"), F.lit(0)), plain)).otherwise(F.array(plain))
    # A filter on year and number themselves would be pushed below, with all that they are read from.
    each = parts.select(key, "_text", (F.col("_end") - F.length("_said") + 1).alias("at"), "type", "year", "number", F.explode_outer(F.when((F.col("year") > 0) & (F.col("number") > 0), forms)).alias("f"))
    each = each.where("f IS NOT NULL").select(key, "_text", "f.pattern", "at", "type", "year", "number", "f.community", "f.full_citation")
    named = each.withColumn("eu_document_id", F.format_string("%s:%d/%d", "type", "year", "number")).withColumn("reference_context", context(F.col("_text"), F.col("at"), F.length("full_citation"))).drop("_text")
    full = named.withColumns({"eu_article": F.nullif(F.regexp_extract("reference_context", _ARTICLE, 1), F.lit("")), "reference_type": F.when(F.col("reference_context").rlike(_IMPLEMENTS), "implements").otherwise("references")})
    return keep_first(full.withColumn("_article", F.coalesce("eu_article", F.lit(""))), (key, "eu_document_id", "_article"), "pattern", "at").drop("_article")


def act_url(kind: Column, year: Column, number: Column) -> Column:
    code = F.when(kind == "regulation", "R").otherwise("L")
    return F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:3"), year.cast("string"), code, F.lpad(number.cast("string"), 4, "0"))
