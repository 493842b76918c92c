"""From what a user calls a document to its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.storage import checkpoint_dir, numbered


#: The columns of a document that a part of its title may stand in.
TITLES = ("title", "short_name", "title_en")
#: Characters of the grams that a part and a title must share: the longest that the part has room for.
GRAMS = (1, 2, 3, 8)
#: Titles that a gram may lead a part to at once.
HOT = 1000


def _in_title(said: Column) -> Column:
    pattern = F.concat(F.lit("%"), X.ascii_lower(said), F.lit("%"))
    part = F.lit(False)
    for c in TITLES:
        part = part | F.coalesce(F.like(X.ascii_lower(F.col(c)), pattern, F.lit("\x01")), F.lit(False))
    return part


def match_tier(docs: DataFrame, said: Column) -> Column:
    """How a row of docs answers to a name: 0 its id, 1 a formal reference, 2 an id with a tail, 3 part of a title; else null."""
    return F.when(F.col("id") == said, 0).when(F.col("id") == X.formal_ref_to_id(said), 1).when(F.col("id") == X.id_prefix(said), 2).when(_in_title(said), 3)


def _grams(c: Column, size: int) -> Column:
    """All grams of a text, each once; none if it is shorter."""
    n = F.char_length(c) - size + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(size))))


def _gram_size(size: Column) -> Column:
    """The longest of GRAMS that a piece of this size has room for; 0 for an empty one."""
    out = F.lit(0)
    for g in GRAMS:
        out = F.when(size >= g, g).otherwise(out)
    return out


def _held(pairs: DataFrame, titles: DataFrame, column: str) -> DataFrame:
    """column, id: of pairs (column, _said, id) those whose name stands in a title of the id."""
    pattern = F.concat(F.lit("%"), X.ascii_lower(F.col("_said")), F.lit("%"))
    return pairs.join(titles, "id").where(F.like("_title", pattern, F.lit("\x01"))).select(column, "id")


def in_titles(docs: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """column, document_id: for each of names (column, _said) the least id with the name in a title, where there is one.

    A name meets the titles that hold the rarest gram of its longest piece without wildcards, and is then held against them
    alone. Where even that gram is in more than HOT titles, these come in the order of their ids, in rounds of four times as
    many each; who has been found goes, as none later has a smaller id. A name of wildcards only fits all titles of its length
    or more: the least id for each length answers it.
    """
    checkpoint_dir(docs.sparkSession)
    low = X.ascii_lower(F.col("_said"))
    piece = F.array_max(F.transform(F.split(low, "[%_]"), lambda p: F.struct(F.char_length(p).alias("size"), p.alias("text"))))
    each = names.withColumn("_piece", piece).select(column, "_said", F.col("_piece.text").alias("_text"), _gram_size(F.col("_piece.size")).alias("_size")).checkpoint()
    titles = docs.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*(X.ascii_lower(F.col(c)) for c in TITLES))))).alias("_title")).checkpoint()
    sizes = sorted(r[0] for r in each.select("_size").distinct().collect())  # of GRAMS
    found = each.select(column, F.lit(None).cast("string").alias("id")).limit(0)
    if any(sizes):
        grams = titles.select("id", F.explode(F.array_distinct(F.concat(*(_grams(F.col("_title"), k) for k in sizes if k)))).alias("_gram"))
        own = F.lit(None).cast("array<string>")
        for k in sizes:
            own = F.when(F.col("_size") == k, _grams(F.col("_text"), k)).otherwise(own) if k else own
        wanted = each.where("_size > 0").select(column, "_said", F.explode(own).alias("_gram"))
        spread = grams.join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
        rarest = wanted.join(spread, "_gram", "left").groupBy(column, "_said").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_least"))
        # A gram that no title has leads nowhere.
        led = rarest.where("_least.n > 0").select(column, "_said", F.col("_least.n").alias("_n"), F.col("_least.g").alias("_gram")).checkpoint()
        found = _held(led.where(F.col("_n") <= HOT).join(grams, "_gram").select(column, "_said", "id").distinct(), titles, column)
        left = led.where(F.col("_n") > HOT)
        if left.limit(1).count():
            found = found.unionByName(_in_rounds(left, grams, titles, column))
    lengths = titles.groupBy(F.char_length("_title").alias("_n")).agg(F.min("id").alias("id"))
    fits = lengths.select("id", F.explode(F.sequence(F.lit(0), "_n")).alias("_n")).groupBy("_n").agg(F.min("id").alias("id"))
    loose = each.where("_size = 0").select(column, F.char_length(F.replace("_said", F.lit("%"), F.lit(""))).alias("_n")).join(fits, "_n")
    return found.unionByName(loose.select(column, "id")).groupBy(column).agg(F.min("id").alias("document_id"))


def _in_rounds(left: DataFrame, grams: DataFrame, titles: DataFrame, column: str) -> DataFrame:
    """column, id: the least id of each name of `left` (column, _said, _gram), whose grams are in many titles."""
    place = ordered(titles.select("id").distinct(), "id")
    turn = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.col("_place") / HOT))).cast("int")
    dealt = grams.join(left.select("_gram").distinct(), "_gram", "left_semi").join(place.select("id", turn.alias("_turn")), "id").checkpoint()
    out = left.select(column, F.lit(None).cast("string").alias("id")).limit(0)
    for k in sorted(r[0] for r in dealt.select("_turn").distinct().collect()):  # as many as the logarithm of the titles
        met = _held(left.join(dealt.where(F.col("_turn") == k), "_gram").select(column, "_said", "id").distinct(), titles, column)
        met = met.groupBy(column).agg(F.min("id").alias("id")).checkpoint()
        out, left = out.unionByName(met), left.join(met.select(column), column, "left_anti").checkpoint()
        if not left.limit(1).count():
            break
    return out


def ordered(rows: DataFrame, column: str) -> DataFrame:
    """rows with `_place`, from 1 in the order of a column, dealt by ranges."""
    return numbered(rows.withColumnRenamed(column, "_key"), "_key").select(F.col("_key").alias(column), F.col("id").alias("_place"))


def resolve(docs: DataFrame, names: DataFrame, column: str = "said") -> DataFrame:
    """Adds document_id to names: the best tier, then the least id; null if nothing answers or the name is blank.

    Equal ids join by hash; only names without one are held against titles, by way of shared grams.
    """
    trimmed = F.trim(F.col(column))
    each = names.select(column).distinct().withColumn("_said", trimmed).where("_said != ''")
    keyed = each.withColumn("_key", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("tier"), F.col("_said").alias("id")), F.struct(F.lit(1).alias("tier"), X.formal_ref_to_id(F.col("_said")).alias("id")), F.struct(F.lit(2).alias("tier"), X.id_prefix(F.col("_said")).alias("id"))))))
    exact = keyed.select(column, "_key.tier", F.col("_key.id").alias("id")).join(docs.select("id"), "id").groupBy(column).agg(F.min_by("id", F.struct("tier", "id")).alias("document_id"))
    titled = in_titles(docs, each.join(exact, column, "left_anti"), column)
    return names.join(exact.unionByName(titled), column, "left")


def resolve_one(docs: DataFrame, said: str | None) -> str | None:
    """The id that one name means; a single pass over docs."""
    if not said or not said.strip():
        return None
    tier = match_tier(docs, F.lit(said.strip()))
    row = docs.select("id", tier.alias("tier")).where("tier is not null").agg(F.min_by("id", F.struct("tier", "id")).alias("id")).first()
    return row["id"]
