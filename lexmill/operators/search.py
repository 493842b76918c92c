"""Ranked text search over provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import tokens as T
from lexmill.operators.index import B, K1, LEAST_IDF
from lexmill.operators.resolve import resolve_one
from lexmill.plans import ftsquery as Q
from lexmill.schema import Answer, Store
from lexmill.storage import checkpoint_dir

DEFAULT_LIMIT, MOST = 10, 50
RESULT = ["document_id", "document_title", "provision_ref", "chapter", "section", "title", "snippet", "relevance"]


def tokenized(provisions: DataFrame) -> DataFrame:
    """Adds the tokens of content and title, and their number.

    They come out of a generator. No filter on them is pushed below it, where it would split the text anew for every token.
    """
    each = F.inline(F.array(F.struct(T.tokens(F.col("content")).alias("_c"), T.tokens(F.col("title")).alias("_t"))))
    return provisions.select("*", each).withColumn("_n", F.size("_c") + F.size("_t"))


def count_of(phrase: Q.Phrase) -> Column:
    return T.phrase_count(F.col("_c"), phrase.words, phrase.prefix) + T.phrase_count(F.col("_t"), phrase.words, phrase.prefix) if phrase.words else F.lit(0)


def matches(tree, counts: dict[Q.Phrase, Column]) -> Column:
    if isinstance(tree, Q.Phrase):
        return counts[tree] > 0
    parts = [matches(p, counts) for p in tree.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.kind == "and" else out | p if tree.kind == "or" else out & ~p
    return out


def counted(provisions: DataFrame, phrases: list[Q.Phrase]) -> tuple[DataFrame, dict[Q.Phrase, Column]]:
    """Adds a count for each phrase in one pass over the tokens."""
    names = {p: f"_f{i}" for i, p in enumerate(phrases)}
    return tokenized(provisions).withColumns({n: count_of(p) for p, n in names.items()}).drop("_c", "_t"), {p: F.col(n) for p, n in names.items()}


def statistics(counts: DataFrame, columns: dict[Q.Phrase, Column], extra: list[Column] = ()):
    """One row over the whole index: rows, mean length, rows with each phrase; with map-side combine."""
    return counts.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("mean"), *(F.sum((c > 0).cast("long")).alias(f"d{i}") for i, c in enumerate(columns.values())), *extra).first()


def bm25(stats, columns: dict[Q.Phrase, Column], used: list[Q.Phrase]) -> Column:
    """Okapi BM25, negated: the more negative, the better."""
    score = F.lit(0.0)
    for i, (phrase, f) in enumerate(columns.items()):
        if phrase in used:
            n, d = float(stats["n"]), float(stats[f"d{i}"] or 0)
            idf = F.greatest(F.log(F.lit((n - d + 0.5) / (d + 0.5))), F.lit(LEAST_IDF))
            score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(stats["mean"] or 1.0)))
    return -score


def plans(query: str) -> list:
    """The trees of a query's variants; None for a variant that is a syntax error."""
    out = []
    for variant in Q.variants(Q.sanitize(query)):
        try:
            out.append(Q.parse(variant))
        except Q.QuerySyntaxError:
            out.append(None)  # passed over, but still a rung of the ladder
    return out


def plain_words(tree) -> tuple[list[str], bool] | None:
    """The words of a tree that is one word, or any of some, or all of some; and whether it is all. None for other trees."""
    parts = tree.parts if isinstance(tree, Q.Op) and tree.kind != "not" else (tree,)
    if not all(isinstance(p, Q.Phrase) and len(p.words) == 1 and not p.prefix for p in parts):
        return None
    return [p.words[0] for p in parts], isinstance(tree, Q.Op) and tree.kind == "and"


def first_per_provision(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """Of the 2 * limit best rows, the best of each title and reference, and of those `limit`."""
    fetched = rows.orderBy(*order).limit(2 * limit)
    first = Window.partitionBy("document_title", "provision_ref").orderBy(*order)
    return fetched.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").orderBy(*order).limit(limit)


def search(store: Store, query: str | None, document: str | None = None, status: str | None = None, limit: int | None = None) -> Answer:
    """Provisions that match the strictest variant of the query that any provision matches, the best first.

    With a stored index, the postings of the query's tokens are all that is read of the texts: where the strictest variant is
    one of words alone, blocks in the order of what they can score, else all of them, whose counts tell which variant is met
    and are scored. Without one, a pass over the texts counts the phrases of all variants. Of the best, texts are read by id.
    If no variant is met, contents are searched for the words in order, with an index in blocks that have all of their runs of
    letters and digits.
    """
    spark = store.spark
    nothing = spark.createDataFrame([], "document_id string, document_title string, provision_ref string, chapter string, section string, title string, snippet string, relevance double")
    if not query or not query.strip():
        return Answer(nothing)
    limit = Q.clamp(limit, DEFAULT_LIMIT, MOST)
    docs, provisions = store["legal_documents"], store["legal_provisions"]
    if document:
        resolved = resolve_one(docs, document)
        if resolved is None:
            return Answer(nothing, f'No document found matching "{document}"')
    wanted = docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("status").alias("_status"))
    if document:
        wanted = wanted.where(F.col("document_id") == resolved)
    if status:
        wanted = wanted.where(F.col("_status") == status)
    trees = plans(query)
    every = list(dict.fromkeys(p for t in trees if t is not None for p in Q.phrases(t)))
    if every:
        keys = provisions.select("id", "document_id", "provision_ref")
        words = plain_words(trees[0]) if store.index and trees[0] is not None else None
        if words:
            top, _ = store.index.top(words[0], 2 * limit, words[1], keys.join(wanted.select("document_id"), "document_id", "left_semi"))
            scored = top.join(keys, "id").join(wanted, "document_id")
            best = first_per_provision(scored, [F.col("relevance"), F.col("id")], limit).select("id", "document_title", "relevance").collect()
            if best:
                return Answer(_shown(provisions, best, Q.phrases(trees[0])))
        checkpoint_dir(spark)
        if store.index:
            counts, columns = store.index.counted(every)
            counts = counts.join(keys, "id").checkpoint()
        else:
            # Texts are split once; their counts are written, and read for statistics and scores.
            counts, columns = counted(provisions, every)
            counts = counts.drop(*(c for c in provisions.columns if c not in ("id", "document_id", "provision_ref"))).checkpoint()
        met = [matches(t, columns) if t is not None else F.lit(False) for t in trees]
        tier = F.lit(None).cast("int")
        for i, m in reversed(list(enumerate(met))):
            tier = F.when(m, i).otherwise(tier)
        inside = wanted.select("document_id", F.lit(True).alias("_in"))
        stats = statistics(counts.join(inside, "document_id", "left"), columns, [F.min(F.when(F.col("_in"), tier)).alias("tier")]).asDict()
        if store.index:
            stats |= {"n": store.index.rows, "mean": store.index.mean}
        if stats["tier"] is not None:
            tree = trees[stats["tier"]]
            used = Q.phrases(tree)
            scored = counts.where(matches(tree, columns)).withColumn("relevance", F.round(bm25(stats, columns, used), 6)).join(wanted, "document_id")
            best = first_per_provision(scored, [F.col("relevance"), F.col("id")], limit).select("id", "document_title", "relevance").collect()
            return Answer(_shown(provisions, best, used), strategy="broadened" if stats["tier"] else None)
    pattern = Q.like_pattern(Q.sanitize(query))
    among = provisions.select("id", "document_id").join(wanted.select("document_id"), "document_id", "left_semi")
    told = store.index.like(provisions, pattern, X.like_ascii(F.col("content"), pattern), 2 * limit, among) if store.index else None
    found = like_search(provisions, pattern) if told is None else provisions.where(F.col("id").isin(told[0]))
    found = found.join(wanted, "document_id")
    rows = first_per_provision(found, [F.col("id")], limit)
    rows = rows.withColumns({"snippet": F.substring("content", 1, 200), "relevance": F.lit(0.0)}).orderBy("id").select(RESULT)
    return Answer(rows, strategy="like_fallback" if rows.limit(1).count() else None)


def _shown(provisions: DataFrame, best: list, used: list[Q.Phrase]) -> DataFrame:
    """The result's columns for the best rows, `limit` at most, whose texts are read by id."""
    texts = provisions.where(F.col("id").isin([r["id"] for r in best])).join(F.broadcast(provisions.sparkSession.createDataFrame(best, "id long, document_title string, relevance double")), "id")
    return T.with_snippet(texts, "content", [(p.words, p.prefix) for p in used if p.words]).orderBy("relevance", "id").select(RESULT)


def like_search(provisions: DataFrame, pattern: str) -> DataFrame:
    return provisions.where(X.like_ascii(F.col("content"), pattern))


def stance(store: Store, query: str | None, document: str | None = None, limit: int | None = None) -> Answer:
    found = search(store, query, document, limit=Q.clamp(limit, 5, 20))
    return Answer(found.rows.drop("chapter"), found.note, found.strategy)
