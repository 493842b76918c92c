"""Tokens, term and phrase counts, and snippets, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import ACCENTED, PLAIN

WORD = r"[\p{L}\p{N}\p{Co}]+"


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, without diacritics. Null has none."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN)), F.lit(WORD), F.lit(0))


#: Letters that lose their mark in capitals alone, or have it in small letters alone.
_ODD, _SIGN, _RING = "[\u0130\u212b]", "\u212b", "\u00e5"
#: What is neither ASCII nor part of a token.
_APART = r"[\P{ASCII}&&[^\p{L}\p{N}\p{Co}]]+"


def spelled(c: Column) -> Column:
    """A lower-case text whose tokens are its runs of ASCII letters, digits and whatever is not ASCII, some with diacritics yet.

    Taking those off a whole text costs more than all else; `plain` takes them off a token.
    """
    c = F.coalesce(c, F.lit(""))
    odd = F.replace(F.lower(F.translate(c, ACCENTED, PLAIN)), F.lit(_RING), F.lit(_SIGN))  # it has come of the sign, and stays
    whole = F.when(c.rlike(_ODD), odd).otherwise(F.lower(c))
    return F.when(c.rlike(r"\P{ASCII}"), F.regexp_replace(whole, _APART, " ")).otherwise(F.lower(c))


_PLAIN = str.maketrans(ACCENTED + _SIGN, PLAIN + _RING)


def plain(token: str) -> str:
    return token if token.isascii() else token.translate(_PLAIN)


def _same(token: Column, said: str, prefix: bool) -> Column:
    return token.startswith(said) if prefix else token == said


def phrase_places(toks: Column, phrase: tuple[str, ...], prefix: bool) -> Column:
    """Where (from 1) a phrase begins in a token array; with `prefix`, its last token may go on."""
    if not phrase:
        return F.array().cast("array<int>")
    if len(phrase) == 1:
        places = F.transform(toks, lambda t, i: F.when(_same(t, phrase[0], prefix), i + 1))
        return F.filter(places, lambda p: p.isNotNull())
    size = len(phrase)
    every = F.when(F.size(toks) >= size, F.sequence(F.lit(1), F.size(toks) - size + 1)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        fits = F.lit(True)
        for k, said in enumerate(phrase):
            fits = fits & _same(F.element_at(toks, i + k), said, prefix and k == size - 1)
        return fits

    first = F.array_contains(toks, phrase[0])
    return F.when(first, F.filter(every, here)).otherwise(F.array().cast("array<int>"))


def phrase_count(toks: Column, phrase: tuple[str, ...], prefix: bool) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: _same(t, phrase[0], prefix)))
    return F.size(phrase_places(toks, phrase, prefix))


def _covered(places: Column, size: int) -> Column:
    """Every token of phrases of one size that begin at these places."""
    return F.flatten(F.transform(places, lambda i: F.sequence(i, i + (size - 1))))


def _within(places: Column, size: int, start: Column, width: int) -> Column:
    return F.exists(places, lambda i: (i >= start) & (i + (size - 1) < start + width))


def with_snippet(df: DataFrame, text: str, phrases: list[tuple[tuple[str, ...], bool]], out: str = "snippet", before: str = ">>>", after: str = "<<<", gap: str = "...", width: int = 32) -> DataFrame:
    """Adds up to `width` tokens of a text with the most distinct phrases, the earliest of those, matches marked.

    Text between tokens stays as it is. Sides that are cut show `gap`. Without a match it is the start of the text. Steps
    are columns of their own, so that nothing is worked out anew for every token.
    """
    sizes = [len(p) for p, _ in phrases]
    places = [f"_at{i}" for i in range(len(phrases))]
    step = df.withColumns({"_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_between": F.split(text, WORD), "_toks": tokens(F.col(text))})
    step = step.withColumns({"_n": F.size("_words")} | {c: phrase_places(F.col("_toks"), p, x) for c, (p, x) in zip(places, phrases, strict=True)})
    if len(phrases) == 1:
        first = F.coalesce(F.try_element_at(places[0], F.lit(1)), F.lit(1))
        start = F.greatest(F.lit(1), F.least(first, F.col("_n") - (width - 1)))
    else:
        starts = F.array_distinct(F.concat(F.array(F.lit(1)), *(F.transform(c, lambda i: F.greatest(F.lit(1), F.least(i, F.col("_n") - (width - 1)))) for c in places)))

        def worth(s: Column) -> Column:
            hits = F.lit(0)
            for c, k in zip(places, sizes, strict=True):
                hits = hits + _within(F.col(c), k, s, width).cast("int")
            return F.struct(hits.alias("hits"), (-s).alias("s"))

        start = -F.array_max(F.transform(starts, worth)).getField("s")
    step = step.withColumn("_start", start).withColumn("_stop", F.least(F.col("_n"), F.col("_start") + (width - 1)))
    inside = [F.filter(_covered(F.col(c), k), lambda i: i.between(F.col("_start"), F.col("_stop"))) for c, k in zip(places, sizes, strict=True)]
    step = step.withColumn("_marked", F.array_distinct(F.concat(*inside)) if inside else F.array().cast("array<int>"))

    def shown(i: Column) -> Column:
        word = F.element_at("_words", i)
        word = F.when(F.array_contains("_marked", i), F.concat(F.lit(before), word, F.lit(after))).otherwise(word)
        return F.concat(F.when(i > F.col("_start"), F.element_at("_between", i)).otherwise(F.lit("")), word)

    body = F.array_join(F.transform(F.sequence("_start", "_stop"), shown), "")
    cut = F.concat(F.when(F.col("_start") > 1, F.lit(gap)).otherwise(F.element_at("_between", F.lit(1))), body, F.when(F.col("_stop") < F.col("_n"), F.lit(gap)).otherwise(F.element_at("_between", F.col("_n") + 1)))
    return step.withColumn(out, F.when(F.col("_n") == 0, F.col(text)).otherwise(cut)).select(*(c for c in df.columns if c != out), out)
