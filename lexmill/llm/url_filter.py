"""URL filter: rules first, then the likelihood ratio of two smoothed variable-order Markov models of characters.

Everything on the path of the rows is DataFrame operations; the driver only picks a threshold from a bounded histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed

#: (host, path start, verdict). A rule fits its host and all subdomains; the longest fitting rule wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Characters of context, at most; what stands before a url and after it; characters that a model without counts expects.
ORDER = 4
BEFORE, AFTER = "\x02", "\x03"
ALPHABET = 256
#: A window that makes up more than one in so many of all is dealt over as many tasks as HOT_TASKS.
HOT_SHARE, HOT_TASKS = 1000, 64
#: Scores are binned by this for calibration, and cut off at this many bins on either side.
BIN, BINS = 0.01, 2000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_and_path(pages: DataFrame) -> DataFrame:
    rest = after_scheme(F.col("url"))
    return pages.withColumns({
        "host": F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _CAPITALS, _SMALL), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    })


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones stand before
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _windows(text: Column) -> Column:
    """For each character and the end: the ORDER characters before it, and itself."""
    padded = F.concat(F.lit(BEFORE * ORDER), text, F.lit(AFTER))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def _log_ratios(windows: DataFrame) -> DataFrame:
    """windows: w, a, r (counts in accepted and in rejected urls). Returns w, ratio: log P(accepted) - log P(rejected).

    Witten-Bell: P_k(c | context) = (n(context c) + kinds(context) * P_k-1) / (n(context) + kinds(context)).
    """
    below = None
    for k in range(1, ORDER + 2):
        gram = F.substring("w", ORDER + 2 - k, k)
        grams = windows.groupBy(gram.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.substring("g", 1, k - 1)) if k > 1 else Window.partitionBy(F.lit(0))
        grams = grams.withColumns({f"{how}_{m}": f(m).over(context) for m in "ar" for how, f in (("n", F.sum), ("t", lambda m: F.sum(F.when(F.col(m) > 0, 1).otherwise(0))))})
        if below is None:
            grams = grams.withColumns({"p_a": F.lit(1.0 / ALPHABET), "p_r": F.lit(1.0 / ALPHABET)})
        else:
            grams = grams.withColumn("lower", F.expr(f"substring(g, 2, {k - 1})")).join(below.withColumnRenamed("g", "lower"), "lower")
        p = {f"p_{m}": F.when(F.col(f"n_{m}") == 0, F.col(f"p_{m}")).otherwise((F.col(m) + F.col(f"t_{m}") * F.col(f"p_{m}")) / (F.col(f"n_{m}") + F.col(f"t_{m}"))) for m in "ar"}
        below = grams.select("g", *(v.alias(n) for n, v in p.items()))
    return below.select(F.col("g").alias("w"), (F.log("p_a") - F.log("p_r")).alias("ratio"))


def url_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """url, verdict of the rules, kept_back, score for each distinct url: mean log ratio a character, 6 decimals.

    The models count every url that a rule decides, but for those kept back for calibration (3 of 16 by digest). Windows that
    nearly all urls have, as those at their starts, are dealt over many tasks.
    """
    urls = host_and_path(pages.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct())
    _, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    urls = urls.select(
        "url",
        verdict.alias("verdict"),
        F.substring(F.md5("url"), 1, 1).isin("0", "1", "2").alias("kept_back"),
        F.coalesce(after_scheme(F.col("url")), F.col("url")).alias("text"),
    )
    each = urls.select(F.xxhash64("url").alias("h1"), F.xxhash64(F.lit("second"), "url").alias("h2"), "verdict", "kept_back", F.explode(_windows(F.col("text"))).alias("w"))
    learnt = lambda what: F.sum(F.when((F.col("verdict") == what) & ~F.col("kept_back"), 1).otherwise(0))
    counts = checkpointed(each.groupBy("w").agg(learnt("allow").alias("a"), learnt("block").alias("r"), F.count(F.lit(1)).alias("n")))
    every = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > every / HOT_SHARE).select("w", F.lit(HOT_TASKS).alias("tasks"))
    # HOT_SHARE rows at most, for their shares sum up to one.
    dealt = each.select("h1", "h2", "w").join(F.broadcast(hot), "w", "left").withColumn("task", F.coalesce(F.pmod("h1", "tasks"), F.lit(0).cast("long")))
    ratios = _log_ratios(counts).join(F.broadcast(hot), "w", "left").select("w", "ratio", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tasks", F.lit(1)).cast("long") - 1)).alias("task"))
    scored = dealt.select("h1", "h2", "w", "task").join(ratios, ["w", "task"]).groupBy("h1", "h2").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    named = urls.select("url", "verdict", "kept_back", F.xxhash64("url").alias("h1"), F.xxhash64(F.lit("second"), "url").alias("h2"))
    return named.join(scored, ["h1", "h2"]).select("url", "verdict", "kept_back", F.round("score", 6).alias("score"))


def threshold(scores: DataFrame) -> float:
    """The least-error cut between the urls kept back, both kinds weighing the same; 0 if a kind is missing.

    From the least of the best cuts; the histogram has 2 * BINS + 1 rows at most.
    """
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN))).cast("int")
    count = lambda what: F.sum(F.when(F.col("verdict") == what, 1).otherwise(0))
    bins = scores.where("kept_back and verdict is not null").groupBy(place.alias("bin")).agg(count("allow").alias("a"), count("block").alias("r")).collect()
    accepted, rejected = sum(b["a"] for b in bins), sum(b["r"] for b in bins)
    if not accepted or not rejected:
        return 0.0
    best, lost, caught = (1.0, min(b["bin"] for b in bins)), 0, 0
    for b in sorted(bins, key=lambda b: b["bin"]):
        lost, caught = lost + b["a"], caught + b["r"]
        best = min(best, (lost / accepted + (rejected - caught) / rejected, b["bin"] + 1))
    return best[1] * BIN


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each of pages (page_id, url; other columns are ignored).

    verdict is the rule's, else allow if the score reaches the calibrated threshold, else block. A null url has no host, no
    path, no rule and score 0; repeated rows stay; an empty table gives an empty result.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    scores = checkpointed(url_scores(plain, rules))
    cut = threshold(scores)
    host = host_and_path(plain)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    joined = host.withColumns({"rule": rule, "said": verdict}).join(scores.select("url", "score"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")
