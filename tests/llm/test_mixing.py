from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import mixing as M
from tests.llm.helpers import ODD, texts

DOCS = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("text", "source", "size", "_turn", "target")])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def filled(sizes, weights, share, most):
    """Targets by the rule itself, in fractions: share out, stop what is above, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cap = Fraction(share) * sum(sizes.values()), {s: Fraction(most) * n for s, n in sizes.items()}
    stopped = set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(cap[s] for s in stopped)
        target = {s: cap[s] if s in stopped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > cap[s]}
        if not over:
            return target
        stopped |= over


def case():
    said = texts(900, 21, 30) + ODD
    sources = ["a", "b", "é", None, "Z", "", "zz", "tiny"]
    rows = [(i, t, sources[0 if i % 3 == 0 else i % 7]) for i, t in enumerate(said)]
    return rows + [(5000, "one word more", "tiny"), (None, "no id", "a"), (None, None, "a"), (5001, None, "silent"), (5002, "", "silent"), (5003, "big " * 3000, "b")]


@pytest.mark.parametrize("weights, share, most", [((3, 1, 2), 1.5, 2.0), ((1,), 0.4, 1.0), ((5, 1), 2.5, 3.0)])
def test_targets_sizes_and_copies(spark, weights, share, most):
    rows = case()
    got = M.taken(table(spark, rows).repartition(3), weights, share, most).collect()
    size = lambda t: len((t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).replace(" ", "x").split(" ")) - (t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ").count("")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "")
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in got), key=key) == sorted(((d, size(t), s) for d, t, s in rows), key=key)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = filled(sizes, weights, share, most)
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {n} and all(abs(r["target"] - float(want[s])) < 1e-6 * max(1, n) for r in own)
        rate = want[s] / n if n else 0
        for r in own:
            assert r["taken"] in ((r["size"] * int(rate), r["size"] * (int(rate) + 1)) if rate != int(rate) else (r["size"] * int(rate),)) and r["taken"] <= most * r["size"]
        if n > 1000:  # a document is taken whole: the largest one's size is the least step
            assert abs(sum(r["taken"] for r in own) - want[s]) <= max(0.02 * want[s], 40, max(r["size"] for r in own) / 2)
    again = M.taken(table(spark, rows[::-1]).repartition(5), weights, share, most).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_repeats_rows(spark):
    rows = case()
    docs = table(spark, rows)
    told = {r["doc_id"]: r["taken"] for r in M.taken(docs.where("doc_id is not null and doc_id <= 5000")).collect()}
    mixed = M.mix(docs.where("doc_id is not null and doc_id <= 5000"))
    assert mixed.columns == docs.columns
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(M.WORD))).alias("n")).collect()}
    assert words == {d: n for d, n in told.items() if n}


def test_draws_are_even(spark):
    sizes = M.sized(spark.range(4000).selectExpr("id as doc_id", "'a b' as text", "'s' as source"))
    one = sizes.select(*(F.avg((M._draw(F.lit(k)) < float(1 << M.DRAW_BITS) * 0.3).cast("int")).alias(f"d{k}") for k in range(M.DRAWS))).first()
    assert all(abs(x - 0.3) < 0.03 for x in one)


def test_sources_that_are_shuffled_mix_alike(spark, monkeypatch):
    want = sorted(map(str, M.taken(table(spark, case())).collect()))
    monkeypatch.setattr(M, "SMALL_BYTES", 0)
    assert sorted(map(str, M.taken(table(spark, case())).collect())) == want


def test_nothing_to_mix(spark):
    assert M.taken(table(spark, [])).count() == 0 and M.mix(table(spark, [])).count() == 0
    silent = M.taken(table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in silent} == {(0, 0.0, 0)}


def test_very_long_text(spark):
    long = "wörd\t" * 400_000
    got = M.taken(table(spark, [(1, long, "a"), (2, "x y", "b")])).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {1: 400_000, 2: 2}
