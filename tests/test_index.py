"""The stored index against the texts themselves, as it grows, merges and loses rows, and what a search of it reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import index as I
from lexmill.operators import search
from lexmill.plans import ftsquery as Q
from lexmill.schema import versions

ROWS = "id long, content string, title string, extra string"
QUERIES = ["aa", "aa AND bb", "cc AND dd", "aa OR bb OR zz", '"aa bb"', '"aa aa"', "b*", '"aa b"*', '(aa OR cc) NOT "bb cc"', '"aa bb aa"', "nothing", '"aa bb cc dd" OR ee']


def texts(seed, n, words=30):
    rng = random.Random(seed)
    vocabulary = ["aa", "bb", "cc", "dd", "ee", "ba", "bab", "é", "Ő"] + [f"w{i}" for i in range(60)]
    weights = [30, 20, 10, 5, 3, 4, 2, 2, 1] + [1] * 60
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(words))) for _ in range(n)]


def made(spark, rows):
    return spark.createDataFrame([(i, c, t, "x") for i, c, t in rows], ROWS)


def case(n, seed=1, base=0):
    both = texts(seed, n), texts(seed + 1, n, 4)
    odd = [(None, None), ("", ""), ("...", None), (None, "aa"), ("aa " * 2000, "bb")]
    return [(base + 37 * i % (n * 5), c, t) for i, (c, t) in enumerate(zip(*both))] + [(base + n * 5 + i, c, t) for i, (c, t) in enumerate(odd)]


def scored(counts, columns, stats, tree):
    return {r["id"]: r["r"] for r in counts.where(search.matches(tree, columns)).select("id", F.round(search.bm25(stats, columns, Q.phrases(tree)), 6).alias("r")).collect()}


def same(spark, index, rows):
    """Scores and statistics of the index are those of a scan over what the rows are."""
    whole = made(spark, rows)
    trees = [Q.parse(q) for q in QUERIES]
    phrases = list(dict.fromkeys(p for t in trees for p in Q.phrases(t)))
    plain, columns = search.counted(whole, phrases)
    plain = plain.checkpoint()
    stats = search.statistics(plain, columns)
    told, own = index.counted(phrases)
    told = told.checkpoint()
    mine = search.statistics(told, own).asDict() | {"n": index.rows, "mean": index.mean}
    assert index.rows == len(rows) and abs(index.mean - (stats["mean"] or 0)) < 1e-9
    for i, tree in enumerate(trees):
        assert scored(told, own, mine, tree) == scored(plain, columns, stats, tree), QUERIES[i]
    for words, every in ((["aa"], False), (["aa", "bb", "zz"], False), (["cc", "dd"], True), (["nothing"], False)):
        tree = Q.parse((" AND " if every else " OR ").join(words))
        want = sorted((s, i) for i, s in scored(plain, columns, stats, tree).items())
        assert sorted((r["relevance"], r["id"]) for r in index.ranked(words, every).collect()) == want
        for k in (1, 7):
            assert sorted((r["relevance"], r["id"]) for r in index.top(words, k, every)[0].collect()) == want[:k]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(I, "BLOCK_IDS", 16)
    monkeypatch.setattr(I, "LEAST_PART_BYTES", 500)
    monkeypatch.setattr(I, "GATHERED", 50)


def test_index_equals_a_scan(spark, tmp_path):
    rows = case(160)
    same(spark, I.Index.build(made(spark, rows).repartition(3), f"{tmp_path}/i"), rows)


def test_no_rows_and_rows_without_tokens(spark, tmp_path):
    empty = I.Index.open(spark, f"{tmp_path}/none")
    assert empty.rows == 0 and empty.ranked(["aa"]).count() == 0 and empty.top(["aa"], 3)[0].count() == 0 and empty.dictionary().count() == 0
    assert I.Index.build(made(spark, []), f"{tmp_path}/a").segments == []
    bare = I.Index.build(made(spark, [(1, None, None), (2, "?", "")]), f"{tmp_path}/b")
    assert bare.rows == 2 and bare.mean == 0 and bare.ranked(["aa"]).count() == 0


def test_batches_merge_and_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "FAN", 3)
    rng, held, index = random.Random(4), {}, I.Index(spark, f"{tmp_path}/i")
    most = 0
    for k in range(10):
        batch = [(rng.randrange(200), c, t) for c, t in zip(texts(10 + k, 25), texts(40 + k, 25, 3))]
        batch = list({i: (i, c, t) for i, c, t in batch}.values())
        gone = [i for i in rng.sample(sorted(held), min(len(held), 6)) if i not in {b[0] for b in batch}] + [9999]
        index = index.add(made(spark, batch), spark.createDataFrame([(i,) for i in gone], "id long"), batch=k)
        held = {i: v for i, v in held.items() if i not in gone} | {b[0]: b for b in batch}
        most = max(most, len(index.segments))
        assert index.rows == len(held) and vars(index.add(made(spark, batch), batch=k)) == vars(index)
    assert most <= 2 * 3 and max(s.level for s in index.segments) >= 1 and any(s.dead for s in index.segments)
    assert vars(I.Index.open(spark, f"{tmp_path}/i")) == vars(index)
    same(spark, index, list(held.values()))
    assert {(r["token"], r["rows"], r["hits"]) for r in index.dictionary().collect()} == {(r["token"], r["rows"], r["hits"]) for r in I.Index.build(made(spark, list(held.values())), f"{tmp_path}/again").dictionary().collect()}
    kept = set(I.children_of(spark, f"{tmp_path}/i/segments"))
    assert {s.name for s in index.segments} <= kept and len(kept) <= len(index.segments) + 4 and len(versions(spark, f"{tmp_path}/i/state")) == 2


def test_a_batch_that_breaks_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    rows = case(40)
    index = I.Index.build(made(spark, rows), f"{tmp_path}/i")
    monkeypatch.setattr(I, "complete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.add(made(spark, [(rows[0][0], "aa", "zz"), (9999, "bb", "")]), batch=5)
    monkeypatch.undo()
    again = I.Index.open(spark, f"{tmp_path}/i")
    assert vars(again) == vars(index)
    same(spark, again, rows)
    again = again.add(made(spark, [(rows[0][0], "aa", "zz"), (9999, "bb", "")]), batch=5)
    same(spark, again, [(rows[0][0], "aa", "zz"), (9999, "bb", ""), *rows[1:]])


def test_a_search_reads_its_tokens_alone(spark, tmp_path):
    rows = [(i, f"common t{i % 50:02d} u{i % 50:02d}", "") for i in range(600)]
    index = I.Index.build(made(spark, rows), f"{tmp_path}/i")
    (segment,) = index.segments
    assert segment.parts >= 3 and len(index._files(segment, {"t07"}, set())) < len(index._files(segment, {"common"}, {"u"}))
    plan = index.matching({"t07"})._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*(EqualTo|In)\(token", plan)
    assert index.matching({"t07"}).count() == 12 and index.matching(set(), {"t0"}).count() == 120
    assert len(set(index.matching({"common"}).select(F.input_file_name()).distinct().collect())) > 1  # a frequent token lies in several


def test_top_stops_early_and_agrees(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(["aa"] * (40 if i in (100, 101, 700) else i % 3 == 0) + ["x"] * rng.randrange(30, 60)), "") for i in range(16 * 300)]
    index = I.Index.build(made(spark, rows), f"{tmp_path}/i")
    want = sorted((r["relevance"], r["id"]) for r in index.ranked(["aa"]).collect())
    found, read = index.top(["aa"], 3)
    assert [(r["relevance"], r["id"]) for r in found.orderBy("relevance", "id").collect()] == want[:3] and read == I.FIRST_BLOCKS < 300
    found, read = index.top(["aa"], 700)
    assert sorted((r["relevance"], r["id"]) for r in found.collect()) == want[:700] and read > I.FIRST_BLOCKS
    among = spark.range(4000, 4800).select("id")
    found, read = index.top(["aa"], 5, among=among)
    assert sorted((r["relevance"], r["id"]) for r in found.collect()) == [x for x in want if x[1] >= 4000][:5]


def in_order(text, pattern):
    """Whether the parts between the % of a pattern without _ stand in a text one after the other."""
    low, at = "".join(x.lower() if x.isascii() else x for x in text), 0
    for part in "".join(x.lower() if x.isascii() else x for x in pattern).strip("%").split("%"):
        at = low.find(part, at) + len(part)
        if at < len(part):
            return False
    return True


def test_like_reads_blocks_that_have_its_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_IDS", 16)
    rows = case(300)
    rows += [(9001, "Zebra-CROSSING ahead", None), (9500, "a zebra", "crossing"), (9501, "zebra  crossing" + "x" * 9000, ""), (9502, "zébra crossing", None), (20_000, "crossing zebra", None)]
    frame = made(spark, rows)
    index = I.Index.build(frame.where("id < 400"), str(tmp_path / "i")).add(frame.where("id >= 400"))
    changed = [(20_001, "zebra crossing", None)]
    gone = spark.createDataFrame([(9501,)], "id long")
    index = index.add(made(spark, changed), gone)
    kept = [r for r in rows if r[0] != 9501] + changed
    alive = made(spark, kept).repartition(3).cache()
    for few, patterns in ((I.FEW_TOKENS, ("%zebra%crossing%", "%EBR%", "%a_z%", "%aa bb%", "%nothing%", "%w1%é%")), (0, ("%ra-cr%", "%aa%bb%w1%"))):
        monkeypatch.setattr(I, "FEW_TOKENS", few)
        for pattern in patterns:
            want = sorted(i for i, c, _ in kept if c is not None and in_order(c, pattern))
            got = index.like(alive, pattern, X.like_ascii(F.col("content"), pattern), 10_000)
            assert got is None if pattern == "%a_z%" else got[0] == want, pattern
            assert pattern != "%zebra%crossing%" or got[1] <= 4
    assert index.like(alive, "%aa%", X.like_ascii(F.col("content"), "%aa%"), 3)[1] == I.FIRST_BLOCKS
    among = spark.createDataFrame([(20_001,), (1,)], "id long")
    assert index.like(alive, "%zebra%", X.like_ascii(F.col("content"), "%zebra%"), 5, among)[0] == [20_001]
    assert I.Index.open(spark, str(tmp_path / "none")).like(alive, "%zebra%", F.lit(True), 5) == ([], 0)
