import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from lexmill.llm import simhash
from lexmill.llm.components import Forest, components
from tests.llm.helpers import ODD, table, texts


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most=2):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(3)
    rows = texts(120, 1, 90)
    rows += [rows[5], rows[6], rows[5]] + ODD
    for t in rows[:30]:
        w = t.split()
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows.append(" ".join(texts(1, 9, 2000)) * 40)
    docs = [(i * 3 - 40, t) for i, t in enumerate(rows)]
    rng.shuffle(docs)
    got = {r["doc_id"]: (r["f0"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(table(spark, docs).repartition(3)).collect()}
    prints = {d: plain_fingerprint(t) for d, t in docs}
    assert {d: f for d, (f, _) in got.items()} == prints
    assert {d: c for d, (_, c) in got.items()} == plain_components(prints)


def test_links_lose_nothing_in_small_and_large_buckets(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for f in list(prints)[:20]:
        for _ in range(4):
            g = f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            prints |= {g, g ^ (1 << rng.randrange(64))}
    low = rng.getrandbits(32)
    prints |= {low | (rng.getrandbits(9) << 40) for _ in range(150)}  # one large bucket
    prints = dict(enumerate(sorted(prints)))
    signed = {i: int(np.uint64(f).astype(np.int64)) for i, f in prints.items()}
    nodes = spark.createDataFrame([(i, f) for i, f in signed.items()], "node long, f0 long")
    for large in (simhash.LARGE_BUCKET, 100, 3):
        found = components(simhash.links(nodes, 1, simhash.exact_tables(), 2, exact=True, large=large))
        got = {i: i for i in prints} | {r["node"]: r["component"] for r in found.collect()}
        assert got == plain_components(prints)


def test_buckets_too_large_for_a_task_lose_no_link(spark):
    rng = random.Random(17)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(20, 256), n))
    base = rng.getrandbits(256)
    prints = [flip(base, rng.randrange(10, 40)) for _ in range(120)] + [base & 0xFFFFF | rng.getrandbits(236) << 20 for _ in range(60)]
    words = [[int(np.uint64(f >> 64 * i & (2**64 - 1)).astype(np.int64)) for i in range(4)] for f in prints]
    nodes = spark.createDataFrame([(i, *w) for i, w in enumerate(words)], "node long, f0 long, f1 long, f2 long, f3 long").repartition(3)
    for large in (1000, 50, 7):
        found = components(simhash.links(nodes, 4, [list(range(20))], 51, exact=False, large=large))
        got = {i: i for i in range(len(prints))} | {r["node"]: r["component"] for r in found.collect()}
        assert got == plain_components(dict(enumerate(prints)), 51)


def test_chain_filter_prunes_and_keeps():
    d = np.array([[0, 1, 1, 0], [1, 1, 0, 0], [1, 1, 1, 0], [2, 0, 0, 0], [3, 0, 0, 0], [0, 0, 0, 0]])
    assert simhash.viable(d, 2).tolist() == [True, True, False, True, False, True]


@pytest.mark.parametrize("part", [50_000, 20])
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, part):
    monkeypatch.setattr("lexmill.llm.components.PART", part)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(200, 260)}


def test_spread_tables_find_similar_texts(spark):
    base = texts(40, 2, 400, 3000)
    rows = []
    for i, t in enumerate(base):
        w = (t.split() * 40)[:300]
        rng = random.Random(i)
        w = [x + str(rng.randrange(9999)) for x in w]
        v = list(w)
        for _ in range(4):
            v[rng.randrange(len(v))] = "other"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    found = simhash.alike_documents(spark.createDataFrame([(d, d, t) for d, t in rows], "rank long, name long, text string"))
    assert {r["name"]: r["first"] for r in found.collect()} == {d: d - d % 2 for d, _ in rows}


def test_keys_grow_with_the_fingerprints():
    plans = [simhash.spread_plan(n, 0.8) for n in (0, 10, 1 << 19, 1 << 21, 1 << 30, 1 << 36)]
    assert [bits for _, bits in plans] == [20, 20, 20, 24, 32, 40]
    assert [t for t, _ in plans] == sorted(t for t, _ in plans) and 100 < plans[0][0] < 160


def test_large_buckets_of_long_fingerprints_lose_nothing():
    rng = random.Random(15)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(20, 256), n))
    base = rng.getrandbits(256)
    prints = [flip(base, rng.randrange(10, 26)) for _ in range(100)]
    prints += [flip(prints[0], 45)]  # within 51 bits of few of the others
    for _ in range(6):  # a chain that leads away
        prints.append(flip(prints[-1], 48))
    prints += [base & 0xFFFFF | rng.getrandbits(236) << 20 for _ in range(30)]
    for seed in range(5):
        random.Random(seed).shuffle(prints)
        words = np.array([[f >> 64 * i & (2**64 - 1) for i in range(4)] for f in prints], np.uint64)
        a, b = simhash._bucket_links(np.zeros(len(words), np.int64), words, 51, exact=False)
        forest = Forest()
        forest.add(a.tolist(), b.tolist())
        assert {i: forest.find(i) for i in range(len(prints))} == plain_components(dict(enumerate(prints)), 51)
        assert len(a) < len(prints)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def plain_alike(sets, least=0.8):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def revisions():
    """Texts of 200 words, copies of them with up to six words changed, and chains of copies; all are lower case."""
    rng, rows = random.Random(33), []
    for _ in range(25):
        now = [f"w{rng.randrange(9999)}" for _ in range(200)]
        for _ in range(rng.choice([1, 4, 30])):
            v = list(now)
            for _ in range(rng.randrange(7)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(v))
            now = v if rng.random() < 0.3 else now
    return rows


def test_verified_sets_are_connected_as_by_brute_force():
    sets = {i: shingles(t) for i, t in enumerate(revisions())} | {10_000: set(), 10_001: {("a",)}}
    number = {x: i for i, x in enumerate(sorted(set().union(*sets.values())))}
    begin = np.cumsum([0, *map(len, sets.values())])
    group = simhash.alike(np.array([number[x] for s in sets.values() for x in s], np.uint64), begin, 0.8)
    ids = list(sets)
    assert {d: ids[g] for d, g in zip(ids, group)} == plain_alike(sets)


def test_alike_documents_are_those_of_brute_force(spark):
    rows = revisions() + ODD + ["a b", "a b"]
    docs = [(7 * i % 1009, 3 * i + 1, t) for i, t in enumerate(rows)]
    docs += [(docs[0][0], 9000, docs[-1][2]), docs[1], ((1 << 63) - 1, 9003, docs[2][2])]
    got = sorted((r["name"], r["first"]) for r in simhash.alike_documents(spark.createDataFrame(docs, "rank long, name long, text string").repartition(3)).collect())
    want = plain_alike({i: shingles((t or "").lower()) for i, (_, _, t) in enumerate(docs)})
    least = {}
    for i, c in want.items():
        least[c] = min(least.get(c, docs[i]), docs[i], key=lambda d: d[:2])
    assert got == sorted((docs[i][1], least[c][1]) for i, c in want.items())
    assert sum(a != b for a, b in got) > 50
    again = simhash.alike_documents(spark.createDataFrame(docs, "rank long, name long, text string"), block=7)
    assert sorted((r["name"], r["first"]) for r in again.collect()) == got


def test_large_groups_are_verified_in_blocks(spark):
    """One group of candidates: a dense group, a chain of revisions, and texts of their own."""
    rng = random.Random(41)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows = [" ".join(x if rng.random() > 0.01 else f"x{rng.randrange(9999)}" for x in base) for _ in range(60)]
    now = base
    for _ in range(25):
        now = list(now)
        for _ in range(3):
            now[rng.randrange(200)] = f"y{rng.randrange(9999)}"
        rows.append(" ".join(now))
    rows += [" ".join(f"z{rng.randrange(9999)}" for _ in range(50)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "name long, text string")
    each = simhash.fingerprints(docs.withColumnRenamed("name", "doc_id"), 5, 1, "rolling", False, True).select(F.col("doc_id").alias("name"), "node")
    nodes = {r["name"]: r["node"] for r in each.collect()}
    want = plain_alike({nodes[i]: shingles(t) for i, t in enumerate(rows)})
    candidates = each.groupBy("node").agg(F.min("name").alias("name")).withColumn("component", F.lit(5).cast("long"))
    for block in (1000, 30, 6):
        got = {n: n for n in want} | {r["node"]: r["component"] for r in simhash.verified(docs, candidates, 5, "rolling", 0.8, block).collect()}
        groups = lambda g: sorted(sorted(n for n in g if g[n] == c) for c in set(g.values()))
        assert groups(got) == groups(want)


def test_empty_table_and_null_id(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.alike_documents(spark.createDataFrame([], "rank long, name long, text string")).count() == 0
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(spark, [(None, "one two"), (4, "three four five")])).collect()}
    assert got == {None: None, 4: 4}
