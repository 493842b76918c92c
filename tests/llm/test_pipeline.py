import random
from collections import Counter

import corpus_pipeline
from tests.llm.helpers import texts
from tests.llm.test_learned import junk
from tests.llm.test_simhash import shingles


def corpus():
    rng = random.Random(71)
    good = [" ".join(f"{w}{rng.randrange(99)}" if rng.random() < 0.3 else w for w in (t.split() * 9)[:120]) + "." for t in texts(260, 72, 60, 3000) if len(t.split()) > 20]
    rows = [(10 * i, t, 1) for i, t in enumerate(good)]
    rows += [(10 * i + 1, junk(t, i), 0) for i, t in enumerate(good[:60])]
    copies = {10 * i + 2: 10 * i for i in range(100, 110)}
    rows += [(d, good[o // 10], 1) for d, o in copies.items()]
    near = {10 * i + 3: 10 * i for i in range(120, 130)}
    rows += [(d, good[o // 10].replace(good[o // 10].split()[50], "changed", 1), 1) for d, o in near.items()]
    items = texts(4, 73, 60, 800)
    items = [(i, (t + " ") * (1 + 30 // len(t.split()))) for i, t in enumerate(items)]
    leaks = [10 * i + 4 for i in range(8)]
    rows += [(d, " ".join(texts(1, 80 + d, 99, 5000)) + " " + items[d % 4][1] + " end of it.", 1) for d in leaks]
    passage = " ".join((texts(1, 74, 90, 5000)[0].split() * 60)[:60])
    shared = [10 * i + 5 for i in range(6)]
    rows += [(d, " ".join((texts(1, 200 + d, 99, 5000)[0].split() * 40)[:90]) + " " + passage + " finally.", 1) for d in shared]
    rng.shuffle(rows)
    return rows, items, copies | near, leaks, shared, passage


def test_stages_take_effect(spark, tmp_path):
    rows, items, duplicates, leaks, shared, passage = corpus()
    rows = [*rows, (None, "A text of no known document, but a text.", 1), (99_999, None, 1), rows[0]]
    clashing = "score string, row string, `a``b.c d` string, rank string, spans string, size int, kept_text string, f0 long, component_id string, d1 string, item_id long, start string"
    extra = ("a", "r", "q", "k", "b", 3, "c", 4, "d", "e", 5, "f")
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t or ""), *extra) for d, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, " + clashing)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, y, 0) for d, _, y in rows if d is not None], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"]: r for r in now.collect()})
        if name != "best-fit packing":
            assert now.columns == docs.columns and all(tuple(r)[5:] == extra for r in ids[-1].values())
    good = {d for d, _, y in rows if y and d is not None}
    after_quality = {d for d in ids[0] if d is not None}
    assert len(good - after_quality) <= 3 and len(after_quality - good) <= 12
    assert set(duplicates) & set(ids[1]) == set() and None in ids[1]
    assert after_quality - set(ids[1]) <= set(duplicates) | {d for d, _, y in rows if not y}
    assert set(ids[2]) == set(ids[1])
    texts_ = [ids[2][d]["text"] for d in shared if d in ids[2]]
    assert sum(passage in t for t in texts_) == 1 and all(len(t) > 100 for t in texts_)
    assert all(r["n_chars"] == len(r["text"]) for r in ids[2].values())
    # A leak that stands in several documents is a repeat as well: it may be gone from all but the first of them.
    gone = set(ids[2]) - set(ids[3])
    assert min(leaks) in gone and gone <= set(leaks)
    assert not any(t.strip()[:200] in (r["text"] or "") for r in ids[3].values() for _, t in items)
    assert set(ids[4]) == set(ids[3])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in now.collect()}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_texts_and_lose_no_pair(spark, tmp_path):
    """On the given documents: one of each pair of 0.8 or more goes, and whatever goes has such a partner."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    sets = {r["doc_id"]: shingles("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in docs.collect()}
    owners = {}
    for d, own in sets.items():
        for x in own or {()}:
            owners.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    partners = {}
    for d, own in sets.items():
        shared = Counter(e for x in own or {()} for e in owners[x] if e < d)
        for e, n in shared.items():
            if not own or 5 * n >= 4 * (len(own) + len(sets[e]) - n):
                partners.setdefault(d, set()).add(e)
                partners.setdefault(e, set()).add(d)
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    firsts = {find(d) for d in sets}
    assert all(d in partners for d in set(sets) - kept)
    assert len(kept & firsts) == len(firsts) and len(kept - firsts) <= 0.02 * (len(sets) - len(firsts))
    assert len(sets) - len(kept) > 30


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join((t.split() * 20)[:60]) for t in texts(3, 79, 90, 4000))
    rows = [(1, a), (1, b), (1, a), (2, a), (None, b), (None, c), (3, None), (4, "")]
    docs = spark.createDataFrame([(d, t, {"k": d}) for d, t in rows], "doc_id long, text string, extra map<string, long>")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, a), (1, b), (None, c), (3, None)], key=repr)


def test_maps_within_columns_of_near_duplicates(spark, tmp_path):
    text = " ".join(texts(1, 5, 60, 900)) * 9
    schema = "doc_id long, text string, note struct<m:map<string,int>, n:int>, notes array<struct<m:map<string,int>>>, flat map<string,string>"
    rows = [(1, text, ({"a": 1}, 2), [({"b": 3},)], {"c": "d"}), (2, text, (None, None), [], None), (3, "another text", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.schema == docs.schema and {r["doc_id"] for r in got.collect()} == {1, 3}
