import random
import re

from lexmill.llm import decontaminate as D
from tests.llm.helpers import ODD, table, texts


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())


def plain(doc, item, least=12):
    """The best overlap over all diagonals that a seed hits."""
    a, b = words(doc), words(item)
    best = 0
    masks = D.MASKS if len(b) >= 8 else ("1" * len(b),)
    for diagonal in range(-len(b) + 1, len(a)):
        pairs = [(a[diagonal + j] == b[j]) for j in range(len(b)) if 0 <= diagonal + j < len(a)]
        if not pairs:
            continue
        if not any(all(pairs[i + p] for p, c in enumerate(m) if c == "1") for m in masks for i in range(len(pairs) - len(m) + 1)):
            continue
        score = top = start = 0
        match = 0
        for i, same in enumerate(pairs):
            score = score + 1 if same else score - D.PENALTY
            match = match + same
            if score <= 0:
                score = match = 0
            if score > top:
                top, m = score, match
        best = max(best, m if top else 0)
    return best if b and best >= min(least, len(b)) else 0


def cases():
    rng = random.Random(8)
    items = texts(12, 21, 50, 900) + ["short three words", "", None, "one", "ÉCOLE Über " * 9]
    docs = []
    for t in texts(50, 22, 60, 900):
        w = t.split()
        item = (rng.choice(items) or "x").split()
        item = [x if rng.random() > 0.12 else "swapped" for x in item]
        if rng.random() < 0.3:
            item = item[: len(item) // 2]
        at = rng.randrange(len(w) + 1)
        docs.append(" ".join(w[:at] + [x.upper() + "," for x in item] + w[at:]))
    docs += ODD + ["école ÜBER école über école über école über école über", docs[0]]
    return list(enumerate(docs)), [(100 + i, t) for i, t in enumerate(items)]


def test_matches_brute_force(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i, m) for d, t in docs for i, x in items if (m := plain(t, x))}
    rows = []
    docs += [docs[2]] * 2
    for block in (8 << 20, 600):
        found = D.overlaps(table(spark, docs).repartition(3), bench, block_bytes=block, salts=3).collect()
        rows.append(sorted(map(tuple, found)))
        got = {(r["doc_id"], r["item_id"], r["n_match"]) for r in found}
        assert got <= want and sum(r["n_items"] for r in found) == len(want) + 2 * sum(d == docs[2][0] for d, _, _ in want)
        assert {(d, m) for d, _, m in got} == {(d, m) for d, _, m in want}
    assert len(want) > 20 and rows[0] == rows[1]
    left = {r["doc_id"] for r in D.decontaminate(table(spark, docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in want}


def test_a_shorter_run_of_more_gain_hides_no_overlap(spark):
    item = [f"w{i}" for i in range(50)]
    swap = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(item[:29]))
    docs = [(1, swap(11, 12, 13, 14, 21)), (2, swap(11, 12, 13, 14, 20, 24)), (3, swap(*range(11, 15), *range(18, 29)))]
    found = D.overlaps(table(spark, docs), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_match"], r["n_overlap"], r["item_token"]) for r in found) == [(1, 13, 14, 15), (2, 12, 14, 15)]


def test_items_with_a_common_preamble_make_one_row_a_document(spark):
    preamble = "read the question below with care and then choose the one best answer of all"
    items = [(i, preamble + " " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(300)]
    docs = [(d, f"text {d} says {preamble} and more") for d in range(100)] + [(200, "before " + items[57][1]), (None, items[3][1]), (200, "clean text of the same id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 8000):
        found = D.overlaps(table(spark, docs), bench, block_bytes=block, salts=2).collect()
        assert sum(r["n_items"] for r in found) == 102 * 300
        assert {(r["doc_id"], r["n_items"]) for r in found if r["item_id"] == 57} == {(200, 1)}
        assert max(r["n_match"] for r in found if r["doc_id"] == 200) == 35
        assert len(found) == 100 + 2 + 2
    left = D.decontaminate(table(spark, docs), bench).collect()
    assert [(r["doc_id"], r["text"]) for r in left] == [(200, "clean text of the same id")]


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.overlaps(table(spark, docs), none).count() == 0
    assert D.overlaps(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert D.decontaminate(table(spark, docs), none).count() == len(docs)
