import hashlib
import os
import random

import numpy as np
import pytest

from lexmill.llm import suffix_dedup
from lexmill.storage import checkpoint_dir
from tests.llm.helpers import ODD, table, texts


def plain(docs, width=50):
    earlier, out = {}, {}
    for d, t in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            earlier[s] = min(earlier.get(s, d), d)
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            if earlier[raw[i : i + width]] < d:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.setdefault(d, []).append((len(raw), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return {d: sorted(x) for d, x in out.items()}


def corpus():
    rng = random.Random(4)
    base = texts(60, 3, 80, 500)
    passages = [" ".join(t.split()[:30]) for t in texts(6, 8, 400)] + ["Ünïcode é passage " * 6]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(passages))
        rows.append(" ".join(w))
    rows += rows[:8] + ["ab" * 300, "ab" * 200, "x" * 49, "x" * 50, "x" * 120, "y" + "x" * 60] + ODD + [rows[3] + " tail", "head " + rows[4]]
    ids = list(range(0, 3 * len(rows), 3))
    rng.shuffle(ids)
    docs = list(zip(ids, rows))
    docs += [docs[5], (docs[7][0], docs[8][1])]  # a repeated row, and an id with another text
    return docs


@pytest.mark.parametrize("hot, chunk_bytes", [(1000, 4000), (2, 3000), (1000, 1 << 20)])
def test_matches_brute_force(spark, monkeypatch, hot, chunk_bytes):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", 300)
    docs = corpus()
    got = {}
    for r in suffix_dedup.remove_repeats(table(spark, docs).repartition(3), hot_chunks=hot, chunk_bytes=chunk_bytes).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {d: sorted(x) for d, x in got.items()} == plain(docs)


def test_a_document_is_its_id_and_its_text(spark):
    """Neither another text of a copy's id nor another text without an id goes with the copy."""
    a, u, v = texts(3, 11, 90, 900)
    docs = [(1, a), (None, a), (None, u), (5, a), (5, v), (None, None), (5, v)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(table(spark, docs)).collect())
    n = {t: len(t) for t in (a, u, v)}
    assert min(n.values()) >= 50
    assert got == sorted([(1, n[a], 0), (0, n[a], n[a]), (0, n[u], 0), (5, n[a], n[a]), (5, n[v], 0), (0, 0, 0), (5, n[v], 0)])


def test_blocks_find_the_windows_of_one_buffer(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 3000, dtype=np.uint8)
    offsets = np.array([0, 10, 10, 700, 1500, 1560, 3000])

    def windows(runs):
        row, start, many, h = runs
        return [(r, s + i, x) for r, s, m, x in zip(row.tolist(), start.tolist(), many.tolist(), h.tolist()) for i in range(m)]

    whole = object.__new__(suffix_dedup._Chunk)
    whole.data, whole.offsets = data, offsets
    every = windows(whole.runs(50))
    assert [(r, s) for r, s, _ in every] == [(r, s) for r in range(6) for s in range(offsets[r], offsets[r + 1] - 49)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    assert windows(whole.runs(50)) == every


def test_levels_stay_geometric_and_find_earlier_documents():
    rng = np.random.default_rng(1)
    family, first = suffix_dedup.SuffixLevels(4), {}
    for batch in range(40):
        s = rng.integers(97, 100, (50, 4), dtype=np.uint8).view("S4").ravel()
        d = np.sort(rng.integers(batch * 2, batch * 2 + 3, 50))
        want = []
        for x, y in zip(s.tolist(), d.tolist()):
            first[x] = min(first.get(x, y), y)
        want = [first[x] < y for x, y in zip(s.tolist(), d.tolist())]
        assert family.add(s, d).tolist() == want
        sizes = [len(x).bit_length() for x, _ in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)


def test_batches_are_scanned_against_stored_levels(spark, tmp_path):
    docs = corpus()
    rng = random.Random(5)
    rng.shuffle(docs)
    family = suffix_dedup.Levels(spark, str(tmp_path / "levels"))
    sizes, begin = [], 0
    for many in (20, 5, 30, 3, 0, len(docs)):
        batch = docs[begin : begin + many]
        got = {}
        for r in family.add(table(spark, batch), chunk_bytes=3000, hot_chunks=4).collect():
            got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
        held = docs[: begin + many]
        everything = plain([(d, t) for d, t in held])
        for d in {d for d, _ in batch}:
            assert set(got[d]) <= set(everything[d])
        assert sum(map(len, got.values())) == len(batch)
        begin += many
        sizes.append([b.bit_length() for _, b, _ in family.held()])
        assert all(x > y for x, y in zip(sizes[-1], sizes[-1][1:]))
    assert max(map(len, sizes)) > 1
    again = suffix_dedup.Levels(spark, str(tmp_path / "levels")).add(table(spark, [(10**6, docs[0][1]), (10**6 + 1, "new " + docs[1][1])])).collect()
    assert [r["n_removed"] for r in sorted(again)] == [len((docs[0][1] or "").encode()) if len((docs[0][1] or "").encode()) >= 50 else 0, len((docs[1][1] or "").encode()) if len((docs[1][1] or "").encode()) >= 50 else 0]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_windows_are_not_written_before_they_are_dealt(spark):
    """However many chunks share an anchor, nothing but the exchanges takes disk."""
    files = lambda: sum(len(f) for _, _, f in os.walk(checkpoint_dir(spark).removeprefix("file:")))
    before = files()
    assert suffix_dedup.remove_repeats(table(spark, corpus()), hot_chunks=3, chunk_bytes=3000).where("n_removed > 0").count() > 8
    assert files() == before


def test_an_anchor_counts_once_more_for_every_few_runs():
    h = np.array([7] * 9 + [2**63 + 5] + [3] * 4, np.uint64)
    assert suffix_dedup.counted_anchors(h).view(np.uint64).tolist() == [2**63 + 5, 3, 3, 7, 7, 7]
