import hashlib
import random

import numpy as np

from lexmill.llm import chunk_dedup
from lexmill.llm.common import utf8_view
from lexmill.llm.queries import QUERIES
from tests.llm.helpers import ODD, table, texts


def plain_cuts(raw, least, most):
    out, at, h = [], 0, 0
    for i, b in enumerate(raw):
        h = (2 * h + int(chunk_dedup.GEAR[b])) & 0xFFFF
        if i + 1 - at == most or (i + 1 - at >= least and h & 0xF800 == 0):
            out.append((at, i + 1))
            at = i + 1
    return out + ([(at, len(raw))] if at < len(raw) else [])


def rows():
    rng = random.Random(6)
    passages = texts(5, 11, 90)
    out = []
    for t in texts(50, 7, 60, 800):
        w = t.split()
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(passages))
        out.append(" ".join(w))
    out += out[:5] + ODD + ["é" * 700, "é" * 700 + "x", "a\0b" * 90, "a\0b" * 95]
    docs = list(zip(rng.sample(range(1000), len(out)), out))
    return docs + [docs[3], (None, docs[4][1])]


def test_matches_brute_force(spark):
    docs = rows()
    first = {}
    for d, t in docs:
        raw = (t or "").encode()
        for a, b in plain_cuts(raw, 16, 128):
            if d is not None:
                first[raw[a:b]] = min(first.get(raw[a:b], d), d)
    want = []
    for d, t in docs:
        raw = (t or "").encode()
        spans = [(a, b - a) for a, b in plain_cuts(raw, 16, 128) if d is not None and first[raw[a:b]] < d]
        runs = chunk_dedup._runs(raw, spans, 96)
        kept = b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)]))
        want.append((d, len(raw), len(raw) - len(kept), hashlib.sha256(kept).hexdigest(), kept.decode()))
    found = chunk_dedup.remove_repeats(table(spark, docs).repartition(3)).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in found]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 1000


def plain_reach(docs, reach):
    """Runs extended along the earliest holder of their outer chunks; one text an id."""
    cuts = {d: plain_cuts(t.encode(), 16, 128) for d, t in docs}
    raw = {d: t.encode() for d, t in docs}
    first = {}
    for d in sorted(cuts):
        for a, b in cuts[d]:
            first.setdefault(raw[d][a:b], (d, a, b))
    out = {}
    for d, cut in cuts.items():
        runs = []
        for a, b in cut:
            if first[raw[d][a:b]][0] < d:
                if runs and runs[-1][1] == a:
                    runs[-1][1:] = [b, first[raw[d][a:b]]]
                else:
                    runs.append([a, b, first[raw[d][a:b]]])
        spans = []
        for a, b, (e, _, y) in runs:
            k, x, _ = first[raw[d][a : next(j for i, j in cut if i == a)]]
            n = m = 0
            while n < min(a, x, reach) and raw[d][a - n - 1] == raw[k][x - n - 1]:
                n += 1
            while m < min(len(raw[d]) - b, len(raw[e]) - y, reach) and raw[d][b + m] == raw[e][y + m]:
                m += 1
            spans.append((a - n, b - a + n + m))
        out[d] = sum(e - s for s, e in chunk_dedup._runs(raw[d], sorted(spans), 96))
    return out


def test_reach_matches_brute_force(spark):
    rng = random.Random(16)
    passages = texts(8, 17, 90)
    docs = []
    for d, t in zip(rng.sample(range(1000), 60), texts(60, 18, 60, 800)):
        w = t.split()
        for _ in range(rng.randrange(3)):
            w[(at := rng.randrange(len(w))) : at] = rng.choice(passages).split()[rng.randrange(5) :]
        docs.append((d, " ".join(w)))
    for more in ({}, {"chunk_bytes": 2000, "reach": 20}):
        found = chunk_dedup.remove_repeats(table(spark, docs).repartition(3), **{"reach": 512} | more).collect()
        assert {r["doc_id"]: r["n_removed"] for r in found} == plain_reach(docs, more.get("reach", 512))


def test_groups_of_parts_lose_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(chunk_dedup, "BUCKET_BYTES", 2000)
    rng = random.Random(23)
    passages = texts(8, 24, 90)
    docs = [(d, " ".join(w[:9] + rng.choice(passages).split()[rng.randrange(6) :] + w[9:])) for d, w in enumerate(t.split() for t in texts(120, 25, 60, 800))] + rows()[:300]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    for reach in (0, chunk_dedup.REACH):
        kept = [{(r["doc_id"], r["kept_text"], r["n_chunks"]) for r in chunk_dedup.remove_repeats(table(spark, docs), reach=reach, **more).collect()} for more in ({}, {"chunk_bytes": 3000, "fan": 3}, {"chunk_bytes": 3000, "fan": 1000}, {"chunk_bytes": 7000, "fan": 2})]
        assert all(k == kept[0] for k in kept)


def test_a_document_is_its_id_and_its_text(spark):
    """What a copy loses, no other text of its id loses."""
    a, v, w = texts(3, 11, 90, 900)
    docs = [(1, a), (5, a), (5, v), (None, a), (None, w), (5, a), (6, v)]
    for reach in (0, 512):
        got = sorted((r["doc_id"] or 0, r["kept_text"]) for r in chunk_dedup.remove_repeats(table(spark, docs), reach=reach).collect())
        assert got == sorted([(1, a), (5, ""), (5, v), (0, a), (0, w), (5, ""), (6, "")])


def test_blocks_cut_alike(monkeypatch):
    data, offsets = utf8_view(__import__("pyarrow").array(texts(40, 19, 90)))
    s, e = chunk_dedup.chunk_ends(data, offsets, 16, 128)
    d = chunk_dedup.digests(data, s, e)
    monkeypatch.setattr(chunk_dedup, "BLOCK", 50)
    again = chunk_dedup.chunk_ends(data, offsets, 16, 128)
    assert np.array_equal(s, again[0]) and np.array_equal(e, again[1]) and np.array_equal(d, chunk_dedup.digests(data, s, e))


def test_chunks_fall_in_step_after_an_insertion():
    text = " ".join(texts(40, 12, 60))
    cut = {}
    for name, t in (("a", text), ("b", text[:500] + "inserted " + text[500:])):
        data, offsets = utf8_view(__import__("pyarrow").array([t]))
        s, e = chunk_dedup.chunk_ends(data, offsets, 16, 128)
        assert np.array_equal(s[1:], e[:-1]) and e[-1] == len(data) and (e - s).max() <= 128
        cut[name] = {t[x:y] for x, y in zip(s, e)}
    assert len(cut["a"] - cut["b"]) <= 4


def test_long_passages_go_and_short_lines_stay(spark):
    passage = " ".join((texts(3, 13, 200)[0].split() * 9)[:55])
    docs = [(i, t + " " + passage + " " + t[::-1]) for i, t in enumerate(texts(20, 14, 60))] + [(90, "one shared line"), (91, "one shared line")]
    found = {r["doc_id"]: r for r in chunk_dedup.remove_repeats(table(spark, docs)).collect()}
    assert found[0]["n_removed"] == 0 and found[91]["n_removed"] == 0
    assert all(len(passage) * 0.6 < found[i]["n_removed"] <= len(passage) + 2 for i in range(1, 20))


def planted(n):
    """Two documents each for n passages of 51 words, which nothing else shares."""
    rng, out = random.Random(91), []
    say = lambda k: " ".join("".join(rng.choice("aeioubcdnrst") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    for i in range(n):
        passage = say(51)
        out += [(d, say(rng.randrange(5, 60)), passage, say(rng.randrange(5, 60))) for d in (2 * i, 2 * i + 1)]
    return out


def test_shared_passages_go_as_a_whole(spark, tmp_path):
    docs = planted(300)
    rows = [(d, f"{a} {p} {b}") for d, a, p, b in docs] + [(5000, "é" * 60 + "shared by two, é"), (5001, "ü" * 60 + "shared by two, é")]
    table(spark, rows + rows[:2]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["op10_substring_dedup"](spark, str(tmp_path)).collect()}
    text = {r["doc_id"]: r["kept_text"] for r in chunk_dedup.remove_repeats(table(spark, rows), reach=chunk_dedup.REACH).collect()}
    whole = left = 0
    for d, a, p, b in docs:
        assert hashlib.sha256(text[d].encode()).hexdigest() == found[d]["kept_sha256"]
        if d % 2 == 0:
            assert found[d]["n_removed"] == 0
            continue
        assert found[d]["n_removed"] <= len(p) + 12
        left += len(p) - min(found[d]["n_removed"], len(p))
        whole += found[d]["n_removed"] >= len(p)
    assert whole >= 0.97 * 300 and left < 0.03 * sum(len(p) for _, _, p, _ in docs) / 2
    assert found[5001]["n_removed"] == 0


def test_empty_table(spark):
    assert chunk_dedup.remove_repeats(table(spark, []), reach=chunk_dedup.REACH).count() == 0
    assert chunk_dedup.remove_repeats(table(spark, [])).count() == 0
