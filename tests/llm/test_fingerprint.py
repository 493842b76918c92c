import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from lexmill.llm import fingerprint as P
from lexmill.llm.common import utf8_view
from tests.llm.helpers import ODD, table, texts


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain(docs):
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, signed_hash(r[1] or "")))
    out = []
    for i, (d, t) in enumerate(order):
        t, f = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + f[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, f))
    return out


def multiset(text):
    keys, _ = P.paragraphs(*utf8_view(pa.array([text])))
    return Counter(keys.tolist())


def jaccard(a, b):
    a, b = multiset(a), multiset(b)
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def test_matches_brute_force(spark):
    rng = random.Random(9)
    rows = texts(80, 31, 200) + ODD + ["line\n" * 30, "line\n" * 31, "é\n\U0001f600 ü " * 40]
    rows += [rows[3]]
    docs = list(zip(rng.sample(range(-500, 500), len(rows)), rows)) + [(None, "no id here " * 9)]
    docs += [docs[4], (docs[5][0], docs[6][1]), (None, "another without id"), (None, None)]
    for size in (500, 2000, 1 << 22):
        got = [tuple(r) for r in P.compare_versions(table(spark, docs).repartition(3), size, with_digests=True).collect()]
        want = plain(docs)
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        assert [g[:3] for g in sorted(got, key=key)] == [w[:3] for w in sorted(want, key=key)]
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert abs(g[5] - jaccard(w[3], w[4])) < 1e-12 and abs(g[6] - jaccard(w[3], w[5])) < 1e-12
            x, y = (sorted(multiset(w[i]).keys()) for i in (3, 4))
            assert (g[7], g[8]) == (len(g[9]), len(g[10])) and [v % 2**64 for v in g[9]] == sorted((v for v in set(x) - set(y)), key=lambda v: v - (v >> 63 << 64)) and len(g[10]) == len(set(y) - set(x))
            if (said := P.differing(g[3], g[4])) is not None:
                assert said == ({v % 2**64 for v in g[9]}, {v % 2**64 for v in g[10]})
        prints = {}
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            for text, made in ((w[3], g[3]), (w[4], g[4])):
                assert prints.setdefault(text, made) == made
        assert len(set(prints.values())) > 150


def test_a_stuck_sketch_is_tried_larger():
    a, b = (" ".join(t) for t in np.array(texts(2, 33, 3000, 5000)).reshape(2, 1).tolist())
    keys, first = P.paragraphs(*utf8_view(pa.array([a, b])))
    cells, zero, one = P.sketches(keys, first), np.array([0]), np.array([1])
    assert P.differing(*P.encoded(np.diff(first), cells)) is None
    pair, key, sign = P.differences(keys, first, cells, zero, one)
    assert set(key[sign > 0].tolist()) == set(multiset(a)) - set(multiset(b)) and set(key[sign < 0].tolist()) == set(multiset(b)) - set(multiset(a))
    assert abs(P.likeness(np.diff(first), zero, one, pair, sign)[0] - jaccard(a, b)) < 1e-12


def test_fingerprints_alone_tell_a_small_change():
    a = "\n".join(texts(30, 34, 5))
    keys, first = P.paragraphs(*utf8_view(pa.array([a, a + "\none line more"])))
    one, other = P.encoded(np.diff(first), P.sketches(keys, first))
    gone, come = P.differing(one, other)
    assert not gone and come == set(multiset(a + "\none line more")) - set(multiset(a)) and P.decoded(other)[0] == np.diff(first)[1]


def test_one_document_and_none(spark):
    (r,) = P.compare_versions(table(spark, [(1, "abcdefgh")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0
    assert P.compare_versions(table(spark, [])).count() == 0
