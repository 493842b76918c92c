import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import hard_negatives as H

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("score", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)


def brute(rows, every, least=80, positives=5, negatives=5):
    held = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i] = min(held.get(i, (1 << 60,)), (label, [math.floor(256 * x) for x in v]))
    out = []
    for a in sorted(i for i in held if i % every == 0):
        label, q = held[a]
        scored = sorted((-sum(x * y for x, y in zip(q, r)), i) for i, (_, r) in held.items() if i != a)
        for s, p in [x for x in scored if held[x[1]][0] == label][:positives]:
            fits = [x for x in scored if held[x[1]][0] != label and least * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def near(seed, n, width, spread=0.2, labels=4, scale=1.0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    return [(i, [scale * (x + rng.gauss(0, spread)) for x in rng.choice(middle)], rng.randrange(labels)) for i in range(-20, n - 20)]


@pytest.mark.parametrize("rows", [
    near(1, 400, 16), near(2, 300, 5, 2.0), near(3, 200, 8, 0.1, 2, 1000.0), near(4, 150, 4, 0.3, 3, 2000000.0 / 256),
    [(i, [0.5, -0.25, 0.0], i % 2) for i in range(120)],  # all alike: ties by id
    [(i, [0.001 * (i % 3)], i % 3) for i in range(90)],
], ids=["clusters", "one cloud", "large", "larger", "copies", "small"])
def test_equals_brute_force(spark, rows):
    for wave in (H.WAVE_ROWS, 7):
        got = H.mine(table(spark, rows).repartition(3), F.col("id") % 10 == 0, wave_rows=wave)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_odd_rows(spark):
    rows = near(5, 60, 6) + [(100, None, 1), (110, [0.1, None, 0.2], 1), (120, [math.nan] * 6, 1), (130, [math.inf] * 6, 2), (140, [0.1] * 6, None), (None, [0.1] * 6, 1), (150, [], 1), (160, [0.5], 1), (170, [0.3] * 9, 2), (180, [1e-9] * 6, 1), (190, [-0.001] * 6, 0)]
    rows += [rows[3], (rows[4][0], [9.0] * 6, rows[4][2]), (rows[4][0], [0.1] * 6, 9)]
    got = H.mine(table(spark, rows), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)
    assert H.mine(table(spark, []), F.col("id") % 10 == 0).count() == 0
    assert H.mine(table(spark, rows[:1]), F.col("id") % 10 == 0).count() == 0


def test_components_beyond_any_use_stop(spark):
    rows = [(0, [1e300, 1.0], 0), (1, [-1e300, 1.0], 0), (2, [1e300, 2.0], 1), (3, [1e300, 0.5], 0)]
    most = 1 << H.COMPONENT_BITS
    got = H.mine(table(spark, rows), F.col("id") == 0).collect()
    assert [(r["positive_id"], r["positive_score"]) for r in got] == []  # the one negative scores above the range
    got = H.first_positives(H.quantised(table(spark, rows)), np.array([0]), np.array([0]), np.array([[most, 256]]), 5).collect()
    assert {(r["positive_id"], r["score"]) for r in got} == {(3, most * most + 256 * 128), (1, -most * most + 256 * 256)}


def test_planes_drop_and_keep_what_counts():
    rng = np.random.default_rng(7)
    for bits, width, goals in ((3, 4, 1), (9, 32, 3), (20, 16, 2), (25, 8, 2)):
        a, r = (rng.integers(-(1 << bits), 1 << bits, (n, width)) for n in (9, 700))
        exact = a @ r.T
        top = np.sort(exact, axis=1)[:, ::-1]
        high = top[:, [3 * g for g in range(goals)]]
        best = H.Best(high * 8 // 10, high, 4)
        ids = rng.permutation(700).astype(np.int64)
        alive = rng.random(exact.shape) < 0.9
        H.meet(a, r, ids, alive.copy(), best)
        for i in range(9):
            for g in range(goals):
                fits = sorted((-s, n) for s, n, on in zip(exact[i].tolist(), ids.tolist(), alive[i]) if on and best.low[i, g] <= s <= best.high[i, g])[:4]
                assert [(-s, n) for s, n in zip(best.score[i, g].tolist(), best.id[i, g].tolist()) if s > H._LEAST] == fits
