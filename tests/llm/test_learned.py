"""Held-out accuracy of the learnt operators, and their edge cases."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm import language, quality
from lexmill.llm.queries import QUERIES
from tests.llm.helpers import ODD, table, texts


def junk(t, i):
    w = t.split()
    return [" | ".join(w), " ".join(x + "###" for x in w), t.upper() + "!! " * len(w), " ".join(w[:1] * 30)][i % 4]


def marked(n, seed):
    good = [t[:1].upper() + t[1:] + "." for t in texts(n, seed, 80, 900)]
    rows = [(t, 1) for t in good if len(t.split()) > 5]
    rows += [(junk(t, i), 0) for i, (t, _) in enumerate(rows[: len(rows) // 4])]
    random.Random(seed).shuffle(rows)
    return rows


def test_quality_learns_preferences(spark):
    rows = marked(500, 41)
    docs = table(spark, [(i, t) for i, (t, _) in enumerate(rows)] + [(10_000 + i, t) for i, t in enumerate(ODD)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if i % 3], "doc_id long, label int")
    model = quality.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, (_, y) in enumerate(rows) if i % 3 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([s >= 0.5 for s in good]) > 0.95 and np.mean([s < 0.5 for s in bad]) > 0.8
    again = quality.learn(docs, labels)
    assert np.array_equal(again.weights, model.weights)


def test_quality_without_rows_or_with_one_label(spark):
    docs = table(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert all(r["score"] >= 0.5 for r in quality.scored(docs, quality.learn(docs, labels)).collect())
    none = labels.where("false")
    assert quality.scored(docs, quality.learn(docs, none)).count() == 2
    assert quality.scored(table(spark, []), quality.learn(docs, labels)).count() == 0


def test_features_do_not_depend_on_the_batch():
    rows = [t or "" for t in ODD] + texts(20, 42)
    one = quality.features(pa.array(rows))
    assert np.allclose(one, np.concatenate([quality.features(pa.array([t])) for t in rows]))


def tongues():
    rng = random.Random(43)
    made = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(300)] for k, a in (("aa", "aeioulmnr"), ("bb", "eéèstrpn"), ("cc", "ßchüzkwen"))}
    return [(" ".join(rng.choice(made[k]) for _ in range(rng.randrange(4, 60))), k) for i in range(600) for k in [rng.choice("aaabbc") * 2]]


def test_language_on_held_out_texts(spark):
    rows = tongues()
    docs = spark.createDataFrame([(i, t, k if i % 7 else None) for i, (t, k) in enumerate(rows)] + [(9000 + i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    model = language.learn(docs.where("doc_id % 4 != 2"))
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, (_, k) in enumerate(rows) if i % 4 == 2]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    und = {i for i in range(len(ODD)) if got[9000 + i]["lang_pred"] == "und"}
    assert und == {i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")}
    right = [got[i]["accepted"] for i, (_, k) in enumerate(rows) if i % 4 == 2]
    assert np.mean(right) > 0.8


def test_language_without_anything_to_learn_from(spark):
    docs = table(spark, [(1, "abc"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert [r["lang_pred"] for r in language.identify(docs, language.learn(docs)).collect()] == ["und", "und"]
    assert language.identify(table(spark, []), language.learn(docs)).count() == 0


def test_letters_of_any_script():
    assert language.has_letter(pa.array(["Ж", "中", "12 é", "‚…", "\U0001f600", "5", "", "[{@"])).tolist() == [True, True, True, False, False, False, False, False]


def test_contradicting_labels_teach_nothing(spark):
    rows = marked(200, 51)
    docs = table(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    labels = [(i, y) for i, (_, y) in enumerate(rows)]
    both = [(i, 1 - y) for i, y in labels[:40]]
    made = [quality.learn(docs, spark.createDataFrame(x, "doc_id long, label int").repartition(3)) for x in (labels + both, labels[40:])]
    assert np.array_equal(made[0].weights, made[1].weights) and made[0].cut == made[1].cut


def test_columns_of_any_name_are_kept(spark):
    docs = table(spark, [(1, "a b"), (2, None)]).withColumnsRenamed({"key": "a`b.c d", "a": "score"})
    found = quality.scored(docs, quality.learn(docs, spark.createDataFrame([], "doc_id long, label int")), "worth")
    assert found.columns == [*docs.columns, "worth"] and found.count() == 2


def test_quality_fits_pairs_and_cuts_between_kinds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    truth = np.array([2.0, -1.0, 0, 0, 0.5, 0])
    label = (x @ truth + rng.normal(0, 0.3, 400) > -0.5).astype(int)
    model = quality.fit(x, label)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = z[label == 1][:, None, :] - z[label == 0][None]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 0.5e-3 * (w @ w)
    best = np.zeros(6)
    for _ in range(3000):  # all pairs, by plain gradient descent
        miss = 1 / (1 + np.exp(d @ best))
        best += 0.5 * (np.tensordot(miss, d, 2) / miss.size - 1e-3 * best)
    assert loss(model.weights) < loss(best) * 1.05 + 0.005
    assert np.corrcoef(model.weights, best)[0, 1] > 0.99
    worth = np.clip(z, -8, 8) @ model.weights
    assert np.allclose(model.worth(x), worth) and np.array_equal(model.score(x) >= 0.5, worth >= model.cut)
    assert ((worth >= model.cut) == label).mean() > 0.93


def test_language_scores_are_those_of_a_plain_loop(spark):
    rows = tongues()[:120]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    some = [t for t, _ in rows[:20]] + ["É ab, c9d", "x"]
    for text, chance in zip(some, model.chances(pa.array(some))):
        low = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        letter = [97 <= b <= 122 or b >= 128 for b in low]
        said = [b if is_letter else 32 for b, is_letter in zip(low, letter)]
        logits, n = np.zeros(len(model.names)), 0
        for i in range(len(said) - 2):
            if any(letter[i : i + 3]):
                h = (said[i] * 0x9E3779B1 + said[i + 1] * 0x85EBCA77 + said[i + 2] * 0xC2B2AE3D) % 2**32
                h ^= h >> 15
                h = h * 0x2C1B3C6D % 2**32
                logits += model.table[(h >> 20) % language.BUCKETS]
                n += 1
        z = np.exp((logits / max(n, 1) + model.bias) / model.heat)
        assert np.allclose(chance, z / z.sum(), atol=1e-6)


def test_held_out_documents_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op5_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 300 and np.mean([p == y for _, p, y in held]) > 0.97
    assert np.mean([p == 1 for _, p, y in held if y == 1]) > 0.98
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    told = [(r["lang_pred"], langs[r["doc_id"]]) for r in QUERIES["op8_language_id"](spark, sf).collect() if r["held_out"] and langs[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    for lang in {x for _, x in told}:
        assert np.mean([p == x for p, x in told if x == lang]) > 0.97
