import random
import re
from collections import Counter

from lexmill.llm import licenses as L
from tests.llm.helpers import ODD, table, texts

SAME = dict(L.SAME)


def words(t):
    return [SAME.get(w, w) for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())]


def dice(a, b):
    a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def plain(text):
    """Templates some stretch of the text is like at 0.8 or more, over all stretches within the size bounds."""
    w, found = words(text), set()
    for t, (_, template) in enumerate(L.TEMPLATES):
        x = words(template)
        n = len(x) - 1
        for size in range(max(1, -(-n * 8 // 12)), n * 12 // 8 + 1):
            if any(dice(w[i : i + size + 1], x) >= 0.8 for i in range(len(w) - size)):
                found.add(t)
                break
    return found


def test_finds_what_some_stretch_is_like(spark):
    rng = random.Random(61)
    rows = []
    for i, t in enumerate(texts(40, 62, 30)):
        w, x = t.split(), L.TEMPLATES[rng.choice([1, 2, 3, 6, 9, 11, 16, 17, 18, 19, 20, 21])][1].split()
        if rng.random() < 0.5:
            x[rng.randrange(len(x))] = "other"
        rows.append(" ".join(w[: len(w) // 2] + [y.upper() for y in x] + w[len(w) // 2 :]))
    rows += ODD + ["Released under the MIT Licence!"]
    got = {}
    for r in L.scan(table(spark, list(enumerate(rows))).repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    hits = 0
    for i, t in enumerate(rows):
        want = plain(t)
        assert bool(want) == (i in got), t
        for r in got.get(i, []):
            w = words(t)[r["first_word"] : r["first_word"] + r["n_words"]]
            assert r["template"] in want and abs(dice(w, words(L.TEMPLATES[r["template"]][1])) - r["dice"]) < 1e-12 and r["dice"] >= 0.8
            hits += 1
    assert hits > 20


def test_every_template_finds_itself_and_whole_texts_match(spark):
    docs = [(i, "Some words before.\n" + t + "\nNothing else follows.") for i, (_, t) in enumerate(L.TEMPLATES)]
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in L.scan(table(spark, docs)).collect()}
    assert got == {i: (n, 1.0) for i, (n, _) in enumerate(L.TEMPLATES)}
    changed = L.TEMPLATES[0][1].replace("Software", "Program")
    (r,) = L.scan(table(spark, [(1, changed)])).collect()
    assert r["license"] == "MIT" and 0.8 <= r["dice"] < 1


def test_ordinary_texts_and_empty_tables(spark):
    assert L.scan(table(spark, list(enumerate(texts(50, 63, 200))))).count() == 0
    assert L.scan(table(spark, [])).count() == 0


def every(text, templates):
    """The best of all stretches, then the best of those without a word in common with it, until none reaches 0.8."""
    w, out = words(text), []
    all_ = [(-dice(w[i : i + n + 1], x), -n, t, i) for t, x in enumerate(map(words, templates)) for n in range(1, 2 * len(x)) for i in range(len(w) - n)]
    for d, n, t, i in sorted(x for x in all_ if x[0] <= -0.8):
        if all(i - n < j or j - m < i for _, j, m, _ in out):
            out.append((t, i, n, -d))
    return {(t, i, 1 - n, d) for t, i, n, d in out}


def test_finds_every_repeat(spark):
    line, mit = "Released under the MIT License.", L.TEMPLATES[0][1]
    assert len(mit.split()) > 100
    rng = random.Random(64)
    short = [(f"t{k}", t) for k, t in enumerate([line, "a b a b a b c a b.", "the work is free of any claim", "a a a a", "Licensed under the CC BY 4.0 or the MIT License, as you like."])]
    rows = [f"{line}\n{line}", f"{line} and so on {line} {line}", "a b a b a b c a b " * 4, "a " * 23]
    for _ in range(60):
        w = [x for _ in range(rng.randrange(1, 5)) for x in rng.choice(short)[1].split()[: rng.choice([4, 99, 99, 99])] + ["z"] * rng.choice([0, 0, 1, 3])]
        rows.append(" ".join(x if rng.random() < 0.95 else "b" for x in w))
    got = {i: [] for i in range(len(rows))}
    for r in L.scan(table(spark, list(enumerate(rows))), tuple(short)).collect():
        got[r["doc_id"]].append((r["template"], r["first_word"], r["n_words"], r["dice"]))
    for i, t in enumerate(rows):
        assert len(got[i]) == len(set(got[i])) and set(got[i]) == every(t, [x for _, x in short]), t
    assert len(got[0]) == 2 and sum(map(len, got.values())) > 100
    found = L.scan(table(spark, [(1, f"{line}\n{line}"), (2, f"{mit}\n\n{mit}\nint x;\n{mit}")])).collect()
    assert sorted((r["doc_id"], r["license"], r["dice"]) for r in found) == [(1, "MIT", 1.0)] * 2 + [(2, "MIT", 1.0)] * 3
