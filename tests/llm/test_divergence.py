import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import divergence as D
from tests.llm.helpers import ODD, texts

DOCS = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source", "slot", "value")])
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(_LOWER))


def brute(rows, least, foremost):
    docs = [(lang or "", source or "", terms_of(text or "")) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, t) for x, s, t in docs if x == lang]
        spread = Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, n in spread.items() if n >= least)
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if spread[t] >= least)
        every = sum(counts.values(), Counter())

        def share(c, t, size=len(kept)):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * size)

        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), name) for name, o in counts.items() if name != s]
            ahead = [(share(every, t) - share(c, t), t) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(ahead)[:foremost])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def case():
    langs, sources = ["en", "de", None, ""], [f"s{i}" for i in range(11)] + [None, ""]
    said = texts(160, 3, 60, 40) + [t for t in ODD if t is None or len(t) < 100]
    rows = [(t, langs[i % 7 % 4], sources[i % 13 if i % 3 else 0]) for i, t in enumerate(said)]
    rows += [rows[5]] * 9 + [("Éa éA eé-x1y's" + chr(0x7F) + "Z", "en", "s1")] * 6 + [("solo words only here", "xx", "a"), (None, "xx", "b"), ("", "yy", "alone")]
    return rows


@pytest.mark.parametrize("shard_terms, slot_sources", [(D.SHARD_TERMS, D.SLOT_SOURCES), (7, 1), (30, 3)])
def test_equals_brute_force(spark, shard_terms, slot_sources):
    rows = case()
    got = D.audit(table(spark, rows).repartition(3), 4, 6, shard_terms, slot_sources)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, 4, 6)


def test_no_documents_and_no_terms(spark):
    assert D.audit(table(spark, []), 2, 5).count() == 0
    rows = [(None, None, "a"), ("12 34", "", "b"), ("", "", None)]
    assert sorted(tuple(r) for r in D.audit(table(spark, rows), 2, 5).collect()) == brute(rows, 2, 5)


def test_every_pair_meets_once(spark):
    for slots in range(1, 12):
        met = []
        for turn in range(slots + slots % 2 - 1):
            rows = spark.range(slots).select("id", D.partner(F.col("id"), F.lit(slots), turn).alias("other")).collect()
            pairs = {tuple(sorted((r["id"], r["other"]))) for r in rows if r["other"] < slots}
            assert len({x for p in pairs for x in p}) == 2 * len(pairs)
            met += pairs
        assert sorted(met) == [(a, b) for a in range(slots) for b in range(a + 1, slots)]


def test_words_of_very_long_texts(monkeypatch):
    long = " ".join(texts(3000, 8, 50)) + " É" + "ü" * 700 + "q " + "z" * 5000
    raw = long.encode()
    assert len(raw) > 1 << 18
    want = [t.encode() for t in terms_of(long)]
    for piece in (1 << 20, 4096, 61):
        monkeypatch.setattr(D, "PIECE", piece)
        assert [w for p in D.words(raw) for w in p] == want


def test_shares_are_exact():
    for count, total, size in ((0, 0, 1), (5, 5, 1), (10**12, 3 * 10**13, 10**7), (7, 10**15, 3), (123456789, 987654321, 12345)):
        assert D.shares([count], total, size).tolist() == [1 + 10**9 * (count + 5) // (total + 5 * size)]


def test_sums_that_are_passed_on_early(spark, monkeypatch):
    rows = case()
    want = sorted(map(tuple, D.term_counts(table(spark, rows).coalesce(1)).collect()))
    one = Counter(t for text, lang, source in rows if (lang, source) == ("en", "s1") for t in terms_of(text or ""))
    assert {r[2]: r[3] for r in want if r[:2] == ("en", "s1") and r[2]} == dict(one)
    assert {(r[0], r[1]) for r in want if not r[2]} == {(x or "", s or "") for _, x, s in rows}
