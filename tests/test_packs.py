"""How an index is built: postings come in packs, and tokens are what a scan has."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import tokens as T
from lexmill.functions.text import ACCENTED, PLAIN
from lexmill.operators import index as I


def test_a_token_of_many_rows_travels_in_few_packs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "LEAST_PART_BYTES", 4000)
    monkeypatch.setattr(I, "SAMPLE", 300)
    rows = spark.range(3000).select("id", F.concat(F.lit("common "), F.lit("w"), (F.col("id") % 7).cast("string"), F.lit(" own"), "id").alias("content"), F.lit("common").alias("title"))
    index = I.Index.build(rows.repartition(5, F.xxhash64("id")), f"{tmp_path}/i")
    (segment,) = index.segments
    packs = [r.asDict() for r in index._read(segment, "packs").withColumn("file", F.input_file_name()).collect()]
    assert len(packs) <= 3000 + 2 * (3000 // I.PACK + 6) + 7 * (3000 // I.BLOCK_IDS + 1) * 10
    for token in ("common", ""):
        held = [p for p in packs if p["token"] == token]
        assert len(held) <= 3000 // I.PACK + 6 and sorted(i for p in held for i in p["ids"]) == list(range(3000))
    sizes = {}
    for p in packs:
        sizes[p["file"]] = sizes.get(p["file"], 0) + p["docs"]
    assert segment.parts >= 3 and len(sizes) == segment.parts and max(sizes.values()) < 2 * 12_000 / segment.parts
    told = index.matching({"common", "w3"}).orderBy("id", "token").limit(9).collect()
    assert [(r["id"], r["token"], r["n"], r["content"], r["title"], r["often"]) for r in told if r["id"] in (2, 3)] == [(2, "common", 4, [0], [0], 2), (3, "common", 4, [0], [0], 2), (3, "w3", 4, [1], [], 1)]


def test_packs_that_lost_rows_are_packed_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"aa bb aa x{i % 3}", "aa" if i % 2 else None) for i in range(150)], "id long, content string, title string")
    index = I.Index.build(rows, f"{tmp_path}/i")
    packs = index._read(index.segments[0], "packs")
    again = I._packed(I._posts(packs))
    assert again.columns == packs.columns and dict(again.dtypes) == dict(packs.dtypes) | {"hits": "bigint"}
    said = lambda p: sorted((r["token"], r["id"], r["n"], r["often"], tuple(r["content"]), tuple(r["title"])) for r in I._posts(p).collect())
    assert said(again) == said(packs) and len(said(packs)) == 150 * 4
    total = lambda p: {tuple(r) for r in p.groupBy("token").agg(F.sum("docs"), F.max("most"), F.min("least"), F.sum("hits")).collect()}
    assert total(again) == total(packs)


def test_spelled_texts_have_the_same_tokens(spark):
    odd = ["", None, "Őr és ÁRVÍZ—tűrő", "İzmir İx", "Ångström Ångström ångström", "Å İ É", "ΑΣ ΑΣ'Α ΣÉ ÉΣ", "a_b-c.d\ne\x00f\tg", "§ 12. § ½ ² Ⅳ", "東京 тест ТЕСТ", "x\U0001d518\U0001f600y", "ß ẞ ﬁ ŉ", "éa", "KK k", "x" * 70_000 + " É"]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, s string")
    got = rows.select(T.tokens(F.col("s")).alias("t"), T.spelled(F.col("s")).alias("s")).collect()
    for r in got:
        assert [T.plain(w) for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", r["s"])] == r["t"], r["s"][:50]
    marks = dict(zip(ACCENTED, PLAIN, strict=True))
    other = {c for c in map(chr, range(0x110000)) if (marks.get(c.lower()) != marks[c].lower() if c in marks and c.islower() is False else c not in marks and any(x in marks for x in c.lower()))}
    assert other == {"İ", "Å"}  # no other letter needs more than its small letter's mark taken off


def test_pieces_are_cut_between_blocks_and_by_bytes(monkeypatch):
    def batch(block, texts):
        return pa.record_batch({"id": np.arange(len(block)), "block": np.array(block), "cut": np.array([len(t) for t in texts], np.int32), "said": pa.array([t + "\n" for t in texts])})

    monkeypatch.setattr(I, "GATHERED", 5)
    assert [p.num_rows for p in I._pieces(batch([0] * 3 + [1] * 4 + [2] * 7, ["a"] * 14))] == [3, 4, 5, 2]
    monkeypatch.setattr(I, "GATHERED_BYTES", 10)
    assert [p.num_rows for p in I._pieces(batch([0] * 4, ["a" * 30, "b" * 3, "c" * 3, "d" * 30]))] == [1, 2, 1]
    words, made = I._gather(batch([0, 0, 1], ["b a b", "", "é"]))
    assert words.to_pylist() == ["", "a", "b", "e"]
    assert made["ids"].to_pylist() == [[0, 1], [2], [0], [0], [2]] and made["places"].to_pylist() == [[], [], [1], [0, 2], [0]] and made["hits"].to_pylist() == [0, 0, 1, 2, 1]
