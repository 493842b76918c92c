"""What must not come to one task as tables grow."""

import re
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.catalog import adapters, folds, search
from lexmill.functions import text as X
from lexmill.operators import index as I
from lexmill.storage import COSTLY_ROWS


def test_pages_are_dealt_over_tasks_however_small_their_file_is(spark, tmp_path):
    many = 3 * COSTLY_ROWS
    rows = spark.range(many).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Name "), "id").alias("c_name"), F.lit("HOME").alias("c_mktsegment"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for query in (folds.official_title, folds.split_blocks):
        sizes = query(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.countDistinct("id").alias("n")).collect()
        assert len(sizes) >= 3 and max(r["n"] for r in sizes) <= 2 * COSTLY_ROWS and sum(r["n"] for r in sizes) == many
    plan = folds.parse_provisions(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the dealing; blocks of a page meet where they were made


@pytest.mark.parametrize("name", ["search_topk", "search_status_document", "search_cascade", "like_search", "like_search_only", "fts_prefix"])
def test_one_search_does_not_write_an_index_of_the_whole_table(spark, tmp_path, monkeypatch, name):
    place = str(tmp_path / "sf")
    shutil.copytree("/root/testdata/sf0.001", place)
    ask = getattr(search, name, None) or search.query.__globals__["QUERIES"][name]

    def no_index(*args, **how):
        raise AssertionError("an index for one search")

    with monkeypatch.context() as m:
        m.setattr(I.Index, "build", no_index)
        got = ask(spark, place).collect()
    adapters.index(spark, place)
    assert sorted(map(str, ask(spark, place).collect())) == sorted(map(str, got))


def test_like_reads_a_text_once_and_says_what_like_says(spark):
    long = "a" * 6000
    said = ["", "a", "ab", "xaYbz", "a\nb", "A.b", "aab", "abab", "é_%", "ba", "a b a", "\U0001d518b", long]
    rows = spark.createDataFrame([(s,) for s in said], "s string").coalesce(1)
    for pattern in ("", "%", "a", "%a%", "a%b", "%a%b%", "%b", "a_b", "_b", "%a_%b", "a%a%b", "%.%", "%%b%%", "é%", "%A%A%", "%a%a%a%b%", "%a%a%a%a%b", "a%\\%"):
        wanted = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in re.sub("%+", "%", pattern)), re.S | re.A | re.I)
        fits = [s for s in said if s != long and wanted.fullmatch(s)] + [long] * (set(pattern) <= set("%aA"[: 1 + ("%" in pattern) * 2]) and "%" in pattern)
        assert sorted(r["s"] for r in rows.where(X.like_ascii(F.col("s"), pattern)).collect()) == sorted(fits), pattern


def test_blocks_are_told_from_postings_in_their_order():
    """No exchange of postings, and no memory beyond a batch."""
    posts = [("a", 0, 2, 9), ("a", 0, 5, 4), ("a", 1, 1, 7), ("b", 1, 3, 8), ("b", 1, 1, 6)]
    columns = [pa.array([p[i] for p in posts], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))]
    batch = pa.record_batch(columns, ["token", "block", "often", "n"])
    told = [tuple(r.values()) for b in I._blocked([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert told == [("a", 0, 2, 5, 4, 7), ("a", 1, 1, 1, 7, 1), ("b", 1, 2, 3, 6, 4)]
