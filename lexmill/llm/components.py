"""Connected components by alternating large-star and small-star rounds, without collecting links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed

#: Links that one task joins to a forest before the rounds begin. A dense group has far fewer nodes than links.
PART = 50_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every neighbour above a node to the least node next to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b. Links a node and the nodes below it to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select("a", F.col("m").alias("b")))


class Forest:
    """Joins nodes by links, and gives one link a node instead: to the least node that it is joined with."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def add(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b, strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def stars(self) -> Iterator[pa.RecordBatch]:
        found = [(x, self.find(x)) for x in list(self.root) if self.find(x) != x]
        for i in range(0, len(found), 10_000):
            nodes, least = zip(*found[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a part's links, of which there are about PART."""
    forest = Forest()
    for batch in batches:
        forest.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    yield from forest.stars()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b long. Returns node, component (the least node reachable) for every node that has a link.

    Forests of parts of the links come first: a group that many keys have found leaves one link a node and part. Then every
    round costs two aggregations and two joins of the links that are left, and is written to the checkpoint folder.
    A node with very many links meets only a minimum with map-side combine, and joins that the engine may split.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = 1 + edges.count() // PART
    edges = checkpointed(edges.repartition(parts).mapInArrow(_forest, "a long, b long").distinct())
    state = _state(edges)
    while state[0] and parts > 1:  # the forest of a single part is what the rounds would end with
        edges = checkpointed(_small_star(_large_star(edges)).where("a != b").distinct())
        state, before = _state(edges), state
        if state == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
