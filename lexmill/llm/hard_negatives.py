"""Hard negatives of anchors by exact integer products, component bit-planes most significant first.

Components become integers. A row's product with an anchor is the sum, over the bit-planes of the row's components, of the
plane's weight times the anchor's components where the plane has a bit. After each plane the planes that are left bound the
score from both sides; a row whose interval can no longer qualify is dropped, and the last plane leaves exact scores.

Anchors are taken in waves of bounded size that all executors get; each task streams its rows past a wave and keeps the few
best of every anchor. First the positives, then the negatives within the ranges that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, numbered, whole_column

#: Components are floor(256 * x); beyond this many bits they stop at the greatest or least such integer.
SCALE, COMPONENT_BITS = 256, 26
#: Anchors of a wave: at most so many, of so many components together.
WAVE_ROWS, WAVE_COMPONENTS = 16_384, 1 << 21
#: Anchors and rows that meet at once within a task, and the share of pairs from which on they are held as a list.
ANCHOR_BLOCK, ROW_BLOCK, FEW = 256, 4096, 1 / 8
_LEAST = -(1 << 62)


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """id, label, q: rows that take part, with integer components.

    Rows with a null vec_id, label, vector or component, or a component that is not finite, take no part. Of rows that share
    a vec_id one counts, that of the least label, then the least components. An empty vector has the product 0 with any.
    """
    told = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    most = 1 << COMPONENT_BITS
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(SCALE)), F.lit(float(most))), F.lit(-float(most)))).cast("int"))
    sound = told.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(~odd)
    return sound.groupBy("id").agg(F.min(F.struct("label", whole.alias("q"))).alias("r")).select("id", "r.label", "r.q")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, those that are shorter filled up with zeros."""
    column = whole_column(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """The best few of each goal: a range of scores that an anchor looks in. Higher scores first, ties by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int) -> None:
        self.low, self.high, self.keep = low, high, keep  # anchors x goals
        self.score = np.full((*low.shape, keep), _LEAST, np.int64)
        self.id = np.full((*low.shape, keep), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """What a score must reach for each goal: the range's low end, or the last of the best so far."""
        return np.maximum(self.low, self.score[:, :, -1])

    def take(self, anchor: np.ndarray, row_id: np.ndarray, score: np.ndarray) -> None:
        """Adds exact scores."""
        for g in range(self.low.shape[1]):
            fits = (score >= self.floor()[anchor, g]) & (score <= self.high[anchor, g])
            a, i, s = anchor[fits], row_id[fits], score[fits]
            if not len(a):
                continue
            met = np.unique(a)
            a = np.concatenate([a, np.repeat(met, self.keep)])
            i, s = np.concatenate([i, self.id[met, g].ravel()]), np.concatenate([s, self.score[met, g].ravel()])
            order = np.lexsort((i, -s, a))
            a, i, s = a[order], i[order], s[order]
            turn = np.arange(len(a)) - np.searchsorted(a, a)
            first = turn < self.keep
            self.score[a[first], g, turn[first]], self.id[a[first], g, turn[first]] = s[first], i[first]


def _nth(anchor: np.ndarray, value: np.ndarray, n: int, anchors: int) -> np.ndarray:
    """For each anchor the n-th greatest of its values; the least possible where it has fewer."""
    out = np.full(anchors, _LEAST, np.int64)
    order = np.lexsort((-value, anchor))
    a = anchor[order]
    at = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == n - 1)
    out[a[at]] = value[order][at]
    return out


def meet(anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, alive: np.ndarray, best: Best) -> None:
    """Scores the pairs that are alive, plane by plane, and gives `best` those that are left after the last."""
    size = int(np.abs(anchors).sum(axis=1).max(initial=0))
    bits = int(np.abs(rows).max(initial=0)).bit_length()  # the planes below the sign
    whole = np.int64 if size << (bits + 1) >= 1 << 53 else np.float64
    part = np.float32 if size < 1 << 24 else whole
    a = anchors.astype(part)
    above, below = (x.sum(axis=1).astype(whole) for x in (anchors.clip(min=0), anchors.clip(max=0)))
    columns = np.flatnonzero(alive.any(axis=0))
    alive, score = alive[:, columns], np.zeros((len(anchors), len(columns)), whole)
    pairs = None  # anchor, column and score of each, once there are few
    for k in range(bits, -1, -1):
        if pairs is None and len(columns) and (n := np.count_nonzero(alive)) < FEW * alive.size:
            i, j = np.nonzero(alive)
            pairs = i, columns[j], score[i, j]
        if not len(columns) or pairs is not None and not len(pairs[0]):
            return
        plane = ((rows >> k) & 1).astype(part)  # two's complement: the sign's plane has a negative weight
        weight, left = whole(-(1 << k) if k == bits else 1 << k), (1 << k) - 1
        need = best.floor()
        if pairs is None:
            score += weight * (a @ plane[columns].T).astype(whole)
            alive &= (score + (above * left)[:, None] >= need.min(axis=1)[:, None]) & (score + (below * left)[:, None] <= best.high.max(axis=1)[:, None])
            if (some := alive.any(axis=0)).sum() < 0.7 * len(columns):
                columns, alive, score = columns[some], alive[:, some], score[:, some]
            continue
        i, j, s = pairs
        s = s.copy()
        for b in range(0, len(i), 1 << 16):
            s[b : b + (1 << 16)] += weight * np.einsum("ij,ij->i", a[i[b : b + (1 << 16)]], plane[j[b : b + (1 << 16)]]).astype(whole)
        low, high = s + (below * left)[i], s + (above * left)[i]
        keep = np.zeros(len(i), bool)
        for g in range(best.low.shape[1]):
            sure = (low >= best.low[i, g]) & (high <= best.high[i, g])
            least = np.maximum(need[:, g], _nth(i[sure], low[sure].astype(np.int64), best.keep, len(anchors)))
            keep |= (high >= least[i]) & (low <= best.high[i, g])
        pairs = i[keep], j[keep], s[keep]
    if pairs is None:
        i, j = np.nonzero(alive)
        pairs = i, columns[j], score[i, j]
    best.take(pairs[0], ids[pairs[1]], pairs[2].astype(np.int64))


def stream(batches: Iterator[pa.RecordBatch], ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, same: bool) -> Best:
    """The best of a partition's rows: other rows of the anchor's own label, or rows of other labels."""
    best = Best(low, high, keep)
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            piece = batch.slice(at, ROW_BLOCK)
            row_ids, row_labels = (piece.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label"))
            column = whole_column(piece.column("q"))
            width = max(anchors.shape[1], int(np.diff(column.offsets.to_numpy()).max(initial=0)))
            rows = matrix(column, width)[:, : anchors.shape[1]]  # what an anchor lacks is zero
            for b in range(0, len(ids), ANCHOR_BLOCK):
                block = slice(b, b + ANCHOR_BLOCK)
                for label in np.unique(labels[block]) if same else [None]:
                    mine = np.arange(len(ids))[block][labels[block] == label] if same else np.arange(len(ids))[block]
                    theirs = np.flatnonzero(row_labels == label) if same else np.arange(len(row_ids))
                    apart = row_ids[theirs][None, :] != ids[mine][:, None] if same else row_labels[None, :] != labels[mine][:, None]
                    inner = Best(best.low[mine], best.high[mine], keep)
                    inner.score, inner.id = best.score[mine], best.id[mine]
                    meet(anchors[mine], rows[theirs], row_ids[theirs], apart, inner)
                    best.score[mine], best.id[mine] = inner.score, inner.id
    return best


def first_positives(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, keep: int) -> DataFrame:
    """anchor_id, positive_id, score: the first rows of each anchor's label, the anchor itself left out."""

    def run(batches):
        best = stream(batches, ids, labels, anchors, np.full((len(ids), 1), _LEAST + 1), np.full((len(ids), 1), -_LEAST), keep, True)
        a, g, k = np.nonzero(best.score > _LEAST)
        yield pa.record_batch({"anchor_id": ids[a], "positive_id": best.id[a, g, k], "score": best.score[a, g, k]})

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def first_negatives(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, positives: list, keep: int, least: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: the first rows of other labels in each positive's range."""
    most = max((r["rank"] for r in positives), default=1)
    place = {int(x): i for i, x in enumerate(ids.tolist())}
    low, high, other = np.full((len(ids), most), 1), np.full((len(ids), most), 0), np.zeros((len(ids), most), np.int64)
    for r in positives:
        at = place[r["anchor_id"]], r["rank"] - 1
        low[at], high[at], other[at] = -(-least * r["score"] // 100), r["score"], r["positive_id"]

    def run(batches):
        best = stream(batches, ids, labels, anchors, low, high, keep, False)
        a, g, k = np.nonzero(best.score > _LEAST)
        yield pa.record_batch({"anchor_id": ids[a], "positive_id": other[a, g], "negative_id": best.id[a, g, k], "positive_score": high[a, g], "negative_score": best.score[a, g, k]})

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, is_anchor, label=None, positives: int = 5, negatives: int = 5, least: int = 80, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; other columns are left alone. An anchor's positives are its first other rows of its
    label; a positive's negatives the first rows of other labels that score from `least` percent of its score up to it. An
    anchor without positives, and a positive without negatives, have no rows; a negative score leaves the range empty.
    Vectors of unequal length meet as if the shorter went on in zeros. is_anchor and label are expressions of id and label.
    """
    rows = quantised(vectors)
    rows = checkpointed(rows if label is None else rows.withColumn("label", label))
    anchors = numbered(rows.where(is_anchor), F.col("id"))
    extent = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    wave = max(1, min(wave_rows, WAVE_COMPONENTS // max(1, extent["width"] or 1)))
    out = None
    for begin in range(0, max(1, extent["n"]), wave):
        told = anchors.where(F.col("_number").between(begin, begin + wave - 1)).select("id", "label", "q").toArrow()  # a wave at most
        ids, labels = (told.column(n).to_numpy() for n in ("id", "label"))
        block = matrix(told.column("q"), extent["width"] or 0)
        near = first_positives(rows, ids, labels, block, positives).collect()  # a few for each anchor of the wave
        found = first_negatives(rows, ids, labels, block, near, negatives, least)
        found = found if extent["n"] <= wave else checkpointed(found)
        out = found if out is None else out.unionByName(found)
    return out
