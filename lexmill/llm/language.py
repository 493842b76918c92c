"""Language identification: averaged embeddings of hashed byte trigrams under a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import LOWER, slices, utf8_view

#: Documents that a model is learnt from, at most (documented bound; those of the least id hashes).
SAMPLE = 4000
#: Hash buckets of trigrams, and the width of an embedding.
BUCKETS, WIDTH = 4096, 16
UNDETERMINED = "und"
#: Of the documents kept back for calibration, so many of those accepted may be wrong.
WRONG = 0.01


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of letters and word ends of each row, and the place of each row's first."""
    low = LOWER[data]
    letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    spaced = np.where(letter, low, 0x20).astype(np.uint32)
    n = len(spaced)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = spaced[:-2] * np.uint32(0x9E3779B1) + spaced[1:-1] * np.uint32(0x85EBCA77) + spaced[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    use = (letter[:-2] | letter[1:-1] | letter[2:]) & (np.arange(n - 2) + 3 <= row_end[: n - 2])
    at = np.flatnonzero(use)
    return (h[at] >> np.uint32(20)).astype(np.int64) % BUCKETS, np.searchsorted(at, offsets)


def has_letter(column: pa.Array) -> np.ndarray:
    """Which rows hold a letter of any script. A null row holds none."""
    data, offsets = utf8_view(column)
    low = data | 0x20
    holds = lambda held: np.diff(np.searchsorted(np.flatnonzero(held), offsets)) > 0
    out = holds((low >= 0x61) & (low <= 0x7A))
    for i in np.flatnonzero(~out & holds(data >= 0x80)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


class Model:
    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float) -> None:
        """table: what each bucket adds to each language, its embedding times the softmax weights."""
        self.names, self.table, self.bias, self.heat, self.least = names, table, bias, heat, least

    def chances(self, column: pa.Array) -> np.ndarray:
        """(rows, languages), calibrated. Every trigram of the whole text counts alike."""
        ids, first = trigrams(*utf8_view(column))
        n = np.maximum(np.diff(first), 1)
        logits = np.empty((len(column), len(self.names)))
        for k in range(len(self.names)):
            total = np.concatenate([[0.0], np.cumsum(self.table[ids, k])])
            logits[:, k] = np.diff(total[first]) / n + self.bias[k]
        return softmax(logits / self.heat)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, label: np.ndarray, names: list[str], epochs: int = 12, seed: int = 5) -> Model:
    """x: (documents, BUCKETS) shares of trigrams. Every fifth document is kept back to calibrate.

    The temperature is the one of the best likelihood on those; the least score to accept is the smallest with which no more
    than WRONG of the accepted are wrong.
    """
    rng = np.random.default_rng(seed)
    back = np.arange(len(x)) % 5 == 4
    if back.sum() < 5:
        back[:] = False
    own = np.flatnonzero(~back)
    embedding = rng.normal(0, 0.1, (x.shape[1], WIDTH))
    weights = rng.normal(0, 0.1, (WIDTH, len(names)))
    bias = np.zeros(len(names))
    share = np.bincount(label[own], minlength=len(names))
    even = len(own) / np.maximum(share * len(names), 1)  # rare languages weigh as much as frequent ones
    target = np.eye(len(names))
    for epoch in range(epochs):
        rate = 8.0 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // 32)):
            mean = x[rows] @ embedding
            gap = (softmax(mean @ weights + bias) - target[label[rows]]) * np.minimum(even[label[rows]], 10)[:, None] / len(rows)
            step = x[rows].T @ (gap @ weights.T)
            weights -= rate * 0.1 * (mean.T @ gap)
            bias -= rate * 0.02 * gap.sum(axis=0)
            embedding -= rate * 10 * step
    table = embedding @ weights
    check = np.flatnonzero(back) if back.any() else own
    logits = x[check] @ table + bias
    heats = np.geomspace(0.05, 8, 60)
    loss = [-np.log(softmax(logits / h)[np.arange(len(check)), label[check]] + 1e-12).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    chance = softmax(logits / heat)
    top = chance.max(axis=1)
    wrong = chance.argmax(axis=1) != label[check]
    order = np.argsort(-top, kind="stable")
    fine = np.flatnonzero(np.cumsum(wrong[order]) <= WRONG * np.arange(1, len(order) + 1))
    return Model(names, table, bias, heat, float(top[order[fine[-1]]]) if len(fine) else 1.0)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on docs (doc_id, text, lang) with a language and a letter, on `sample` of them at most."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    n = known.count()
    part = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * sample / max(n, 1)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, first = trigrams(*utf8_view(batch.column(1).slice(a, b - a)))
                blobs = []
                for i in range(b - a):
                    bucket, many = np.unique(ids[first[i] : first[i + 1]], return_counts=True)
                    blobs.append(np.stack([bucket.astype("<f4"), (many / max(1, many.sum())).astype("<f4")]).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(blobs, pa.binary())], names=["doc_id", "lang", "x"])

    rows = [r for r in part.mapInArrow(run, "doc_id long, lang string, x binary").limit(sample).collect() if r["x"]]
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], bytes(r["x"])))
    names = sorted({r["lang"] for r in rows})
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        bucket, share = np.frombuffer(r["x"], "<f4").reshape(2, -1)
        x[i, bucket.astype(int)] = share
    return fit(x, np.array([names.index(r["lang"]) for r in rows], np.int64), names) if rows else Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each of docs (doc_id, text; other columns are ignored).

    lang_pred is a language that the model knows, the likeliest for the whole text, and `und` with score 0 if the text is null
    or has no letter (or the model knows none). accepted: the score reaches the calibrated least one.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                column = batch.column(1).slice(a, b - a)
                sure = has_letter(column) & bool(box.value.names)
                if box.value.names:
                    chance = box.value.chances(column)
                    name = np.array(box.value.names, object)[chance.argmax(axis=1)]
                    score = np.where(sure, chance.max(axis=1), 0.0)
                else:
                    name, score = np.full(b - a, UNDETERMINED, object), np.zeros(b - a)
                name = np.where(sure, name, UNDETERMINED)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(sure & (score >= box.value.least))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
