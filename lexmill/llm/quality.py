"""Quality scores from pairwise preferences: a Bradley-Terry model over counts and shares of a text's bytes, words and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import SPACE, U64, mix, prefix_sums, quoted, range_hashes, slices, utf8_view, word_spans

#: Labelled rows that a model is learnt from, at most (documented bound; the rows are those of the least id hashes).
SAMPLE = 8000
#: Preference pairs drawn from them.
PAIRS = 60_000
#: Bytes whose shares are features of their own: all ASCII that is neither a letter nor a digit.
_SIGNS = [b for b in range(0x20, 0x7F) if not chr(b).isalnum()]
_SIGN_CODE = np.full(256, -1)
_SIGN_CODE[_SIGNS] = np.arange(len(_SIGNS))
#: A line shorter than this many bytes says too little about its make-up.
_LINE = 24
#: Shares also count as whether there is more than this of them.
_STEPS = (0.01, 0.05, 0.2)


def _sums(held: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many are true between cuts."""
    if np.count_nonzero(held) * 2 > len(held):
        return np.diff(cuts) - _sums(~held, cuts)
    return np.diff(np.searchsorted(np.flatnonzero(held), cuts))


def _shares(data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Per range: shares of capitals among letters, of digits, of signs, of bars, of signs that end words."""
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    digit = (data >= 0x30) & (data <= 0x39)
    sign = ~(letter | digit | SPACE[data] | (data < 0x20) | (data == 0x2E) | (data == 0x2C))
    size = np.maximum(np.diff(cuts), 1)
    return [_sums(upper, cuts) / np.maximum(_sums(letter, cuts), 1), _sums(digit, cuts) / size, _sums(sign, cuts) / size, _sums(data == 0x7C, cuts) / size, 1 - _sums(letter, cuts) / size]


def _top(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows)
    np.maximum.at(out, row, values)
    return out


def features(column: pa.Array) -> np.ndarray:
    """(rows, n) numbers of each whole text; an empty text has zeros throughout."""
    data, offsets = utf8_view(column)
    rows = len(offsets) - 1
    size = np.diff(offsets)
    whole = _shares(data, offsets)
    at = np.flatnonzero(_SIGN_CODE[data] >= 0)
    code = (np.searchsorted(offsets, at, "right") - 1) * len(_SIGNS) + _SIGN_CODE[data[at]]
    signs = list((np.bincount(code, minlength=rows * len(_SIGNS)).reshape(rows, -1) / np.maximum(size, 1)[:, None]).T)

    starts, ends, first = word_spans(~SPACE[data], offsets)
    many = np.diff(first)
    row = np.repeat(np.arange(rows), many)
    per_word = np.maximum(many, 1)
    if len(starts):
        h = range_hashes(prefix_sums(data), starts, ends)
        length = ends - starts
        tag = mix(h + row.astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(tag, kind="stable")
        fresh = np.ones(len(tag), bool)
        fresh[1:] = tag[order][1:] != tag[order][:-1]
        group = np.cumsum(fresh) - 1
        times = np.bincount(group)
        distinct = np.bincount(row[order][fresh], minlength=rows) / per_word
        commonest = _top(times.astype(float), row[order][fresh], rows) / per_word
        again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows) / per_word
        mean = np.bincount(row, length, rows) / per_word
        short = np.bincount(row[length <= 3], minlength=rows) / per_word
        long = np.bincount(row[length >= 15], minlength=rows) / per_word
        last = data[ends - 1]
        marked = ~((last >= 0x80) | ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A) | (last == 0x2E) | (last == 0x2C))
        odd_end = np.bincount(row[marked], minlength=rows) / per_word
    else:
        distinct = commonest = again = mean = short = long = odd_end = np.zeros(rows)

    # Lines: what the worst of them is like, since junk may stand beside good lines.
    edge = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
    line_row = np.searchsorted(offsets, edge[:-1], "right") - 1
    long_line = np.diff(edge) >= _LINE
    worst = [_top(x[long_line], line_row[long_line], rows) for x in (_shares(data, edge) if len(edge) > 1 else [np.zeros(0)] * 5)]
    lines = np.bincount(line_row, minlength=rows)
    if len(edge) > 1:
        mark = mix(range_hashes(prefix_sums(data), edge[:-1], edge[1:]) + line_row.astype(U64))
        _, inverse, count = np.unique(mark, return_inverse=True, return_counts=True)
        twice = np.bincount(line_row, count[inverse] > 1, rows) / np.maximum(lines, 1)
    else:
        twice = np.zeros(rows)

    shares = [*whole, *worst, commonest, again, long, odd_end, twice]
    steps = [np.minimum(x / s, 1.0) for x in shares for s in _STEPS]
    counts = [np.log1p(size), np.log1p(many), np.log1p(lines), distinct, mean / 10, short, distinct * np.log1p(many)]
    return np.stack([*shares, *steps, *signs, *counts], axis=1) if rows else np.zeros((0, 1))


class Model:
    """Weights over standardised features, the cut and the slope that turn a worth into a score of 0 to 1."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float, slope: float) -> None:
        self.centre, self.spread, self.weights, self.cut, self.slope = centre, spread, weights, cut, slope

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.worth(x) - self.cut) * self.slope, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Model:
    """Learns worths by logistic loss on feature differences of (better, worse) pairs, by stochastic gradient descent.

    The cut is a quantile of the learning rows' scores: of those near the share of worse rows, the one that errs least, both
    labels weighing the same. Rows of a single label give a model that scores every text alike, on that label's side.
    """
    if not len(x) or len(set(label.tolist())) < 2:
        n = x.shape[1] if x.ndim == 2 and len(x) else len(features(pa.array(["a"]))[0])
        side = -1.0 if not len(x) or label[0] == 1 else 1.0
        return Model(np.zeros(n), np.ones(n), np.zeros(n), side, 1.0)
    rng = np.random.default_rng(seed)
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.clip((x - centre) / spread, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = np.zeros(x.shape[1])
    moment, second, step = np.zeros_like(w), np.zeros_like(w), 0
    for rate in (0.02, 0.01, 0.005, 0.002):
        a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
        for i in range(0, pairs, 256):
            d = z[a[i : i + 256]] - z[b[i : i + 256]]
            miss = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            g = -(miss @ d) / len(d) + 1e-3 * w
            step += 1
            moment, second = 0.9 * moment + 0.1 * g, 0.99 * second + 0.01 * g * g
            w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    worth = z @ w
    share = len(bad) / len(label)
    ranks = np.unique(np.clip(np.linspace(0.25 * share, min(1.0, 1.75 * share), 61), 0, 1))
    cuts = np.quantile(worth, ranks)
    errors = [(worth[bad] >= c).mean() + (worth[good] < c).mean() for c in cuts]
    cut = cuts[int(np.argmin(errors))]
    below, above = worth[worth < cut], worth[worth >= cut]
    if len(below) and len(above):  # between two rows, nearer to the worse one: a doubtful text stays
        cut = below.max() + (above.min() - below.max()) / 3
    return Model(centre, spread, w, float(cut), 2.0 / max(float(np.std(worth[good])), 1e-6))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on the documents (doc_id, text) that `labels` (doc_id, label 0 or 1) marks, on `sample` of them at most.

    A null text is empty; a label that is neither is none, and so are labels of one doc_id that contradict each other; each of
    several texts of a labelled doc_id counts. Without rows of both labels the model scores all texts alike (see fit). The
    rows are put in order, so that the same tables give the same model.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = marked.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    n = known.count()
    part = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * sample / max(n, 1)) + 1)).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 20):
                x = features(batch.column(2).slice(a, b - a)).astype("<f8")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample has a fixed number of short rows.
    rows = plain.join(F.broadcast(part), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], "<f8") for r in rows]) if rows else np.zeros((0, 1))
    return fit(x, np.array([r["label"] for r in rows], np.int64))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds a score (0 to 1) to all columns of docs, in place of one of that name. Null is the empty text; a table without rows stays so."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fieldNames() if f != name]
    places = [f"c{i}" for i in range(len(fields))]  # names that an Arrow function can take
    schema = T.StructType([*(T.StructField(c, docs.schema[f].dataType) for c, f in zip(places, fields, strict=True)), T.StructField("score", T.DoubleType())])
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), 1 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(box.value.score(features(part.column(at))))], names=[*places, "score"])

    return docs.select(*(F.col(quoted(f)).alias(c) for c, f in zip(places, fields, strict=True))).mapInArrow(run, schema).toDF(*fields, name)
