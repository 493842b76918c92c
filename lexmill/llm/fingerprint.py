"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch is a table of cells; every digest is added to three of them. Cells of two versions subtract, what both hold
cancels, and peeling cells that hold a single digest recovers those that differ. If peeling gets stuck, it is tried again
with a table four times as large.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE, U64, chunk_count, mix, prefix_sums, range_hashes, slices, utf8_view, word_spans

#: A long line is cut into paragraphs after words whose hash is a multiple of this, so that cuts move with the text.
CUT = 6
#: Cells of the sketch that a fingerprint carries: three parts of 2^FIRST each. Retries take 2^(FIRST+2), and so on.
FIRST = 2
_SEEDS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xB5026F5AA96619E9)
_CHECK = 0x61C8864680B583EB
_LAST = np.iinfo(np.int64).max
#: Bytes of text in a range, and ranges at most: their limits are known to every task.
BUCKET_BYTES = 8 << 20
RANGES = 50_000


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of all rows, and each row's first. A digest that repeats in a row is told apart by its turn."""
    starts, ends, first = word_spans(~SPACE[data], offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    sums = prefix_sums(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    lines = np.cumsum(data == 0x0A)
    head = np.ones(len(starts), bool)
    head[1:] = (row[1:] != row[:-1]) | (lines[starts[1:]] != lines[starts[:-1]]) | (range_hashes(sums, starts[:-1], ends[:-1]) % U64(CUT) == 0)
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(starts)) - 1
    digest, row = range_hashes(sums, starts[at], ends[last]), row[at]
    order = np.lexsort((digest, row))
    d, r = digest[order], row[order]
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])
    turn = np.arange(len(d)) - np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0))
    d = mix(d + turn.astype(U64) * U64(_CHECK))
    return d, np.searchsorted(r, np.arange(len(offsets)))


def _add(cells: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray, keys: np.ndarray, signs: np.ndarray, bits: int) -> None:
    """Adds digests (or takes them away) in three cells each of their tables."""
    count, key, check = cells
    signed, checks = signs.astype(U64) * keys, signs.astype(U64) * mix(keys ^ U64(_CHECK))
    for part, seed in enumerate(_SEEDS):
        cell = (table * 3 + part << bits) + (mix(keys ^ U64(seed)) & U64((1 << bits) - 1)).astype(np.int64)
        np.add.at(count, cell, signs)
        np.add.at(key, cell, signed)
        np.add.at(check, cell, checks)


def sketches(keys: np.ndarray, first: np.ndarray, bits: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, key sums and check sums of each row's sketch: (rows, cells)."""
    rows = len(first) - 1
    cells = tuple(np.zeros(rows * 3 << bits, t) for t in (np.int64, U64, U64))
    _add(cells, np.repeat(np.arange(rows), np.diff(first)), keys, np.ones(len(keys), np.int64), bits)
    return tuple(x.reshape(rows, -1) for x in cells)


def encoded(n: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    """Fingerprints: the number of paragraphs and the cells of the first sketch, in base 64."""
    count, key, check = cells
    packed = np.concatenate([n.astype("<i4")[:, None].view(np.uint8), count.astype("<i4").view(np.uint8), key.astype("<u8").view(np.uint8), check.astype("<u8").view(np.uint8)], axis=1) if len(n) else np.zeros((0, 1), np.uint8)
    return [base64.b64encode(x.tobytes()).decode() for x in packed]


def decoded(fingerprint: str) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The number of paragraphs and the cells of a fingerprint."""
    raw, width = base64.b64decode(fingerprint), 3 << FIRST
    key, check = np.frombuffer(raw, "<u8", 2 * width, 4 + 4 * width).reshape(2, -1)
    return int(np.frombuffer(raw, "<i4", 1)[0]), (np.frombuffer(raw, "<i4", width, 4).astype(np.int64), key.astype(U64), check.astype(U64))


def differing(one: str, other: str) -> tuple[set[int], set[int]] | None:
    """Digests of the paragraphs that only the first and only the second of two fingerprinted texts has; None if peeling gets
    stuck, so that a larger sketch of the texts is needed."""
    cells = tuple(x - y for x, y in zip(decoded(one)[1], decoded(other)[1], strict=True))
    _, key, sign, done = peel(cells, 1, FIRST)
    return (set(key[sign > 0].tolist()), set(key[sign < 0].tolist())) if done[0] else None


def peel(cells: tuple[np.ndarray, np.ndarray, np.ndarray], tables: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table, digest and sign (1: only the first version has it, -1: only the second) of what is recovered; whether a table
    came out empty, so that this is all of it."""
    count, key, check = cells
    width = 3 << bits
    found = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        sign = count[look]
        k = sign.astype(U64) * key[look]
        pure = (np.abs(sign) == 1) & (sign.astype(U64) * check[look] == mix(k ^ U64(_CHECK)))
        table, k, sign = look[pure] // width, k[pure], sign[pure]
        if not len(k):
            break
        order = np.lexsort((k, table))
        table, k, sign = table[order], k[order], sign[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (table[1:] != table[:-1])])
        table, k, sign = table[fresh], k[fresh], sign[fresh]
        found.append((table, k, sign))
        _add(cells, table, k, -sign, bits)
        touched = np.concatenate([(table * 3 + part << bits) + (mix(k ^ U64(seed)) & U64((1 << bits) - 1)).astype(np.int64) for part, seed in enumerate(_SEEDS)])
        look = np.unique(touched[np.abs(count[touched]) == 1])
    left = np.zeros(tables, bool)
    left[np.flatnonzero((count != 0) | (key != 0) | (check != 0)) // width] = True
    return (*map(np.concatenate, zip(*found, strict=True)), ~left)


def differences(keys: np.ndarray, first: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, digest and sign of the paragraphs that only one of the rows a and b has, in the order of pairs.

    The fingerprints' own cells subtract first; the pairs that get stuck are tried again with sketches four times as large.
    """
    n = np.diff(first)
    found = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
    todo, bits = np.arange(len(a)), FIRST
    while len(todo):
        step = max(1, (1 << 20) // (3 << bits))
        failed = []
        for i in range(0, len(todo), step):
            own = todo[i : i + step]
            if bits == FIRST:
                rest = tuple((x[a[own]] - x[b[own]]).ravel() for x in cells)
            else:
                rest = tuple(np.zeros(len(own) * 3 << bits, t) for t in (np.int64, U64, U64))
                for rows, sign in ((a[own], 1), (b[own], -1)):
                    many = n[rows]
                    table = np.repeat(np.arange(len(own)), many)
                    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[rows], many)
                    _add(rest, table, keys[at], np.full(len(at), sign, np.int64), bits)
            table, key, sign, done = peel(rest, len(own), bits)
            sure = done[table]
            found.append((own[table[sure]], key[sure], sign[sure]))
            failed.append(own[~done])
        todo, bits = np.concatenate(failed), bits + 2
        spent = (3 << bits) > 16 * (n[a[todo]] + n[b[todo]]) + 1024
        for i in todo[spent].tolist():  # a table of that size fails only where digests collide: compare them one by one
            x, y = (keys[first[r] : first[r + 1]] for r in (a[i], b[i]))
            for own, sign in ((np.setdiff1d(x, y), 1), (np.setdiff1d(y, x), -1)):
                found.append((np.full(len(own), i), own, np.full(len(own), sign)))
        todo = todo[~spent]
    pair, key, sign = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(pair, kind="stable")
    return pair[order], key[order], sign[order]


def likeness(n: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Paragraphs that rows a and b have in common over those that either has, by the digests that differ."""
    more, less = (np.bincount(pair[sign == s], minlength=len(a)) for s in (1, -1))
    common = n[a] - more
    either = common + more + less
    return np.where(either > 0, common / np.maximum(either, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many from the start of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_gone long, n_come long"
_PLACE = np.dtype([("id", "<i8"), ("h", "<i8")])


def _places(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), _PLACE)
    out["id"], out["h"] = ids, h
    return out


def range_limits(plain: DataFrame, least: np.ndarray, rows: int, ranges: int) -> np.ndarray:
    """Where ranges of (id, h) begin, but the first: places that occur, evenly from a sample by hash of some 20 a range."""
    if not len(least) or ranges < 2:
        return np.zeros(0, _PLACE)
    every = max(1, rows // (20 * ranges))
    some = plain.where(F.pmod(F.xxhash64(F.lit("sample"), "id", "h"), F.lit(every)) == 0).select("id", "h").distinct().collect()
    found = np.unique(_places(np.array([r["id"] for r in some], np.int64), np.array([r["h"] for r in some], np.int64)))
    found = found[np.unique(np.arange(1, ranges) * len(found) // ranges)] if len(found) else found
    return found[found != least[0]]


def compare_versions(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, with_digests: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likeness to each other and to the next document's.

    A row for each of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_gone and n_come (paragraphs that only the text and only its edited version has), and with `with_digests` also
    gone and come (their digests, which the fingerprints' difference yields). The next document is the one of the next
    larger doc_id; the first follows the last, and a null doc_id comes last. Rows of equal doc_id follow each other by the
    hash (XXH64) of their texts. Null is the empty text, whose fingerprint has no paragraphs and is like another without
    paragraphs at 1. An empty table gives an empty result; other columns are ignored.

    Documents are dealt by ranges of doc_id (and hash) whose limits are places that occur, so that the first document of a
    range is known beforehand and travels to the range before it as well: texts are moved once. There are RANGES at most;
    a range is sorted by the engine, which spills, and read as a stream.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.select(F.coalesce("doc_id", F.lit(int(_LAST))).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")
    n, size, first_of_all = plain.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min(F.struct("id", "h"))).first()
    least = np.array([tuple(first_of_all)] if n else [], _PLACE)
    limits = range_limits(plain, least, n, min(RANGES, chunk_count(size, bucket_bytes)))
    beginnings = np.concatenate([limits, least])

    def deal(batches):
        for batch in batches:
            at = _places(*(batch.column(i).to_numpy() for i in range(2)))
            own = np.searchsorted(limits, at, "right")
            _, head = np.unique(at, return_index=True)  # equal places: their texts are equal, but for a collision of 64 bits
            tail = head[np.isin(at[head], beginnings)]  # the first of its range goes to the range before it, too
            before = np.where(own[tail] > 0, own[tail] - 1, len(limits))
            index = np.concatenate([np.arange(len(at)), tail])
            bucket = np.concatenate([own, before])
            for i in range(0, len(index), 2000):
                part = batch.take(pa.array(index[i : i + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + 2000]), pa.array(np.arange(i, i + len(part)) >= len(at)), *part.columns], names=["bucket", "follows", "id", "h", "doc_id", "text"])

    schema = _RESULT + (", gone array<long>, come array<long>" if with_digests else "")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def block(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
        m, at = len(texts), np.arange(len(texts))
        edited = [edited_text(t, f) for t, f in zip(texts, [*texts[1:], after], strict=True)]
        keys, first = paragraphs(*utf8_view(pa.array([*texts, after, *edited], pa.large_string())))
        many, cells = np.diff(first), sketches(keys, first)
        prints = encoded(many, cells)
        pair, key, sign = differences(keys, first, cells, np.concatenate([at, at]), np.concatenate([at + m + 1, at + 1]))
        near = likeness(many, np.concatenate([at, at]), np.concatenate([at + m + 1, at + 1]), pair, sign)
        cut = np.searchsorted(pair, np.arange(m + 1))
        sides = [[key[x:y][sign[x:y] == s].view(np.int64) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] for s in (1, -1)]
        columns = [ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], prints[:m], prints[m + 1 :], near[:m], near[m:], *([len(x) for x in side] for side in sides)]
        if with_digests:
            columns += [[np.sort(x) for x in side] for side in sides]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[c.rsplit(" ", 1)[0] for c in schema.split(", ")])

    def fingerprint(batches):
        ids, texts, total, done = [], [], 0, None
        for part in (batch.slice(a, b - a) for batch in batches for a, b in slices(batch.column(5))):
            for bucket, follows, doc, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
                if follows and bucket == done:
                    continue  # the first of the next range, once more
                if texts and (follows or total > 1 << 20):
                    yield block(ids, texts, text)
                    ids, texts, total = [], [], 0
                if follows:
                    done = bucket
                else:
                    ids.append(doc)
                    texts.append(text)
                    total += len(text)

    dealt = plain.mapInArrow(deal, "bucket long, follows boolean, id long, h long, doc_id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "follows", "id", "h", "text").mapInArrow(fingerprint, schema)
