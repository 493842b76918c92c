"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest across documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import BLOCK, U64, blobs_of, checkpointed, chunk_count, dealt_texts, mix, parted, prefix_sums, range_hashes, text_bytes, utf8_view, whole_column

#: A gear value for each byte; what they are matters only in that they are fixed and look random.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
#: h = 2h + gear[byte]. Bits 11 to 15 of h depend on the last 16 bytes alone; all five are zero at one place in 32.
MASK = np.uint32(0xF800)
WINDOW = 16
#: Bytes compared beyond each end of a run. Chunks of a shared passage fall in step far sooner.
REACH = 512
#: Bytes of text handled as one group, bytes of chunk digests that meet in one, and parts whose chunks meet at once.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
FAN = 1000

_CHUNKS, _FOUND, _RUNS, _ASKED, _SAID = range(5)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash allows a cut, by doubling the window of a block of bytes at once."""
    found = [np.zeros(0, np.int64)]
    for begin in range(0, len(data), BLOCK):
        early = max(0, begin - WINDOW + 1)
        h = GEAR[data[early : begin + BLOCK]]
        for k in (1, 2, 4, 8):
            if len(h) > k:
                h[k:] += h[:-k] << np.uint32(k)
        found.append(np.flatnonzero((h[begin - early :] & MASK) == 0) + begin + 1)
    return np.concatenate(found)


def chunk_ends(data: np.ndarray, offsets: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of each row: cut at the first allowed place after `least` bytes, or after `most`."""
    allowed = cut_points(data)
    spots = allowed.tolist()
    first = np.searchsorted(allowed, offsets, "right").tolist()
    ends: list[int] = []
    starts: list[int] = []
    for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = begin
        for c in spots[first[i] : first[i + 1]]:
            if c - at < least:
                continue
            while c - at > most:
                starts.append(at)
                at += most
                ends.append(at)
            if c - at >= least and c < end:
                starts.append(at)
                ends.append(c)
                at = c
        while at < end:
            starts.append(at)
            at = min(at + most, end)
            ends.append(at)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each range, as two longs. Ranges come in the order of the data."""
    out = np.empty((len(starts), 2), np.int64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        part, s, e = data[base : ends[b - 1]], starts[a:b] - base, ends[a:b] - base
        out[a:b, 0] = range_hashes(prefix_sums(part), s, e).view(np.int64)
        out[a:b, 1] = range_hashes(prefix_sums(GEAR[part ^ np.uint8(0x5A)]), s, e).view(np.int64)
        a = b
    return out


class _Part:
    """The documents dealt to one part, in the order of doc_id and text; a place is a row's number times 2^32, plus a byte."""

    def __init__(self, table: pa.Table) -> None:
        self.docs = table.sort_by([("id", "ascending"), ("digest", "ascending")]).combine_chunks()
        self.ids = self.docs["id"].to_numpy()
        self.data, self.offsets = utf8_view(whole_column(self.docs["text"]))

    def chunks(self, least: int, most: int) -> tuple[np.ndarray, ...]:
        """Digest, doc_id, place and size of the chunks of all documents that have a doc_id."""
        starts, ends = chunk_ends(self.data, self.offsets, least, most)
        row = np.searchsorted(self.offsets, starts, "right") - 1
        digest = digests(self.data, starts, ends)
        own = np.flatnonzero(np.asarray(self.docs["doc_id"].is_valid())[row]) if len(row) else row
        start = starts - self.offsets[row]
        return digest[own], self.ids[row[own]], (row[own] << 32) + start[own], (ends - starts)[own]

    def around(self, place: int, before: int, after: int) -> bytes:
        """Bytes of a document before or after one of its places."""
        row, at = place >> 32, place & 0xFFFFFFFF
        begin, end = int(self.offsets[row]), int(self.offsets[row + 1])
        return self.data[max(begin, begin + at - before) : min(end, begin + at + after)].tobytes()


def earliest(digest: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by digest, then by `more`; the place of each digest's first in that order, and where the last of them ends."""
    order = np.lexsort((*more[::-1], digest[:, 1], digest[:, 0]))
    d = digest[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]).any(axis=1)]))
    return order, at, np.append(at, len(d))[1:]


_TOLD = "bucket long, salt long, chunk long, kind int, data binary"
_NOTE = "chunk long, kind int, source long, data binary, said binary"


def _told(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "salt", "chunk", "kind", "data"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)})


def _noted(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("chunk", "kind", "source", "data", "said"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)})


def _longs(table: pa.Table, kind: int, width: int) -> np.ndarray:
    """The longs of all notes of a kind, by rows of so many; each row's source in front of them."""
    parts = [np.zeros((0, width + 1), np.int64)]
    for k, source, data in zip(table["kind"].to_pylist(), table["source"].to_pylist(), table["data"].to_pylist(), strict=True):
        if k == kind:
            own = np.frombuffer(data, np.int64).reshape(-1, width)
            parts.append(np.concatenate([np.full((len(own), 1), source), own], axis=1))
    return np.concatenate(parts)


def _agree(a: bytes, b: bytes) -> int:
    """How many bytes two texts have in common from their beginning."""
    n = min(len(a), len(b))
    other = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(other[0]) if len(other) else n


def remove_repeats(docs: DataFrame, least: int = 16, most: int = 128, shortest: int = 96, carry: tuple[str, ...] = (), reach: int = 0, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """Removes runs of at least `shortest` bytes made of chunks that a document of a smaller doc_id holds too.

    Returns a row for each of docs (doc_id, text): doc_id, kept_text, n_bytes, n_removed, n_spans, n_chunks, kept_sha256. Cuts
    depend on the last 16 bytes, so chunks fall in step again after an insertion; what a passage loses at its two ends is
    part of a chunk. With `reach`, runs are first extended byte by byte to both sides, up to so many bytes, as far as the
    earliest document that holds their outer chunk (the least doc_id, then the place) says the same. Runs stay on character
    boundaries. A document is what its doc_id and text are: texts of one doc_id never remove each other's bytes. Null is
    empty; a null doc_id is kept as it is and makes nothing else a repeat; repeated rows stay; empty tables give empty
    results; other columns are ignored, but for those to `carry` into the result.

    Documents are dealt to parts of `chunk_bytes`. A part tells each of its distinct chunks once; where there are more than
    `fan` parts, what they tell meets in groups of so many first, and each group's earliest holders meet. The earliest of all
    then goes back down to the groups and their parts, so that the result does not depend on how documents are dealt.
    """
    _, size = text_bytes(docs)
    parts = chunk_count(size, chunk_bytes)
    salts = -(-parts // fan)
    buckets = chunk_count(size * 2 // 3, BUCKET_BYTES)
    dealt = dealt_texts(docs, parts, carry)

    def tell(left: pa.Table) -> pa.Table:
        part = left["chunk"][0].as_py()
        digest, ids, place, _ = _Part(left).chunks(least, most)
        order, at, _ = earliest(digest, ids, place)
        own = order[at]
        data = np.concatenate([digest[own], np.stack([ids[own], place[own]], axis=1)], axis=1)
        order, at, end = parted((digest[own, 0].view(U64) % U64(buckets)).astype(np.int64))
        data = data[order]
        return _told([(int(np.uint64(data[a, 0].view(U64)) % U64(buckets)), part % salts, part, _CHUNKS, data[a:b].tobytes()) for a, b in zip(at.tolist(), end.tolist(), strict=True)])

    def meet(table: pa.Table) -> pa.Table:
        """Of the chunks that all parts tell: to all but the earliest, where the earliest is."""
        longs, many = blobs_of(table["data"])
        data, part = longs.reshape(-1, 4), np.repeat(table["chunk"].to_numpy(), many // 4)
        order, at, end = earliest(data[:, :2], data[:, 2], part)
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[at], end - at)
        own = np.flatnonzero(data[:, 2] > data[first, 2])
        found = np.concatenate([data[:, :2], part[first][:, None], data[first, 3:]], axis=1)[own]
        order, at, end = parted(part[own])
        return _told([(table["bucket"][0].as_py(), 0, int(part[own[order[a]]]), _FOUND, found[order[a:b]].tobytes()) for a, b in zip(at.tolist(), end.tolist(), strict=True)])

    def lead(table: pa.Table) -> pa.Table:
        """The earliest holder of each chunk within a group of parts: digest, doc_id, place, part."""
        longs, many = blobs_of(table["data"])
        data = np.concatenate([longs.reshape(-1, 4), np.repeat(table["chunk"].to_numpy(), many // 4)[:, None]], axis=1)
        order, at, _ = earliest(data[:, :2], data[:, 2], data[:, 4])
        return _told([(table["bucket"][0].as_py(), table["salt"][0].as_py(), 0, _CHUNKS, data[order[at]].tobytes())])

    def settle(table: pa.Table) -> pa.Table:
        """The earliest holder of all, told to each group that has the chunk."""
        longs, many = blobs_of(table["data"])
        data, group = longs.reshape(-1, 5), np.repeat(table["salt"].to_numpy(), many // 5)
        order, at, end = earliest(data[:, :2], data[:, 2], data[:, 4])
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[at], end - at)
        order, at, end = parted(group)
        return _told([(table["bucket"][0].as_py(), int(group[order[a]]), 0, _FOUND, data[first[order[a:b]]].tobytes()) for a, b in zip(at.tolist(), end.tolist(), strict=True)])

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        """To each part of a group, where the earliest holders of all are of those chunks that it holds later."""
        longs, many = blobs_of(left["data"])
        data, part = longs.reshape(-1, 4), np.repeat(left["chunk"].to_numpy(), many // 4)
        first = blobs_of(right["data"])[0].reshape(-1, 5)
        order, at, end = earliest(np.concatenate([first[:, :2], data[:, :2]]), np.concatenate([np.zeros(len(first), np.int64), np.ones(len(data), np.int64)]))
        holder = np.empty(len(order), np.int64)
        holder[order] = np.repeat(order[at], end - at)
        known = first[holder[len(first) :]]
        own = np.flatnonzero(data[:, 2] > known[:, 2])
        found = np.concatenate([data[:, :2], known[:, 4:], known[:, 3:4]], axis=1)[own]
        order, at, end = parted(part[own])
        return _told([(left["bucket"][0].as_py(), 0, int(part[own[order[a]]]), _FOUND, found[order[a:b]].tobytes()) for a, b in zip(at.tolist(), end.tolist(), strict=True)])

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """The runs of a part, as notes to itself, and what stands around them, as questions to the parts of earlier holders."""
        if not left.num_rows:
            return _noted([])
        part = left["chunk"][0].as_py()
        digest, ids, place, size = _Part(left).chunks(least, most)
        found = _longs(right, _FOUND, 4)[:, 1:]
        order, at, end = earliest(np.concatenate([found[:, :2], digest]), np.concatenate([np.full(len(found), -1), np.zeros(len(ids), np.int64)]), np.concatenate([found[:, 3], ids]), np.concatenate([found[:, 3], place]))
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[at], end - at)
        first = first[len(found) :]
        outside = first < len(found)  # told by its bucket, else the earliest of the part itself
        inner = np.where(outside, 0, first - len(found))
        again = np.flatnonzero(outside | (ids[inner] < ids)) if len(ids) else np.zeros(0, np.int64)
        holder = np.where(outside, found[np.where(outside, first, 0), 2], part) if len(found) else np.full(len(ids), part)
        there = np.where(outside, found[np.where(outside, first, 0), 3], place[inner]) if len(found) else place[inner]
        if not len(again):
            return _noted([])
        stop = place + size
        head = np.flatnonzero(np.concatenate([[True], place[again[1:]] != stop[again[:-1]]]))
        tail = np.append(head[1:], len(again)) - 1
        a, b = again[head], again[tail]
        far = there[b] + size[b]
        runs = np.stack([place[a], stop[b] - place[a], tail - head + 1, holder[a], there[a], holder[b], far], axis=1)
        out = [(part, _RUNS, part, runs.tobytes(), None)]
        if reach:
            asked = np.unique(np.concatenate([np.stack([holder[a], there[a], np.zeros(len(a), np.int64)], axis=1), np.stack([holder[b], far, np.ones(len(b), np.int64)], axis=1)]), axis=0)
            order, at, end = parted(asked[:, 0])
            out += [(int(asked[a, 0]), _ASKED, part, asked[a:b, 1:].tobytes(), None) for a, b in zip(at.tolist(), end.tolist(), strict=True)]
        return _noted(out)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right["kind"].to_numpy() if right.num_rows else np.zeros(0, np.int32)
        out = [tuple(r.values()) for r in right.filter(pa.array(kind == _RUNS)).select(["chunk", "kind", "source", "data", "said"]).to_pylist()]
        if (kind == _ASKED).any():
            own = _Part(left)
            for r in right.filter(pa.array(kind == _ASKED)).to_pylist():
                said = [own.around(place, 0, reach) if after else own.around(place, reach, 0) for place, after in np.frombuffer(r["data"], np.int64).reshape(-1, 2).tolist()]
                keys = np.concatenate([np.frombuffer(r["data"], np.int64).reshape(-1, 2), np.array([[len(x)] for x in said], np.int64)], axis=1)
                out.append((r["source"], _SAID, r["chunk"], keys.tobytes(), b"".join(said)))
        return _noted(out)

    names = ["doc_id", "kept_text", "n_bytes", "n_removed", "n_spans", "n_chunks", "kept_sha256"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    # Types as they are, the nulls within them too.
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, kept_text string, n_bytes long, n_removed long, n_spans long, n_chunks long, kept_sha256 string"), *(docs.schema[c] for c in carry)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)} | {c: left[c] for c in carry})
        own = _Part(left)
        runs = _longs(right, _RUNS, 7)[:, 1:]
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        said: dict[tuple[int, int, int], bytes] = {}
        for r in right.to_pylist():
            at = 0
            for place, after, n in np.frombuffer(r["data"], np.int64).reshape(-1, 3).tolist() if r["kind"] == _SAID else ():
                said[r["source"], place, after] = r["said"][at : at + n]
                at += n
        first = np.searchsorted(runs[:, 0], np.arange(len(own.ids) + 1) << 32).tolist()
        out = []
        for i, doc in enumerate(own.docs["doc_id"].to_pylist()):
            raw = own.data[own.offsets[i] : own.offsets[i + 1]].tobytes()
            spans = []
            for place, length, _, holder, there, holder_, there_ in runs[first[i] : first[i + 1]].tolist():
                begin, end = place & 0xFFFFFFFF, (place & 0xFFFFFFFF) + length
                before, after = said.get((holder, there, 0), b""), said.get((holder_, there_, 1), b"")
                more = _agree(raw[max(0, begin - len(before)) : begin][::-1], before[::-1])
                spans.append((begin - more, length + more + _agree(raw[end : end + len(after)], after)))
            gone = _runs(raw, sorted(spans), shortest)
            kept = b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)], strict=True))
            out.append((doc, kept.decode(), len(raw), sum(e - s for s, e in gone), len(gone), int(runs[first[i] : first[i + 1], 2].sum()), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)} | {c: own.docs[c] for c in carry})

    def together(notes: DataFrame):
        return dealt.groupBy("chunk").cogroup(notes.groupBy("chunk"))

    told = dealt.groupBy("chunk").applyInArrow(tell, _TOLD)
    if salts > 1:
        told = checkpointed(told)
        first = told.groupBy("bucket", "salt").applyInArrow(lead, _TOLD).groupBy("bucket").applyInArrow(settle, _TOLD)
        met = told.groupBy("bucket", "salt").cogroup(first.groupBy("bucket", "salt")).applyInArrow(down, _TOLD)
    else:
        met = told.groupBy("bucket").applyInArrow(meet, _TOLD)
    found = met.select(F.col("chunk").alias("chunk"), "kind", F.lit(0).cast("long").alias("source"), "data", F.lit(None).cast("binary").alias("said"))
    asked = together(found).applyInArrow(ask, _NOTE)
    return together(together(asked).applyInArrow(answer, _NOTE)).applyInArrow(cut, schema)


def _runs(raw: bytes, spans: list[tuple[int, int]], shortest: int) -> list[tuple[int, int]]:
    """Maximal runs of adjoining chunks, cut back to whole characters, if they are long enough."""
    runs: list[list[int]] = []
    for start, size in spans:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + size)
        else:
            runs.append([start, start + size])
    out = []
    for start, end in runs:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end - start >= shortest:
            out.append((start, end))
    return out
