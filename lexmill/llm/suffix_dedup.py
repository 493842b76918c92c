"""Removal of long byte strings that an earlier document holds, with a logarithmic family of suffix arrays.

Every window of `width` bytes belongs to one anchor: its substring of ANCHOR bytes with the least hash, the leftmost of
equals. Equal windows have equal anchors at equal places, so only windows around anchors that occur in two texts can repeat.
Their bytes go to the bucket of the anchor. There, batches in document order get suffix arrays, are merge-scanned against
the levels of all earlier batches, and join the levels, which merge whenever two have the same size class. Levels does so with
batches that come one after the other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import BLOCK, U64, chunk_count, dealt_texts, merged, mix, parted, pick, prefix_sums, range_hashes, same_bytes, text_bytes, utf8_view, whole_column, window_hashes
from lexmill.schema import complete, remove, versions

ANCHOR = 20
#: Bytes of text handled as one group, and anchors to a bucket.
CHUNK_BYTES = 2 << 20
BUCKET_ANCHORS = 200_000
#: Windows of an anchor that so many chunks share are dealt one by one, not by their anchor. A chunk counts once more for every
#: OFTEN runs of windows that it has of the anchor, so that fewer than 100 000 runs of one anchor come together.
HOT_CHUNKS, OFTEN = 25_000, 4
#: Windows in one batch of the level family.
BATCH = 1 << 16

_COPY, _SHARED, _HOT, _SPANS = 0, 1, 2, 3
_LAST = np.iinfo(np.int64).max  # no earlier document


class SuffixLevels:
    """Sorted arrays of suffixes (their first `width` bytes) with the least document that has each, in geometric sizes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, suffixes: np.ndarray) -> np.ndarray:
        """The least earlier document of each of these sorted suffixes; the greatest number where there is none."""
        least = np.full(len(suffixes), _LAST)
        for held, docs in self.levels:
            at = np.searchsorted(held, suffixes)
            at[at == len(held)] = 0
            least = np.where(held[at] == suffixes, np.minimum(least, docs[at]), least)
        return least

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes a batch whose documents are not before those held. Returns which suffixes an earlier document has."""
        order = _by_suffix(suffixes, docs)
        s, d = suffixes[order], docs[order]
        head = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        unique, first = s[head], d[head]
        least = np.minimum(self.scan(unique), first)
        found = np.empty(len(s), bool)
        found[order] = least[group] < d
        fresh = least == first
        self._push(unique[fresh], first[fresh])
        return found

    def _push(self, suffixes: np.ndarray, docs: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]).bit_length() <= len(suffixes).bit_length():
            s, d = self.levels.pop()
            s, d = np.concatenate([s, suffixes]), np.concatenate([d, docs])  # earlier documents first
            order = np.argsort(s, kind="stable")
            s, d = s[order], d[order]
            head = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            suffixes, docs = s[head], d[head]
        if len(suffixes):
            self.levels.append((suffixes, docs))


def _by_suffix(suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Order by suffix, then document; documents come in ascending order."""
    by_doc = np.argsort(docs, kind="stable")
    return by_doc[np.argsort(suffixes[by_doc], kind="stable")]


def gather(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Byte strings of one width at these places."""
    if not len(starts):
        return np.zeros(0, f"S{width}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[starts]).view(f"S{width}").ravel()


def window_anchors(data: np.ndarray, offsets: np.ndarray, width: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window, windows, anchor's place; and the hash of each run's anchor.

    limits: where each row ends, which may be beyond the data.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, np.zeros(0, U64)
    h = window_hashes(prefix_sums(data), ANCHOR)
    least = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)  # equal hashes: the leftmost
    span, have = width - ANCHOR + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = (least & U64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    ok = np.arange(len(at)) + width <= limits[row]
    starts = np.flatnonzero(ok)
    at, row = at[starts], row[starts]
    if not len(starts):
        return none, none, none, none, np.zeros(0, U64)
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    return row[head], starts[head], np.diff(np.append(head, len(starts))), at[head], h[at[head]]


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _named(blob: bytes) -> np.ndarray:
    """The names of a blob's anchors, of one bucket, which it begins with."""
    return np.frombuffer(blob, np.int64, 1) << 32 | np.frombuffer(blob, np.uint32, offset=8).astype(np.int64)


class _Chunk:
    """The documents of a chunk, in the order of doc_id and text, without copies; windows are numbered in all their bytes."""

    def __init__(self, docs: pa.Table, notes: pa.Table) -> None:
        self.docs = docs.sort_by([("id", "ascending"), ("digest", "ascending")]).combine_chunks()
        kinds = notes["kind"].to_numpy() if notes.num_rows else np.zeros(0, np.int32)
        blobs = notes["data"].to_pylist()
        first = {blobs[i][:32]: int.from_bytes(blobs[i][32:], "big", signed=True) for i in np.flatnonzero(kinds == _COPY)}
        ids = self.docs["id"].to_numpy()
        self.copies = np.fromiter((first.get(d, n) < n for d, n in zip(self.docs["digest"].to_pylist(), ids.tolist(), strict=True)), bool, len(ids)) if first else np.zeros(len(ids), bool)
        self.ids = ids[~self.copies]
        self.text = whole_column(self.docs["text"].filter(pa.array(~self.copies)))
        self.data, self.offsets = utf8_view(self.text)
        self.noted = {k: np.concatenate([np.zeros(0, np.int64), *(read(blobs[i]) for i in np.flatnonzero(kinds == k))]) for k, read in ((_SHARED, _named), (_HOT, _named), (_SPANS, _longs))}

    def runs(self, width: int) -> tuple[np.ndarray, ...]:
        """Row, first window, windows and anchor's hash of the runs of windows with one anchor; a block of bytes at a time."""
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)]
        for begin in range(0, len(self.data) - width + 1, BLOCK):
            end = min(begin + BLOCK + width - 1, len(self.data))
            a = int(np.searchsorted(self.offsets, begin, "right")) - 1
            b = int(np.searchsorted(self.offsets, end, "left"))
            row, start, many, _, h = window_anchors(self.data[begin:end], np.clip(self.offsets[a : b + 1] - begin, 0, end - begin), width, self.offsets[a + 1 : b + 1] - begin)
            found.append((row + a, start + begin, many, h))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def distinct_anchors(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors, sorted; those that two texts hold. Rows come in ascending order."""
    order = np.argsort(h.view(np.int64), kind="stable")
    h, row = h[order].view(np.int64), row[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(h)) - 1 if len(h) else head
    return h[head], h[head][row[tail] != row[head]]


def counted_anchors(h: np.ndarray) -> np.ndarray:
    """Hashes of all anchors, sorted, each once and once more for every OFTEN runs."""
    found, many = np.unique(h.view(np.int64), return_counts=True)
    return np.repeat(found, 1 + many // OFTEN)


_NOTE = "chunk long, kind int, data binary"
_WINDOWS = "bucket long, chunk long, ids binary, lengths binary, data binary"


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % U64(buckets)).astype(np.int64)


def _names(h: np.ndarray, buckets: int) -> np.ndarray:
    """What an anchor is called by: its bucket and the lower half of its hash. Anchors of one name are held for the same one."""
    return _bucket(h, buckets) << 32 | (h & U64(0xFFFFFFFF)).astype(np.int64)


def _notes(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table({"chunk": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "data": pa.array(cols[2], pa.binary())})


class _Windows:
    """Segments of windows, many in a row: id, row and start of each, its number of windows, its bytes one after the other."""

    def __init__(self, chunk: np.ndarray, ids: np.ndarray, many: np.ndarray, data: np.ndarray, width: int) -> None:
        self.chunk, self.ids, self.many, self.data, self.width = chunk, ids, many, data, width
        self.size = many + width - 1
        self.at = np.cumsum(self.size) - self.size

    @staticmethod
    def read(table: pa.Table, width: int) -> tuple[_Windows, list[tuple]]:
        """The segments of a group, and the spans among its rows as notes."""
        rows, parts = [], []
        for c, ids, lengths, data in zip(*(table[n].to_pylist() for n in ("chunk", "ids", "lengths", "data")), strict=True):
            if lengths:
                parts.append((c, np.frombuffer(ids, np.int64).reshape(-1, 3), np.frombuffer(lengths, np.int32).astype(np.int64), np.frombuffer(data, np.uint8)))
            else:
                rows.append((c, _SPANS, data))
        chunk = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p[2]), p[0]) for p in parts)])
        empty = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return _Windows(chunk, *(np.concatenate([e, *(p[i + 1] for p in parts)]) for i, e in enumerate(empty)), width), rows

    def scan(self) -> np.ndarray:
        """Chunk, row, start and end of all spans that an earlier document has, by batches against the levels."""
        width = self.width
        order = np.lexsort((self.ids[:, 2], self.ids[:, 1], self.chunk, self.ids[:, 0]))
        levels = SuffixLevels(width)
        found: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        total = np.cumsum(self.many[order])
        begin = 0
        while begin < len(order):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BATCH, "right")))
            own = order[begin:end]
            n = self.many[own]
            turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            segment = np.repeat(own, n)
            hit = levels.add(gather(self.data, self.at[segment] + turn, width), self.ids[segment, 0])
            segment, turn = segment[hit], turn[hit]
            if len(segment):
                head = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (turn[1:] != turn[:-1] + 1)]))
                tail = np.append(head[1:], len(segment)) - 1
                s = segment[head]
                found.append(np.stack([self.chunk[s], self.ids[s, 1], self.ids[s, 2] + turn[head], self.ids[s, 2] + turn[tail] + width], axis=1))
            begin = end
        return np.concatenate(found)


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "chunk", "ids", "lengths", "data"), cols, (pa.int64(),) * 2 + (pa.binary(),) * 3, strict=True)})


def _by_chunk(spans: np.ndarray) -> list[tuple]:
    order, at, end = parted(spans[:, 0])
    spans = spans[order]
    return [(int(spans[a, 0]), _SPANS, spans[a:b, 1:].tobytes()) for a, b in zip(at.tolist(), end.tolist(), strict=True)]


class Levels:
    """A stored family of levels that takes batches of documents: each holds its texts and their anchors, and levels of one size
    class merge. A new batch is scanned against all of them; only texts that share an anchor with it are read again.

    folder: where levels lie, as Parquet; a batch counts once it is whole, and a batch that failed can be added again.
    """

    def __init__(self, spark: SparkSession, folder: str, width: int = 50) -> None:
        self.spark, self.folder, self.width = spark, folder, width

    def held(self) -> list[tuple[str, int, int]]:
        """Name, bytes and chunks of each level, the largest first."""
        kept = versions(self.spark, f"{self.folder}/state")
        rows = self.spark.read.parquet(f"{self.folder}/state/version={kept[-1]}/levels").collect() if kept else []  # a row a level
        return sorted(((r["name"], r["bytes"], r["chunks"]) for r in rows), key=lambda r: (-r[1], r[0]))

    def _read(self, name: str, what: str, base: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{what}").withColumn("chunk", F.col("chunk") + F.lit(base))

    def _all(self, held: list[tuple[str, int, int]]) -> tuple[DataFrame, DataFrame, int] | None:
        """Documents and anchors of levels, and how many chunks they have."""
        base, docs, anchors = 0, None, None
        for name, _, chunks in held:
            d, a = self._read(name, "documents", base), self._read(name, "anchors", base)
            docs, anchors = (d, a) if docs is None else (docs.unionByName(d), anchors.unionByName(a))
            base += chunks
        return (docs, anchors, base) if held else None

    def add(self, docs: DataFrame, **how) -> DataFrame:
        """What remove_repeats gives for a batch, with the documents of all batches before as documents, too; these get no row.
        The result is written, and the batch becomes a level."""
        held = self.held()
        size = text_bytes(docs)[1]
        chunks = chunk_count(size, how.get("chunk_bytes", CHUNK_BYTES))
        name, dealt = uuid.uuid4().hex, dealt_texts(docs, chunks)
        result, anchors = _remove(dealt, size, chunks, self._all(held), sum(b for _, b, _ in held), self.width, **how)
        result.write.parquet(f"{self.folder}/{name}/result")
        dealt.write.parquet(f"{self.folder}/{name}/documents")
        anchors.withColumn("chunk", F.col("chunk") - sum(c for *_, c in held)).select("chunk", "data").write.parquet(f"{self.folder}/{name}/anchors")
        held.append((name, size, chunks))
        old = []
        while len(held) > 1 and held[-2][1].bit_length() <= held[-1][1].bit_length():
            pair = held[-2:]
            merged_ = uuid.uuid4().hex
            d, a, n = self._all(pair)
            d.write.parquet(f"{self.folder}/{merged_}/documents")
            a.write.parquet(f"{self.folder}/{merged_}/anchors")
            old += [p[0] for p in pair]
            held[-2:] = [(merged_, sum(p[1] for p in pair), n)]
        kept = versions(self.spark, f"{self.folder}/state")
        state = f"{self.folder}/state/version={kept[-1] + 1 if kept else 0}"
        self.spark.createDataFrame(held, "name string, bytes long, chunks long").write.mode("overwrite").parquet(f"{state}/levels")
        complete(self.spark, state)
        for n in old:
            remove(self.spark, f"{self.folder}/{n}/documents")
            remove(self.spark, f"{self.folder}/{n}/anchors")
        return self.spark.read.parquet(f"{self.folder}/{name}/result")


def remove_repeats(docs: DataFrame, width: int = 50, **how) -> DataFrame:
    """Removes every byte that a `width`-byte string covers which also starts in a document of a smaller doc_id.

    Returns a row for each of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and
    with `with_text` also spans (start and end of each, as array<struct>). Texts are judged as UTF-8 bytes of the input, null
    as empty; other columns are ignored. A document is what its doc_id and text are: texts of one doc_id, and all texts
    without one, never remove each other's bytes; a null doc_id comes after all others. An empty table gives an empty
    result. No candidate is dropped: all windows of shared anchors are compared, byte by byte.

    Whole copies, and segments that repeat within a chunk, do not travel. An anchor that counts for `hot_chunks` chunks or more
    has its windows dealt one by one; of one window a chunk sends one. Texts are dealt once and windows once, and nothing is
    written between. Documents that come by batches are for Levels.
    """
    _, size = text_bytes(docs)
    chunks = chunk_count(size, how.get("chunk_bytes", CHUNK_BYTES))
    return _remove(dealt_texts(docs, chunks), size, chunks, None, 0, width, **how)[0]


def _remove(dealt: DataFrame, size: int, chunks: int, earlier: tuple[DataFrame, DataFrame, int] | None, before: int, width: int, hot_chunks: int = HOT_CHUNKS, chunk_bytes: int = CHUNK_BYTES, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The result for documents dealt, and their anchors; earlier: documents, anchors and number of the chunks of levels."""
    base = earlier[2] if earlier else 0
    buckets = chunk_count((size + before) * 2, BUCKET_ANCHORS * (width - ANCHOR + 2))
    if earlier:
        dealt = dealt.withColumn("chunk", F.col("chunk") + F.lit(base))
    every = dealt.unionByName(earlier[0].select(dealt.columns)) if earlier else dealt

    # Copies by their digest; a chunk tells each of its digests once.
    told = every.where(F.octet_length("text") >= width).groupBy("chunk", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = told.groupBy("digest").agg(F.min("first").alias("least"), F.max("last").alias("most")).where("least < most").drop("most")
    packed = F.concat("digest", F.unhex(F.lpad(F.hex("least"), 16, "0")))
    copies = told.join(firsts, "digest").where("last > least").select(F.col("chunk").alias("chunk"), F.lit(_COPY).alias("kind"), packed.alias("data"))

    def tell_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        return pa.table(bucketed(left["chunk"][0].as_py(), counted_anchors(_Chunk(left, right).runs(width)[3])))

    def keep_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        """Whole hashes, which later batches deal to buckets of their own."""
        rows = [(left["chunk"][0].as_py(), counted_anchors(_Chunk(left, right).runs(width)[3]).tobytes())] if left.num_rows else []
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})

    def bucketed(chunk: int, hashes: np.ndarray) -> dict[str, pa.Array]:
        to = _bucket(hashes.view(U64), buckets)
        order, at, end = parted(to)
        halves = hashes.view(U64)[order].astype(np.uint32)
        blobs = [halves[a:b].tobytes() for a, b in zip(at.tolist(), end.tolist(), strict=True)]
        return {"bucket": pa.array(to[order][at]), "chunk": pa.array(np.full(len(at), chunk, np.int64)), "data": pa.array(blobs, pa.binary())}

    def deal_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict(bucketed(chunk, np.frombuffer(data, np.int64)))

    def shared_anchors(table: pa.Table) -> pa.Table:
        data, offsets = utf8_view(whole_column(table["data"]))
        h = np.frombuffer(data.tobytes(), np.uint32)
        chunk = np.repeat(table["chunk"].to_numpy(), np.diff(offsets) // 4)
        bucket = table["bucket"][:1].to_numpy().tobytes()
        order, at, end = parted(h)
        many = end - at
        times, apart, first = np.empty(len(h), np.int64), np.empty(len(h), bool), np.ones(len(h), bool)
        times[order] = np.repeat(many, many)
        # A chunk's anchors of a bucket come together, so that of equal ones those of a chunk do.
        apart[order] = np.repeat(chunk[order][at] != chunk[order][end - 1], many)
        first[order[1:]] = (h[order][1:] != h[order][:-1]) | (chunk[order][1:] != chunk[order][:-1])
        if base:  # an anchor that no judged chunk has is of no use
            here = np.zeros(len(h), bool)
            here[order] = np.repeat(np.logical_or.reduceat(chunk[order] >= base, at), many) if len(h) else here
            first[~here] = False
        rows = []
        for kind, take in ((_SHARED, apart & (times < hot_chunks)), (_HOT, times >= max(2, hot_chunks))):
            own, of = h[take & first], chunk[take & first]
            order, at, end = parted(of)
            own, of = own[order], of[order]
            rows += [(int(of[a]), kind, bucket + own[a:b].tobytes()) for a, b in zip(at.tolist(), end.tolist(), strict=True)]
        return _notes(rows)

    def tell_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        whole = _Chunk(left, right)
        number = left["chunk"][0].as_py()
        row, start, many, h = whole.runs(width)
        local = distinct_anchors(row, h)[1] if number >= base else np.zeros(0, np.int64)
        name, hot = _names(h, buckets), whole.noted[_HOT]
        take = np.flatnonzero(np.isin(h.view(np.int64), local) | np.isin(name, np.concatenate([whole.noted[_SHARED], hot])))
        row, start, many, h, name = row[take], start[take], many[take], h[take], name[take]
        if not len(row):
            return _table([])
        lone = np.isin(name, hot)
        sums = prefix_sums(whole.data)
        if lone.any():  # in the order of rows and starts, as before
            each = np.repeat(np.arange(len(row)), np.where(lone, many, 1))
            turn = np.arange(len(each)) - np.searchsorted(each, each)
            row, start, lone, h = row[each], start[each] + turn, lone[each], h[each]
            many = np.where(lone, 1, many[each])
            h[lone] = range_hashes(sums, start[lone], start[lone] + width)
        ids = whole.ids[row]
        size = many + width - 1
        # Of segments that repeat within the chunk, those of later documents are told at once.
        order, at, end = parted(range_hashes(sums, start, start + size))
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[at], end - at)
        again = np.flatnonzero((ids[first] < ids) & (size[first] == size))
        again = again[same_bytes(whole.data, start[again], start[first[again]], size[again])]
        local_start = start - whole.offsets[row]
        out = []
        if len(again):
            out.append((number % buckets, number, b"", b"", np.stack([row[again], local_start[again], local_start[again] + size[again]], axis=1).tobytes()))
        keep = np.ones(len(row), bool)
        keep[again] = False
        keep = np.flatnonzero(keep)
        to = _bucket(h[keep], buckets)
        order, at, end = parted(to)
        keep, to = keep[order], to[order]
        told_ = np.stack([ids[keep], row[keep], local_start[keep]], axis=1)
        n = size[keep]
        stop = np.append(0, np.cumsum(n))
        data = pick(whole.data, start[keep], n)
        lengths = many[keep].astype(np.int32)
        out += [(int(to[a]), number, told_[a:b].tobytes(), lengths[a:b].tobytes(), data[stop[a] : stop[b]].tobytes()) for a, b in zip(at.tolist(), end.tolist(), strict=True)]
        return _table(out)

    def scan_windows(table: pa.Table) -> pa.Table:
        own, rows = _Windows.read(table, width)
        return _notes(rows + _by_chunk(own.scan()))

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans"] if with_text else [])]
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,end:long>>" * with_text
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            whole = _Chunk(left, right)
            spans = whole.noted[_SPANS].reshape(-1, 3)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            first = np.searchsorted(spans[:, 0], np.arange(len(whole.ids) + 1))
            turn = np.cumsum(~whole.copies) - 1
            copied = pc.fill_null(pc.binary_length(whole.docs["text"]), 0).to_pylist()
            for i, (doc, copy, k) in enumerate(zip(whole.docs["doc_id"].to_pylist(), whole.copies.tolist(), turn.tolist(), strict=True)):
                if copy:
                    line = (doc, copied[i], copied[i], 1, hashlib.sha256().hexdigest())
                    begin, end = np.array([0]), np.array([copied[i]])
                else:
                    raw = whole.data[whole.offsets[k] : whole.offsets[k + 1]]
                    begin, end = merged(spans[first[k] : first[k + 1], 1:])
                    kept = [raw[x:y].tobytes() for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True)]
                    line = (doc, len(raw), int((end - begin).sum()), len(begin), hashlib.sha256(b"".join(kept)).hexdigest())
                out.append((*line, [{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)]) if with_text else line)
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=False)})

    def together(notes: DataFrame, texts: DataFrame = dealt):
        return texts.groupBy("chunk").cogroup(notes.groupBy("chunk"))

    own_anchors = together(copies).applyInArrow(keep_anchors, "chunk long, data binary")
    anchors = together(copies).applyInArrow(tell_anchors, "bucket long, chunk long, data binary")
    if earlier:
        anchors = anchors.unionByName(earlier[1].select("chunk", "data").mapInArrow(deal_anchors, "bucket long, chunk long, data binary"))
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, _NOTE)
    texts = dealt
    if earlier:
        texts = dealt.unionByName(earlier[0].select(dealt.columns).join(shared.select(F.col("chunk").alias("chunk")).distinct(), "chunk", "left_semi"))
    windows = together(copies.unionByName(shared), texts).applyInArrow(tell_windows, _WINDOWS)
    spans = windows.groupBy("bucket").applyInArrow(scan_windows, _NOTE)
    notes = copies.unionByName(spans)
    return together(notes.where(F.col("chunk") >= base) if earlier else notes).applyInArrow(cut, result), own_anchors
