"""Best-two-fit packing of token sequences.

Only the histogram of piece lengths, at most `capacity` numbers whatever the corpus, is packed on the driver. It yields
bin patterns with a multiplicity; each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed

_encoders: dict[str, tuple] = {}
#: Below this code point both tokenizer libraries agree on which characters are letters, digits and spaces.
_AGREED = 0x250


def _encoder(path: str):
    """The tokenizer of a JSON file, the tokens it has beside its vocabulary, and a faster encoder over the same merges."""
    if path not in _encoders:
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary, added = told["model"]["vocab"], tuple(t["content"] for t in told["added_tokens"])
        # The byte of each character in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        if set(byte) != set(ByteLevel.alphabet()):
            raise ValueError(f"{path} is not a byte-level vocabulary")
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if all(c in byte for c in word) and word not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _encoders[path] = slow, added, tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode(path: str, text: str) -> np.ndarray:
    """Token ids as uint32, as the tokenizer gives them without adding special tokens; those that a text spells out are its own.

    Texts of unusual characters or with added tokens go through the tokenizer itself, the others through its faster twin.
    """
    slow, added, fast = _encoder(path)
    if not text:
        return np.zeros(0, "<u4")
    if (text.isascii() or max(text) < chr(_AGREED)) and not any(t in text for t in added):
        return np.array(fast.encode_ordinary(text), "<u4")
    return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces. Only what exceeds the capacity is cut; the remainder comes first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if first and not s else capacity) for s in starts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. A null or empty text is the end id alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(tokenizer, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many)], bins) that use up a histogram of lengths from 1 to capacity.

    A bin takes the longest length that fits, again and again. While a gap is left, its smallest document gives way to the
    two unpacked ones that fill the gap so widened best, if they fill it better. Bins of one pattern are made at once.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not (1 <= min(left) and max(left) <= capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    lengths = sorted(left)
    out = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        at = len(lengths) - 1
        while gap and at >= 0:
            at = min(at, bisect_right(lengths, gap) - 1)
            if at < 0:
                break
            n = lengths[at]
            if take := min(gap // n, left[n] - used.get(n, 0)):
                used[n] = used.get(n, 0) + take
                gap -= take * n
            at -= 1
        while gap and sum(used.values()) > 1:
            small = min(used)
            used[small] -= 1
            if not used[small]:
                del used[small]
            pair = _best_pair(lengths, left, used, small, gap + small)
            if pair is None:
                used[small] = used.get(small, 0) + 1
                break
            for n in pair:
                used[n] = used.get(n, 0) + 1
            gap += small - sum(pair)
        bins = min(left[n] // k for n, k in used.items())
        out.append((sorted(used.items(), reverse=True), bins))
        for n, k in used.items():
            left[n] -= k * bins
        lengths = [n for n in lengths if left[n]]
    return out


def _best_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], small: int, room: int) -> tuple[int, int] | None:
    """The two free lengths of the greatest sum over `small` and up to `room`."""
    v = np.array([n for n in lengths[: bisect_right(lengths, room - 1)] if left[n] > used.get(n, 0)], np.int64)
    if not len(v):
        return None
    free = np.array([left[n] - used.get(n, 0) for n in v.tolist()])
    at = np.searchsorted(v, np.minimum(v, room - v), "right") - 1
    at -= (at >= 0) & (v[at] == v) & (free < 2)
    total = np.where(at >= 0, v + v[at], 0)
    best = int(total.argmax())
    return (int(v[best]), int(v[at[best]])) if total[best] > small else None


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset. Pieces of full length stand alone, under negative numbers."""
    pieces = checkpointed(pieces)
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    histogram = {int(r["length"]): int(r["n"]) for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = []  # length, first rank, first sequence, pieces of the length in a sequence, offset
    ranks: dict[int, int] = dict.fromkeys(histogram, 0)
    base = 0
    for pattern, bins in best_two_fit(histogram, capacity):
        offset = 0
        for n, k in pattern:
            runs.append((n, ranks[n], base, k, offset))
            ranks[n] += k * bins
            offset += n * k
        base += bins
    runs.sort()
    table = np.array(runs or [(0, 0, 0, 1, 0)], np.int64)
    first = {int(n): int(i) for n, i in zip(*np.unique(table[:, 0], return_index=True), strict=True)}
    salts = max(64, -(-max(histogram.values(), default=0) // 200_000))

    dealt = rest.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
        .join(before, ["length", "_salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    )
    ends = dict(zip(first, [*list(first.values())[1:], len(table)], strict=True))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n).tolist():
                own = np.flatnonzero(n == length)
                lines = table[first[length] : ends[length]]
                line = lines[np.searchsorted(lines[:, 1], rank[own], "right") - 1]
                bin_, turn = np.divmod(rank[own] - line[:, 1], line[:, 3])
                sequence[own] = line[:, 2] + bin_
                offset[own] = line[:, 4] + turn * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    seated = ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return seated.unionByName(full)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Packs `docs` (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    Null and empty texts are one end token; an empty table gives an empty result; repeated rows are packed as often as they
    come; a null doc_id is kept.
    """
    return place(token_pieces(docs, tokenizer, capacity), capacity)
