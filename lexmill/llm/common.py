"""Shared kernels: views on Arrow text buffers, word spans, rolling hashes, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.storage import checkpoint_dir

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes that are hashed or gathered at once, however long a text is.
BLOCK = 1 << 20

#: The six bytes that contracts count as space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def quoted(name: str) -> str:
    """A column's name as expressions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that a lost executor costs no more than a read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds `_number`, from 0 in this order, without a task that sees all rows: ranges are sorted, and counted one by one."""
    sorted_ranges = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    ranges = sorted_ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # as many as partitions
    before, total = [], 0
    for r in ranges:
        before.append((r["range"], total))
        total += r["n"]
    first = F.create_map(*(F.lit(x) for pair in before for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    return sorted_ranges.withColumn("_number", (F.try_element_at(first, F.spark_partition_id()) + place.bitwiseAND((1 << 33) - 1)).cast("long"))


def chunk_count(df_bytes: int, target: int) -> int:
    return max(1, -(-int(df_bytes) // target))


def dealt_texts(docs: DataFrame, chunks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """chunk, doc_id, id (doc_id, or the greatest long without one), digest (SHA-256 of the text), text, and columns to carry.

    Documents are dealt by id and digest, so that neither one id nor the rows without one come to a single chunk.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    named = plain.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text", *carry)
    return named.select(F.pmod(F.xxhash64(F.lit("chunk"), "id", "digest"), F.lit(chunks)).alias("chunk"), "doc_id", "id", "digest", "text", *carry)


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(n), int(size)


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the offsets of each row in them. A null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes that stay within a row, and each row's first run."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 21)
        held = np.full(size, base, U64)
        held[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(held, out=held)
        _powers[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h.copy()
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of (value + 1) * base^position, modulo 2^64, before each position."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    terms = values.astype(U64)
    terms += U64(1)
    terms *= powers(len(values))
    np.cumsum(terms, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges; equal content has equal hashes, wherever it stands."""
    h = sums[ends]
    h -= sums[starts]
    h *= powers(len(sums), _INV)[starts]
    h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ranges of one width, by start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U64)
    h = sums[width:] - sums[:n]
    h *= powers(n, _INV)
    return mix(h)


def string_rows(column: pa.Array, begin: int, end: int) -> list[str]:
    return [x or "" for x in column.slice(begin, end - begin).to_pylist()]


def range_blocks(size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of ranges of these sizes, BLOCK bytes or one range at a time: first and last range, whose each byte is, its turn."""
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK, "right")))
        n = size[a:b]
        whose = np.repeat(np.arange(a, b), n)
        yield a, b, whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)
        a = b


def pick(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    out = np.empty(int(size.sum()), np.uint8)
    at = 0
    for _, _, whose, turn in range_blocks(size):
        out[at : at + len(whose)] = data[start[whose] + turn]
        at += len(whose)
    return out


def same_bytes(data: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of ranges, none of them empty, say the same."""
    out = np.ones(len(size), bool)
    for _, _, whose, turn in range_blocks(size):
        out[whose[data[start[whose] + turn] != data[other[whose] + turn]]] = False
    return out


def whole_column(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def blobs_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The longs of all blobs of a binary column, and how many each has."""
    data, offsets = utf8_view(whole_column(column))
    return np.frombuffer(data.tobytes(), np.int64), np.diff(offsets) // 8


def parted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, the place of each key's first in that order, and where the last of them ends."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    return order, at, np.append(at, len(k))[1:]


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that touch or overlap: starts, ends."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]
