"""Benchmark decontamination by spaced seeds.

A mask names the token places of a window that count; the others may differ. Hashes of masked windows of the documents are
joined with those of the benchmark, and around each hit the aligned tokens are compared, substitutions allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import U64, checkpointed, mix, prefix_sums, quoted, range_hashes, slices, utf8_view, word_spans

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("11101011", "1101001011", "110010100111")
#: Bytes of benchmark text that a task holds at most. A larger benchmark is dealt to blocks, each to so many tasks.
BLOCK_BYTES = 8 << 20
SALTS = 64
#: Bits of the filter over the seeds of a larger benchmark, and of one of its pages.
BLOOM, PAGE_BITS = 1 << 27, 20
#: Tokens of items that are aligned with documents at once.
DIAGONAL_TOKENS = 1 << 19
#: In an overlap, a token that differs costs as much as so many equal ones earn.
PENALTY = 3

_WORD = np.ones(256, bool)
_WORD[:128] = [chr(b).isalnum() for b in range(128)]


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters, digits and non-ASCII characters, and each row's first."""
    data, offsets = utf8_view(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, first = word_spans(_WORD[data], offsets)
    return (range_hashes(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, U64)), first


def seeds(tokens: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of masked windows, and where each begins. Windows stay within a row."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.full(n, len(mask), U64)
    for place, c in enumerate(mask):
        if c == "1":
            h = (h ^ tokens[place : place + n]) * U64(0x9FB21C651E98DF25 + 2 * place)
            h ^= h >> U64(29)
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return mix(h[at]), at


def item_seeds(tokens: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Mask, hashes, places and items of all seeds. An item shorter than the shortest mask has one for all of its tokens."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    shortest = min(map(len, masks))
    out = []
    for mask in (*masks, *("1" * k for k in sorted(set(n[(n > 0) & (n < shortest)].tolist())))):
        h, at = seeds(tokens, row, mask)
        if len(mask) < shortest:
            own = n[row[at]] == len(mask)
            h, at = h[own], at[own]
        out.append((mask, h, at, row[at]))
    return out


class Benchmark:
    """A block of benchmark items: their tokens and a sorted table of their seeds."""

    def __init__(self, ids: list, texts: list[str | None], masks: tuple[str, ...]) -> None:
        self.ids = ids
        self.tokens, self.first = token_hashes(pa.array(texts, pa.string()))
        self.sizes = np.diff(self.first)
        self.tables = []
        for mask, h, at, row in item_seeds(self.tokens, self.first, masks):
            order = np.argsort(h, kind="stable")
            h, at, row = h[order], at[order], row[order]
            bits = max(16, min(24, int(len(h) * 32).bit_length()))
            maybe = np.zeros(1 << bits, bool)
            maybe[(h & U64((1 << bits) - 1)).astype(np.int64)] = True
            self.tables.append((mask, h, at, row, maybe, U64((1 << bits) - 1)))

    def candidates(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (row, item, diagonal) of the hits; a diagonal is where the item's first token would stand."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = [np.zeros((0, 3), np.int64)]
        for mask, h, at, item, maybe, low in self.tables:
            if not len(h):
                continue
            g, where = seeds(tokens, row, mask)
            hit = np.flatnonzero(maybe[(g & low).astype(np.int64)])
            begin, end = np.searchsorted(h, g[hit]), np.searchsorted(h, g[hit], "right")
            many = end - begin
            each = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
            place = np.repeat(where[hit], many)
            found.append(np.stack([row[place], item[each], place - (at[each] - self.first[item[each]])], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, tokens: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
        """row, item, equal tokens, length, place in the row, place in the item: the best overlap of each row and item that has
        enough equal tokens on a diagonal (see stretches); the most equal tokens, then the shortest, then the earliest."""
        found = self.candidates(tokens, first)
        best = [np.zeros((0, 6), np.int64)]
        room = np.cumsum(self.sizes[found[:, 1]]) // DIAGONAL_TOKENS
        for part in np.split(found, np.flatnonzero(np.diff(room)) + 1) if len(found) else ():
            best.append(self._best(part, tokens, first, least))
        out = np.concatenate(best)
        out = out[np.lexsort((out[:, 4], out[:, 3], -out[:, 2], out[:, 1], out[:, 0]))]
        return out[np.concatenate([np.ones(min(1, len(out)), bool), (out[1:, :2] != out[:-1, :2]).any(axis=1)])]

    def _best(self, found: np.ndarray, tokens: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
        row, item, diagonal = found.T
        a, b = np.maximum(diagonal, first[row]), np.minimum(diagonal + self.sizes[item], first[row + 1])
        n, need = b - a, np.minimum(least, self.sizes[item])
        edge = np.cumsum(n + 1) - (n + 1)  # a zero, then the scores, for each diagonal
        pair = np.repeat(np.arange(len(n)), n)
        turn = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        same = self.tokens[self.first[item[pair]] + a[pair] - diagonal[pair] + turn] == tokens[a[pair] + turn]
        step = np.zeros(int((n + 1).sum()), np.int64)
        step[edge[pair] + turn + 1] = np.where(same, 1, -PENALTY)
        equal = np.zeros(len(step), np.int64)
        equal[edge[pair] + turn + 1] = same
        score, equal = np.cumsum(step), np.cumsum(equal)
        whose = np.repeat(np.arange(len(n)), n + 1)
        score -= whose * (int(np.ptp(score)) + 1)  # no lowest score of a diagonal reaches into the next
        low = np.minimum.accumulate(score)
        place = np.arange(len(score))
        begin = np.maximum.accumulate(np.where(score == low, place, 0))
        gain = score - low
        top = np.maximum.reduceat(gain, edge)
        stop = np.full(len(n), len(score))
        np.minimum.at(stop, whose[gain == top[whose]], place[gain == top[whose]])
        start = begin[stop]
        match = equal[stop] - equal[start]
        start, stop = start - edge, stop - edge
        total = equal[np.append(edge[1:], len(score)) - 1] - equal[edge]
        for i in np.flatnonzero((match < need) & (total >= need)).tolist():  # another stretch may have enough of them
            own = same[np.searchsorted(pair, i) : np.searchsorted(pair, i, "right")]
            enough = [(gain, -x, y) for gain, x, y in stretches(own.tolist()) if own[x:y].sum() >= need[i]]
            if enough:
                _, x, stop[i] = max(enough)
                start[i] = -x
                match[i] = own[start[i] : stop[i]].sum()
        out = np.stack([row, item, match, stop - start, a + start - first[row], a - diagonal + start], axis=1)
        return out[match >= need]


def stretches(same: list[bool]) -> list[tuple[int, int, int]]:
    """gain, start, stop: the maximal stretches of a diagonal, those that no longer one outdoes (Ruzzo and Tompa)."""
    found: list[tuple[int, int, int, int]] = []  # start, stop, the score before and with it
    score = 0
    for i, equal in enumerate(same):
        score += 1 if equal else -PENALTY
        if not equal:
            continue
        start, low = i, score - 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= score:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, low, score))
    return [(high - low, start, stop) for start, stop, low, high in found]


_RESULT = "doc_id long, item_id long, n_items long, n_match int, n_overlap int, n_item int, score double, doc_token long, item_token int"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32())


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 12, masks: tuple[str, ...] = MASKS, block_bytes: int = BLOCK_BYTES, salts: int = SALTS) -> DataFrame:
    """doc_id, item_id, n_items, n_match, n_overlap, n_item, score, doc_token, item_token: where a document overlaps the benchmark.

    An overlap runs along aligned tokens and gains one for an equal token and loses PENALTY for one that differs; it counts
    with `least` equal tokens or more, or with all of a shorter item's; of the maximal stretches that have them the best is
    taken, and of a document and an item the one of the most equal tokens. Items that overlap a document alike (in the same
    tokens of it, with as many equal ones, as those with a common preamble do) make one row, of the least item_id, with their
    number in n_items. score is n_match over the item's tokens. docs: doc_id, text; benchmark: item_id, text; other columns
    are ignored. Null and empty texts have no tokens and no overlaps, an empty table on either side gives no rows, rows of
    docs repeated give rows repeated, a null id stays null.

    A benchmark of up to block_bytes goes to all executors. A larger one is dealt to blocks of that size at most (or one
    item); hashes of documents and of blocks are joined, documents go to the blocks that they share a hash with, dealt over
    `salts` tasks a block, and what the blocks find is folded as within one: the rows do not depend on the blocks.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= block_bytes:
        rows = items.collect()
        block = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*block.value, masks)
            for batch in batches:
                yield from _search(bench, batch.column(0), batch.column(1), least)

        return plain.mapInArrow(run, _RESULT)

    blocks = -(-2 * int(size) // block_bytes)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    plain = plain.withColumns({"h": F.xxhash64("doc_id", "text"), "row": F.monotonically_increasing_id()})
    hits = shared_seeds(plain, items, masks)
    # Documents, after the items of each task's block, which every salt has.
    far = plain.join(hits, "h").select("block", F.pmod(F.xxhash64(F.lit("salt"), "h"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), F.struct(F.col("doc_id").alias("id"), "h", "row").alias("name"), "text")
    near = items.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), F.struct(F.col("item_id").alias("id"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("row")).alias("name"), "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bench, ids, texts = None, None, [], []
        for batch in batches:
            key = batch.column(0).to_numpy() * salts + batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            for a, b in _even(key * 2 + kind):
                if key[a] != at:
                    at, bench, ids, texts = key[a], None, [], []
                if kind[a] == 0:
                    ids += batch.column(3).slice(a, b - a).field("id").to_pylist()
                    texts += batch.column(4).slice(a, b - a).to_pylist()
                else:
                    bench = bench or Benchmark(ids, texts, masks)
                    yield from _search(bench, batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a), least)

    found = near.unionByName(far).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(stream, _RESULT.replace("doc_id long", "name struct<id:long, h:long, row:long>"))
    # Rows alike of several blocks: the least item of all, and the sum of their numbers.
    number = F.coalesce("item_id", F.lit((1 << 63) - 1)).alias("number")
    folded = found.groupBy("name", "doc_token", "n_overlap", "n_match").agg(F.min(F.struct(number, "n_item", "item_token", "item_id", "score")).alias("least"), F.sum("n_items").alias("n_items"))
    return folded.select(F.col("name.id").alias("doc_id"), "least.item_id", "n_items", "n_match", "n_overlap", "least.n_item", "least.score", "doc_token", "least.item_token")


def _even(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal keys."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    yield from zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True)


def shared_seeds(plain: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """h, block: documents (h, text) and blocks of items (block, text) that share a seed.

    A Bloom filter of fixed size over the items' seeds keeps most others of the documents at home.
    """
    shortest = min(map(len, masks))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                block = batch.column(0).slice(a, b - a).to_numpy()
                for mask, h, _, row in item_seeds(*token_hashes(batch.column(1).slice(a, b - a)), masks):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(block[row]), pa.array(np.full(len(h), len(mask), np.int32))], names=["seed", "block", "length"])

    def page(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PAGE_BITS, bool)
        bits[table["bit"].to_numpy() & ((1 << PAGE_BITS) - 1)] = True
        return pa.table({"page": pa.array([table["page"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    known = checkpointed(items.select("block", "text").mapInArrow(of_items, "seed long, block long, length int").distinct())
    short = [int(r[0]) for r in known.where(F.col("length") < shortest).select("length").distinct().collect()]  # a number for each short length
    every = (*masks, *("1" * k for k in sorted(short)))
    places = known.select(F.explode(F.array(F.expr(f"seed & {BLOOM - 1}"), F.expr(f"shiftrightunsigned(seed, 32) & {BLOOM - 1}"))).alias("bit")).distinct()
    pages = places.withColumn("page", F.shiftright("bit", PAGE_BITS)).groupBy("page").applyInArrow(page, "page long, bits binary").collect()  # BLOOM bits at most
    bloom = np.zeros(BLOOM, bool)
    for r in pages:
        bloom[r["page"] << PAGE_BITS : (r["page"] + 1) << PAGE_BITS] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    box = plain.sparkSession.sparkContext.broadcast(np.packbits(bloom))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                tokens, first = token_hashes(batch.column(1).slice(a, b - a))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                name = batch.column(0).slice(a, b - a).to_numpy()
                for mask in every:
                    h, at = seeds(tokens, row, mask)
                    for shift in (0, 32):
                        bit = (h >> U64(shift) & U64(BLOOM - 1)).astype(np.int64)
                        own = box.value[bit >> 3] >> (7 - (bit & 7)) & 1 == 1
                        h, at = h[own], at[own]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(name[row[at]])], names=["seed", "h"])

    told = plain.select("h", "text").mapInArrow(of_documents, "seed long, h long").distinct()
    return told.join(known.select("seed", "block"), "seed").select("h", "block").distinct()


def _search(bench: Benchmark, ids: pa.Array, column: pa.Array, least: int) -> Iterator[pa.RecordBatch]:
    """The overlaps of texts; one row for the items of a document that overlap it alike."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    number = np.array([(1 << 63) - 1 if i is None else i for i in bench.ids], np.int64)
    for a, b in slices(column):
        found = bench.overlaps(*token_hashes(column.slice(a, b - a)), least)
        row, item, match, length, place, at = found[np.lexsort((found[:, 5], bench.sizes[found[:, 1]], number[found[:, 1]], found[:, 2], found[:, 3], found[:, 4], found[:, 0]))].T
        alike = np.stack([row, place, length, match])
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (alike[:, 1:] != alike[:, :-1]).any(axis=0)]))
        many = np.diff(np.append(head, len(row)))
        row, item, match, length, place, at = (x[head] for x in (row, item, match, length, place, at))
        size = bench.sizes[item]
        columns = (ids.slice(a, b - a).take(pa.array(row)), pa.array([bench.ids[i] for i in item.tolist()], pa.int64()), many, match, length, size, match / np.maximum(size, 1), place, at)
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(k) for c, k in zip(columns, _KINDS, strict=True)], names=names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 12) -> DataFrame:
    """The rows of docs (doc_id, text) whose text overlaps no benchmark item, all columns kept, whatever their names.

    A document is judged by its text, named by 64 bits of its hash: another text of its doc_id, or another without one, stays. Null and empty texts
    stay, repeated rows go or stay together, an empty benchmark takes nothing away.
    """
    named = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.xxhash64(F.lit("text"), F.col("text").cast("string")).alias("name"), F.col("text").cast("string").alias("text"))
    hit = overlaps(named.select(F.col("name").alias("doc_id"), "text"), benchmark, least).select(F.col("doc_id").alias("name")).distinct()
    return named.join(hit, "name", "left_anti").select("row.*")
