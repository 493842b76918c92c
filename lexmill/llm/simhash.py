"""SimHash fingerprints and near-duplicate groups, with candidates from a pigeonring of fingerprint segments.

Cut two fingerprints into m segments on a ring. If they differ at no more than t bits, then at some segment a chain starts
whose first l segments differ at no more than l*t/m bits, for every l. Candidates come from keys on the segments that such
a chain leaves equal; pairs without such a chain are pruned before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import LOWER, SPACE, U64, checkpointed, mix, prefix_sums, range_hashes, slices, utf8_view, word_spans
from lexmill.llm.components import Forest, components

_LANES = U64(0x0101010101010101)
#: Buckets up to this size are compared pair by pair; larger ones in another way, without all pairs.
SMALL_BUCKET = 16
#: Rows of a bucket that one task holds.
LARGE_BUCKET = 200_000
#: Nodes of a group of candidates that one task verifies by their shingles.
BLOCK_NODES = 4_000


def _xxh64(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw, h = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((h(raw[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), U64, len(starts))


def _rolling(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_sums(joined), starts, ends)


#: How a shingle is hashed: XXH64 with seed 42, or the vectorised polynomial hash.
HASHES: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {"xxh64": _xxh64, "rolling": _rolling}


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int, hasher: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the place of each row's first. Fewer words than a shingle has: the whole sequence."""
    data = LOWER[data]
    starts, ends, first = word_spans(~SPACE[data], offsets)
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    joined = np.full(at[-1], 0x20, np.uint8)  # every word, then one space
    if len(starts):
        source = np.repeat(starts - at[:-1], size + 1) + np.arange(at[-1])
        source[at[1:] - 1] = 0
        joined = data[source]
        joined[at[1:] - 1] = 0x20
    many = np.diff(first)
    shingles = np.where(many >= words, many - words + 1, np.minimum(many, 1))
    begin = np.zeros(len(shingles) + 1, np.int64)
    np.cumsum(shingles, out=begin[1:])
    a = np.repeat(first[:-1] - begin[:-1], shingles) + np.arange(begin[-1])
    last = np.minimum(a + words, np.repeat(first[1:], shingles)) - 1
    return HASHES[hasher](joined, at[a], at[last + 1] - 1), begin


def majority_bits(hashes: np.ndarray, begin: np.ndarray, lanes: int = 1) -> np.ndarray:
    """(rows, lanes) words whose bits are set in more than half of a row's hashes. Rows without a hash have zero."""
    rows = len(begin) - 1
    out = np.zeros((rows, lanes), U64)
    filled = np.flatnonzero(np.diff(begin))
    if not len(filled):
        return out
    n = np.diff(begin)[filled]
    blocks = -(-n // 255)  # eight counters of a byte each hold up to 255
    firsts = np.zeros(len(filled), np.int64)
    np.cumsum(blocks[:-1], out=firsts[1:])
    turn = np.arange(blocks.sum()) - np.repeat(firsts, blocks)
    cuts = np.repeat(begin[:-1][filled], blocks) + turn * 255
    for lane in range(lanes):
        h = hashes if not lane else mix(hashes + U64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        counts = np.empty((len(filled), 8, 8), np.int64)
        for bit in range(8):
            sums = np.add.reduceat((h >> U64(bit)) & _LANES, cuts)
            counts[:, :, bit] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        packed = np.packbits((counts.reshape(-1, 64) * 2 > n[:, None]), axis=1, bitorder="little")
        out[filled, lane] = packed.view("<u8")[:, 0]
    return out


def distinct(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes without repeats."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    _, at = np.unique(mix(hashes + row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    at.sort()
    return hashes[at], np.searchsorted(row[at], np.arange(len(begin)))


def set_digests(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 bits of each row's set of hashes, as longs. Hashes of a row are distinct."""
    out = np.zeros(len(begin) - 1, U64)
    filled = np.flatnonzero(np.diff(begin))
    if len(filled):
        out[filled] = mix(np.add.reduceat(mix(hashes + U64(1)), begin[filled]))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, hasher: str = "xxh64", repeats: bool = True, sets: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, f0 ... : fingerprints of 64 bits a lane as longs. A null text is empty and, like any text without words, zero.

    With `repeats` a shingle counts as often as it occurs, else once. With `sets`, node is the digest of a text's shingles.
    """
    out = [*keys, *(f"f{i}" for i in range(lanes)), *(["node"] if sets else [])]
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                hashed = shingle_hashes(*utf8_view(part.column(at)), words, hasher)
                once = distinct(*hashed) if sets or not repeats else hashed
                words_ = majority_bits(*(hashed if repeats else once), lanes)
                own = [np.ascontiguousarray(words_[:, i]).view(np.int64) for i in range(lanes)] + ([set_digests(*once)] if sets else [])
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *map(pa.array, own)], names=out)

    return docs.select(*(F.col(k).cast("long") for k in keys), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in out))


def viable(differences: np.ndarray, most: int) -> np.ndarray:
    """Pairs (rows) of whose ring of segment differences some chain stays within l*most/m at every length l up to m."""
    m = differences.shape[1]
    ring = np.concatenate([differences, differences[:, :-1]], axis=1).astype(np.int64)
    alive = np.ones((len(ring), m), bool)
    total = np.zeros((len(ring), m), np.int64)
    for length in range(1, m + 1):
        total += ring[:, length - 1 : length - 1 + m]
        alive &= total * m <= length * most
    return alive.any(axis=1)


def near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which rows of two (n, lanes) arrays differ at `most` bits or fewer: the chain filter, then the full check."""
    differences = np.bitwise_count((x ^ y).view(np.uint16).reshape(len(x), -1))
    kept = np.flatnonzero(viable(differences, most))
    out = np.zeros(len(x), bool)
    out[kept[differences[kept].sum(axis=1, dtype=np.int64) <= most]] = True
    return out


def exact_tables(lanes: int = 1) -> list[list[int]]:
    """Bits of the keys that find all pairs of 64-bit fingerprints with two differing bits or fewer.

    With four segments a viable chain starts with an equal segment (budget 0.5), and the next two together differ at one bit
    at most (budgets 1 and 1.5), so that one of them is equal too: a segment with its next, or with the one after that.
    """
    pairs = sorted({tuple(sorted((i, (i + step) % 4))) for i in range(4) for step in (1, 2)})
    return [[16 * s + b for s in pair for b in range(16)] for pair in pairs]


def spread_tables(lanes: int, tables: int, key_bits: int, seed: int = 7) -> list[list[int]]:
    """Keys on chains of nibbles, each chain spread over the ring by its own stride: for similarities no exact index reaches."""
    rng = np.random.default_rng(seed)
    nibbles = lanes * 16
    out = []
    for t in range(tables):
        chain = rng.permutation(nibbles)[: key_bits // 4]
        out.append([4 * int(s) + b for s in chain for b in range(4)])
    return out


def spread_plan(rows: int, similarity: float, missed: float = 0.008, least_bits: int = 20) -> tuple[int, int]:
    """How many tables of how many bits find all but `missed` of the pairs of a Jaccard similarity among so many fingerprints.

    A key has about as many values as there are fingerprints, so that unlike ones seldom share it; the more bits it takes, the
    more tables make up for the pairs that it parts.
    """
    bits = max(least_bits, -(-max(1, rows).bit_length() // 4) * 4)
    cosine = 2 * similarity / (1 + similarity)  # of two sets of one size
    agree = 1 - np.arccos(cosine) / np.pi
    return int(np.ceil(np.log(missed) / np.log1p(-(agree**bits)))), bits


def _keys(words: np.ndarray, tables: list[list[int]]) -> np.ndarray:
    """(n, tables) keys: the table's number over the bits that it names."""
    out = np.empty((len(words), len(tables)), np.int64)
    for t, bits in enumerate(tables):
        key = np.zeros(len(words), U64)
        for i, bit in enumerate(bits):
            key |= ((words[:, bit // 64] >> U64(bit % 64)) & U64(1)) << U64(i)
        out[:, t] = (key | U64(t << 40)).view(np.int64)
    return out


def _hub_links(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of a large bucket of 64-bit fingerprints at two bits or fewer, up to connectedness, in n*65 steps.

    Two fingerprints differ at two bits or fewer exactly if some value lies within one bit of both. Each goes to the 65
    values around it, and what meets there is linked in a line.
    """
    if most != 2 or words.shape[1] != 1:
        raise ValueError("meeting points are for two bits of one lane")
    n = len(words)
    flips = np.concatenate([[U64(0)], U64(1) << np.arange(64, dtype=U64)])
    a, b = [], []
    step = max(1, (4 << 20) // max(n, 1))
    # A value is met at the flip that makes it; values are dealt by their own hash so that no more than a few millions are sorted at once.
    parts = max(1, n * 65 // (8 << 20))
    for part in range(parts):
        values, owners = [], []
        for i in range(0, 65, step):
            v = words[:, 0][:, None] ^ flips[None, i : i + step]
            if parts > 1:
                rows, cols = np.nonzero(mix(v) % U64(parts) == U64(part))
                values.append(v[rows, cols])
                owners.append(rows)
            else:
                values.append(v.ravel())
                owners.append(np.repeat(np.arange(n), v.shape[1]))
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        pair = np.unique(np.minimum(o[same], o[same + 1]) * n + np.maximum(o[same], o[same + 1]))
        a.append(pair // n)
        b.append(pair % n)
    return np.concatenate(a), np.concatenate(b)


def _reach_links(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large bucket that connect all its pairs within the distance: each row is compared with all not yet reached.

    A dense group is reached from its first row at once, and then no more of it is left to compare. Rows whose distances
    from that first row differ by more than `most` cannot be within it of each other.
    """
    a, b = [], []
    left = np.arange(len(words))
    while len(left) > 1:
        first, left = left[0], left[1:]
        far = np.bitwise_count(words[left] ^ words[first]).sum(axis=1, dtype=np.int64)
        reached = [(first, 0)]
        while reached and len(left):
            row, d = reached.pop()
            maybe = np.flatnonzero(np.abs(far - d) <= most)
            close = maybe[np.bitwise_count(words[left[maybe]] ^ words[row]).sum(axis=1, dtype=np.int64) <= most]
            if len(close):
                a.append(np.full(len(close), row))
                b.append(left[close])
                reached += zip(left[close].tolist(), far[close].tolist(), strict=True)
                left, far = np.delete(left, close), np.delete(far, close)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _bucket_links(keys: np.ndarray, words: np.ndarray, most: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key; keys are sorted."""
    n = len(keys)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(edges, n))
    group = np.repeat(size, size)
    left, right = [], []
    alive = np.flatnonzero((group > 1) & (group <= SMALL_BUCKET))
    shift = 1
    while len(alive := alive[alive + shift < n]) and len(alive := alive[keys[alive + shift] == keys[alive]]):
        good = near(words[alive], words[alive + shift], most)
        left.append(alive[good])
        right.append(alive[good] + shift)
        shift += 1
    for begin, many in zip(edges[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
        a, b = (_hub_links if exact else _reach_links)(words[begin : begin + many], most)
        left.append(a + begin)
        right.append(b + begin)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def links(nodes: DataFrame, lanes: int, tables: list[list[int]], most: int, exact: bool, large: int = LARGE_BUCKET) -> DataFrame:
    """nodes: node long, f0 ... (distinct fingerprints). Returns a, b: nodes that a link or a line of links joins.

    What the buckets of a partition join comes out as a forest: one row a node, however many links a dense group has. A
    bucket of more than `large` rows is held by no task: its rows come out as they are, and meet in another way, as
    complete (by the values one bit away, or by pairs of blocks of that size).
    """
    names = [f"f{i}" for i in range(lanes)]
    schema = "key long, node long, " + ", ".join(f"{n} long" for n in names)

    step = max(1, 32_768 // len(tables))  # rows that go out at once, times their keys, are few

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            words = np.stack(cols[1:], axis=1).view(U64)
            keys = _keys(words, tables)
            for begin in range(0, len(words), step):
                own = slice(begin, begin + step)
                k = keys[own]
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), *(pa.array(np.repeat(c[own], k.shape[1])) for c in cols)], names=["key", "node", *names])

    def meet(limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []
            forest = Forest()
            over: int | None = None  # the key of a bucket that is too large

            def join(cols: list[np.ndarray]) -> None:
                a, b = _bucket_links(cols[0], np.stack(cols[2:], axis=1).view(U64), most, exact)
                forest.add(cols[1][a].tolist(), cols[1][b].tolist())

            def as_they_are(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
                for cols in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", *names])

            for batch in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if over is not None:
                    rest = int(np.searchsorted(cols[0], over, "right"))
                    yield from as_they_are([[c[:rest] for c in cols]])
                    cols = [c[rest:] for c in cols]
                if not len(cols[0]):
                    continue
                over = None
                if not held or cols[0][-1] != held[0][0][-1]:  # all keys but the last are complete
                    cut = np.searchsorted(cols[0], cols[0][-1])
                    join([np.concatenate([*(h[i] for h in held), c[:cut]]) for i, c in enumerate(cols)])
                    held = [[c[cut:] for c in cols]]
                else:
                    held.append(cols)
                if limit and sum(len(h[0]) for h in held) > limit:
                    over = int(held[-1][0][-1])
                    yield from as_they_are(held)
                    held = []
            if held:
                join([np.concatenate([h[i] for h in held]) for i in range(len(held[0]))])
            for star in forest.stars():
                none = pa.nulls(len(star), pa.int64())
                yield pa.RecordBatch.from_arrays([none, star.column(0), star.column(1), *[none] * (lanes - 1)], names=["key", "node", *names])

        return run

    def near_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[U64(0)], U64(1) << np.arange(64, dtype=U64)])
        for batch in batches:
            for begin in range(0, len(batch), 512):
                node, f = (batch.column(i).slice(begin, 512).to_numpy() for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array((f.view(U64)[:, None] ^ flips).view(np.int64).ravel()), pa.array(np.repeat(node, 65))], names=["value", "node"])

    def in_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, last = Forest(), (np.zeros(0, np.int64),) * 2
        for batch in batches:
            value, node = (np.concatenate([x, c.to_numpy()]) for x, c in zip(last, batch.columns, strict=True))
            same = np.flatnonzero(value[1:] == value[:-1])
            forest.add(node[same].tolist(), node[same + 1].tolist())
            last = value[-1:], node[-1:]
        yield from forest.stars()

    def met(rows: DataFrame, limit: int | None) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet(limit), schema)

    out = checkpointed(met(nodes.select("node", *names).mapInArrow(emit, schema), large))
    found = out.where("key is null").select(F.col("node").alias("a"), F.col("f0").alias("b"))
    over = out.where("key is not null")
    if not over.limit(1).count():
        return found
    if exact:
        values = over.select("node", "f0").distinct().mapInArrow(near_values, "value long, node long")
        more = values.repartition("value").sortWithinPartitions("value").mapInArrow(in_line, "a long, b long")
    else:
        blocks = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / large).alias("blocks"))
        dealt = over.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", *names)
        more = met(pairs, None).select(F.col("node").alias("a"), F.col("f0").alias("b"))
    return found.unionByName(more)


def alike(hashes: np.ndarray, begin: np.ndarray, least: float) -> np.ndarray:
    """A number for each set, equal for sets that pairs with a Jaccard similarity of `least` connect. All such pairs count.

    Each set is compared with all not yet reached that share an element; a dense group is reached from its first set at once.
    """
    n, size = len(begin) - 1, np.diff(begin)
    element = np.unique(hashes, return_inverse=True)[1] if len(hashes) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(element, kind="stable")
    listed = owner[order]  # who has an element, by element
    key = element[order]
    group, left = np.full(n, -1), np.ones(n, bool)
    indexed = many = n
    for first in range(n):
        if not left[first]:
            continue
        left[first], group[first], reached = False, first, [first]
        many -= 1
        while reached and many:
            if 2 * many < indexed:
                kept = left[listed]
                listed, key, indexed = listed[kept], key[kept], many
            row = reached.pop()
            own = element[begin[row] : begin[row + 1]]
            a, b = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            found = listed[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())]
            who, shared = np.unique(found[left[found]], return_counts=True)
            close = who[shared * (1 + least) >= least * (size[who] + size[row]) - 1e-9]
            left[close], group[close] = False, first
            many -= len(close)
            reached += close.tolist()
    return group


def _settled(texts: DataFrame, keys: tuple[str, ...], words: int, hasher: str, least: float) -> DataFrame:
    """node, root: texts (keys, node, text) of equal keys that pairs of at least that similarity connect have one root."""
    many = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}  # rows of one name repeat
        at: tuple | None = None

        def settle() -> list[np.ndarray]:
            nodes = np.array(list(sets), np.int64)
            group = alike(np.concatenate(list(sets.values())), np.cumsum([0, *map(len, sets.values())]), least)
            sets.clear()
            return [nodes, nodes[group]]

        out = []
        for batch in batches:
            for a, b in slices(batch.column(many + 1)):
                h, begin = distinct(*shingle_hashes(*utf8_view(batch.column(many + 1).slice(a, b - a)), words, hasher))
                own = list(zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(many)), strict=True))
                node = batch.column(many).slice(a, b - a).to_numpy()
                for i in np.flatnonzero(set_digests(h, begin) == node).tolist():  # a name may have other texts too
                    if sets and at != own[i]:
                        out.append(settle())
                    at = own[i]
                    sets[int(node[i])] = h[begin[i] : begin[i + 1]].copy()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "root"])
                out = []
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in settle()], names=["node", "root"])

    return texts.select(*keys, "node", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, root long")


def verified(docs: DataFrame, candidates: DataFrame, words: int, hasher: str, least: float, block: int = BLOCK_NODES) -> DataFrame:
    """node, component: candidates (name, node, component; a document for each node) that pairs of at least that Jaccard
    similarity of their distinct shingles connect within a component. Texts (name, text) are read again for them alone.

    A task holds two blocks of about `block` nodes at most. A larger component is verified block by block; the roots found
    meet; and the nodes that its main group still lacks are held against every block, so that no pair is left out.
    """
    size = F.count(F.lit(1)).alias("n")
    blocks = candidates.groupBy("component").agg(size).select("component", F.ceil(F.col("n") / block).alias("blocks"))
    placed = candidates.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")))
    texts = docs.join(placed, "name")
    first = _settled(texts, ("component", "block"), words, hasher, least)
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return first.withColumnRenamed("root", "component")
    first = checkpointed(first)
    large_texts = texts.where("blocks > 1").select("component", "blocks", "block", "node", "text")
    roots = first.where("node = root").select("node").join(large_texts, "node")
    parted = roots.join(roots.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("some")), "component")
    met = _settled(parted.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("some"))), ("component", "part"), words, hasher, least)
    of_large = first.join(large.select("node"), "node", "left_semi")
    links_ = checkpointed(of_large.unionByName(met).where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = components(links_).select("node", F.col("component").alias("label"))
    labelled = checkpointed(large.select("component", "blocks", "block", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    share = labelled.groupBy("component", "label").agg(size)
    main = share.groupBy("component").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("every")).select("component", F.col("m.label").alias("main"), F.ceil((F.col("every") - F.col("m.n")) / block).alias("batches")).where("batches > 0")
    rest = labelled.join(main, "component").select("component", "blocks", "block", "node", "batches", (F.col("label") != F.col("main")).alias("lacked"))
    own = rest.select("component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch"), "node")
    lacked = rest.where("lacked").select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit("batch"), "node"), F.col("batches")).alias("batch"), "node")
    tasks = own.unionByName(lacked).distinct().join(large_texts.select("node", "text"), "node")
    last = _settled(tasks, ("component", "block", "batch"), words, hasher, least).where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    joined = components(links_.unionByName(last))
    small = first.join(large.select("node"), "node", "left_anti").select("node", F.col("root").alias("component"))
    return small.unionByName(joined.select("node", "component"))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2, hasher: str = "xxh64", repeats: bool = True) -> DataFrame:
    """One row a document: doc_id, f0, component_id (the smallest doc_id reachable over links, its own included).

    Fingerprints of 64 bits link at two differing bits or fewer; the search is exact. Null and empty texts have fingerprint
    zero and link like any other; repeated rows stay; other columns are ignored; an empty table gives an empty result. A null
    doc_id is a document that cannot name a component: without others in it, its component_id is null.
    """
    if most != 2:
        raise ValueError("the exact search is for two differences")
    each = checkpointed(fingerprints(docs, words, 1, hasher, repeats))
    classes = each.groupBy("f0").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("f0"))
    joined = components(links(classes, 1, exact_tables(), most, exact=True))
    grouped = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(lowest, "component").select("f0", "component_id")
    return each.join(named, "f0")


def alike_documents(docs: DataFrame, least: float = 0.8, words: int = 5, lanes: int = 4, hasher: str = "rolling", block: int = BLOCK_NODES) -> DataFrame:
    """name, first: for each of docs (rank long, name long, text) the name of the first document of its group, by rank and name.

    Documents are alike that pairs of a Jaccard similarity of `least` or more connect, by their distinct shingles; texts
    without a word are alike. Candidates are fingerprints (64 bits a lane) of which `least` of the bits agree, found by keys
    that grow with the number of fingerprints (see spread_plan), and verified by their shingles. A null text is empty; rows
    of one name and text are one document; an empty table gives an empty result; other columns are ignored.
    """
    names = [f"f{i}" for i in range(lanes)] + ["node"]
    plain = docs.select(F.col("rank").cast("long").alias("rank"), F.col("name").cast("long").alias("name"), F.col("text").cast("string").alias("text"))
    each = checkpointed(fingerprints(plain, words, lanes, hasher, False, True, ("rank", "name")))
    classes = each.groupBy(*names).agg(F.min(F.struct("rank", "name")).alias("first"))
    bits = 64 * lanes
    tables = spread_tables(lanes, *spread_plan(each.select(*names).distinct().count(), least))
    joined = components(links(classes, lanes, tables, int((1 - least) * bits + 1e-9), exact=False))
    candidates = joined.join(classes.select("node", F.col("first.name").alias("name")), "node")
    sure = verified(plain.select("name", "text"), candidates, words, hasher, least, block)
    grouped = classes.join(sure, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("lowest"))
    firsts = grouped.join(lowest, "component").select(*names, F.col("lowest.name").alias("first"))
    return each.join(firsts, names).select("name", "first")
