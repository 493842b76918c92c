"""How far sources of a language differ in their words: smoothed shares of all kept terms, compared between all sources.

Terms are counted per language and source, with map-side sums, and numbered within the shards of their language's vocabulary.
The counts of a few sources over one shard make a cell, a row of compressed vectors. Cells stay where they are; in each round
of a tournament every slot of sources meets one other, whose vectors travel to it, and the meeting gives both directions. A
cell's own heaps give each source's foremost terms.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lexmill.llm.common import checkpointed, utf8_view

#: Added to every count, and what shares are of.
SMOOTHING, WHOLE = 5, 1_000_000_000
#: Languages that have kept terms travel to all executors up to so many; of more none has a great share, and they are shuffled.
LANGUAGES = 10_000
#: Terms of a shard, and sources of a slot, about; a language of few sources is dealt over so many slots.
SHARD_TERMS, SLOT_SOURCES, SLOTS = 1 << 15, 32, 8
#: Distinct terms that a task sums up before it passes them on, and bytes of a text that are split at once.
HELD_TERMS, PIECE = 500_000, 1 << 20
#: A sum holds occurrences in its low bits and documents above them.
_DOCUMENT_BIT = 40
_DOCUMENT = 1 << _DOCUMENT_BIT

#: What is no letter becomes a space, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about PIECE bytes."""
    at = 0
    while at < len(raw):
        piece = raw[at : at + PIECE].translate(_FOLD)
        if at + PIECE < len(raw) and piece[-1:] != b" ":  # up to the end of its last term
            end = at + PIECE
            while end < len(raw) and (more := raw[end : end + 256].translate(_FOLD)):
                cut = more.find(b" ")
                piece += more if cut < 0 else more[:cut]
                end += len(more) if cut < 0 else cut
                if cut >= 0:
                    break
            at = end
        else:
            at += PIECE
        yield piece.split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), documents, checkpointed. Null text, lang and source are ''.

    Every group that occurs has a row with the term '', of no occurrences.
    """

    def tell(held: dict[tuple[str, str], dict[bytes, int]]) -> pa.RecordBatch:
        sizes = [len(sums) for sums in held.values()]
        lang, source = (pa.array([group[k] for group in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes))) for k in (0, 1))
        term = pa.array([t for sums in held.values() for t in sums], pa.binary()).cast(pa.string())
        both = np.fromiter((v for sums in held.values() for v in sums.values()), np.int64, sum(sizes))
        return pa.record_batch({"lang": lang, "source": source, "term": term, "n": both & (_DOCUMENT - 1), "documents": both >> _DOCUMENT_BIT})

    def run(batches):
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                own = Counter()
                for piece in words(data[offsets[i] : offsets[i + 1]].tobytes()):
                    own.update(piece)
                sums = held.setdefault(group, {b"": 0})
                before, get = len(sums), sums.get
                for t, n in own.items():
                    sums[t] = get(t, 0) + n + _DOCUMENT
                size += len(sums) - before
                if size > HELD_TERMS:
                    yield tell(held)
                    held, size = {}, 0
        if held:
            yield tell(held)

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    each = plain.mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return checkpointed(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))


def shares(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + SMOOTHING) / (total + SMOOTHING * size)), exactly, a thousandfold at a time."""
    d = np.int64(max(1, total + SMOOTHING * size))
    out, rest = np.divmod(np.asarray(count, np.int64) + SMOOTHING, d)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + more
    return out + 1


_CELL = "lang string, shard long, slot long, width long, vocabulary long, sources array<string>, totals array<long>, sizes array<int>, vectors binary, best array<struct<source:string, term:string, value:long>>"


def pack(foremost: int):
    """Makes the cell of a group of rows: its compressed counts, and the foremost terms of each source by a heap."""

    def run(table: pa.Table) -> pa.Table:
        told = table.filter(pc.is_valid(table.column("roster"))).slice(0, 1).to_pylist()[0]
        rows = table.filter(pc.is_valid(table.column("term")))
        names = [r["source"] for r in told["roster"]]
        index = pc.index_in(rows.column("source"), pa.array(names, pa.string())).to_numpy()
        at, n, total = (rows.column(c).to_numpy() for c in ("at", "n", "total"))
        order = np.lexsort((at, index))
        index, at, n, total = index[order], at[order], n[order], total[order]
        common = shares(total, told["all"], told["vocabulary"])
        ends = np.searchsorted(index, np.arange(len(names) + 1))
        best = []
        for i, group in enumerate(told["roster"]):
            mine = slice(ends[i], ends[i + 1])
            over = shares(n[mine], group["total"], told["vocabulary"]) - common[mine]
            ahead = np.flatnonzero((over > 0) & (n[mine] > 0))
            if len(ahead) > foremost:
                least = -np.partition(-over[ahead], foremost - 1)[foremost - 1]
                ahead = ahead[over[ahead] >= least]
            terms = rows.column("term").take(pa.array(order[mine][ahead])).to_pylist()
            best += [{"source": group["source"], "term": t, "value": -v} for v, t in heapq.nsmallest(foremost, zip((-over[ahead]).tolist(), terms, strict=True))]
        gaps = np.diff(at, prepend=0).astype(np.int32)  # within a source small; from one to the next back to its first
        cell = {"lang": told["lang"], "shard": told["shard"], "slot": told["slot"], "width": told["width"], "vocabulary": told["vocabulary"], "sources": names, "totals": [r["total"] for r in told["roster"]], "sizes": np.diff(ends).tolist(), "vectors": zlib.compress(gaps.tobytes() + n.astype(np.int64).tobytes(), 1), "best": best}
        kinds = {"lang": pa.string(), "shard": pa.int64(), "slot": pa.int64(), "width": pa.int64(), "vocabulary": pa.int64(), "sources": pa.list_(pa.string()), "totals": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "vectors": pa.binary(), "best": pa.list_(pa.struct({"source": pa.string(), "term": pa.string(), "value": pa.int64()}))}
        return pa.table({c: pa.array([v], kinds[c]) for c, v in cell.items()})

    return run


def unpack(width: int, vocabulary: int, totals: list[int], sizes: list[int], vectors: bytes) -> np.ndarray:
    """The shares of all terms of a shard, a row a source."""
    n = sum(sizes)
    raw = zlib.decompress(vectors)
    at, counts = np.cumsum(np.frombuffer(raw, np.int32, n)), np.frombuffer(raw, np.int64, n, 4 * n)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = counts
    for row, total in zip(out, totals, strict=True):
        row[:] = shares(row, total, vocabulary)
    return out


_SIDE = ("sources", "totals", "sizes", "vectors")
_MET = "lang string, source string, item string, value long"


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of differences between each source of a cell and each of its guest's, for both; without a guest, within it."""
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            here = unpack(row["width"], row["vocabulary"], *(row[c] for c in _SIDE[1:]))
            visits = row.get("guest_sources") is not None
            there = unpack(row["width"], row["vocabulary"], *(row[f"guest_{c}"] for c in _SIDE[1:])) if visits else here
            names, others = row["sources"], row["guest_sources"] if visits else row["sources"]
            out = []
            for name, own in zip(names, here, strict=True):
                sums = np.abs(there - own).sum(axis=1).tolist()
                out += [pair for other, v in zip(others, sums, strict=True) if other != name for pair in ([(name, other, v), (other, name, v)] if visits else [(name, other, v)])]
            if out:
                source, item, value = zip(*out, strict=True)
                yield pa.record_batch({"lang": pa.array([row["lang"]] * len(out), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def partner(slot: Column, slots: Column, turn: int) -> Column:
    """Whom a slot meets in a round: all but the last pair up to one sum in a circle, whose odd one out meets the last.

    Of an odd number of slots the last is none, and who meets it rests.
    """
    circle = slots + F.pmod(slots, F.lit(2)) - 1
    across = F.pmod(F.lit(turn) - slot, circle)
    odd = F.pmod(F.lit(turn) * F.floor((circle + 1) / 2), circle)  # twice this is the round's sum
    return F.when(slot == circle, odd).when(across == slot, circle).otherwise(across)


def tournament(cells: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value of all meetings: first within cells, then round by round, each written when it is over."""
    # Kept by the hash of the join's keys, so that only guests are shuffled; a part that is lost is dealt anew from the checkpoint.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hosts = cells.drop("best").repartition(parts, "lang", "shard", "slot").persist(StorageLevel.DISK_ONLY)
    out = checkpointed(hosts.mapInArrow(meet, _MET))
    guests = cells.select("lang", "shard", F.col("slot").alias("_from"), "slots", *(F.col(c).alias(f"guest_{c}") for c in _SIDE))
    for turn in range(most + most % 2 - 1):
        here = guests.where(F.lit(turn) < F.col("slots") + F.pmod(F.col("slots"), F.lit(2)) - 1)
        travel = here.withColumn("slot", partner(F.col("_from"), F.col("slots"), turn)).where("slot < _from").drop("slots")
        out = out.unionByName(checkpointed(hosts.drop("slots").join(travel.hint("merge"), ["lang", "shard", "slot"]).mapInArrow(meet, _MET)))
    hosts.unpersist()
    return out


def build_cells(counts: DataFrame, least: int, foremost: int, shard_terms: int, slot_sources: int) -> DataFrame:
    """The cells of term_counts(), dealt by language, shard and slot, checkpointed; `slots` is how many a language has."""
    kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents")).where(F.col("documents") >= least)
    kept = checkpointed(kept.select("lang", "term", "total"))
    sizes = checkpointed(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("total").alias("all")))
    few = sizes.count() <= LANGUAGES
    shards = F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / shard_terms))
    spread = kept.join(F.broadcast(sizes) if few else sizes, "lang").select("lang", "term", "total", F.pmod(F.xxhash64(F.lit("shard"), "term"), shards).alias("shard"))
    spread = checkpointed(spread.withColumn("at", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1))
    widths = spread.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("width"))
    # Each source's counts of kept terms, and how the sources of a language are dealt.
    found = checkpointed(counts.select("lang", "source", "term", "n").join(spread, ["lang", "term"]))
    groups = counts.where("term = ''").select("lang", "source").join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    many = counts.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    languages = checkpointed(many.join(sizes, "lang", "left").select("lang", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), F.coalesce("all", F.lit(0)).alias("all"), F.greatest(F.least("sources", F.lit(SLOTS)), F.ceil(F.col("sources") / slot_sources)).alias("slots")))
    slot = F.pmod(F.xxhash64(F.lit("slot"), "source"), F.col("slots")).alias("slot")
    roster = groups.join(languages, "lang").select("lang", slot, F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("group"))
    roster = roster.groupBy("lang", "slot").agg(F.array_sort(F.collect_list("group")).alias("roster"))  # about slot_sources of them
    heads = roster.join(languages, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / shard_terms)) - 1)))
    heads = heads.join(widths, ["lang", "shard"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    dealt = languages.select("lang", "slots")
    body = found.join(F.broadcast(dealt) if few else dealt, "lang").select("lang", "shard", slot, "source", "term", "n", "total", F.col("at").cast("long").alias("at"))
    rows = body.unionByName(heads.select("lang", "shard", "slot", "roster", "width", "vocabulary", "all"), allowMissingColumns=True)
    cells = rows.groupBy("lang", "shard", "slot").applyInArrow(pack(foremost), _CELL)
    return checkpointed(cells.join(languages.select("lang", "slots"), "lang"))


def audit(docs: DataFrame, least: int = 30, foremost: int = 50, shard_terms: int = SHARD_TERMS, slot_sources: int = SLOT_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank, as the contract of the source audit says.

    `pair`: every other source of the language by the sum of differences over all kept terms, the greatest first (0 without
    kept terms). `term`: the `foremost` terms that a source has more of than its language. Equal values are in the order of
    items. A term is kept by `least` documents of its language. Null lang and source are those of ''; repeated rows are
    documents of their own; no documents give no rows.
    """
    cells = build_cells(term_counts(docs), least, foremost, shard_terms, slot_sources)
    most = cells.agg(F.max("slots")).first()[0]
    pairs = tournament(cells, most or 1).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = cells.select("lang", F.explode("best").alias("b")).select("lang", "b.source", F.col("b.term").alias("item"), "b.value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")) for part, rows in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= foremost))
