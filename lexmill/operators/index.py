"""A stored positional index of texts: segments of postings that are pruned by token, told by blocks, and merged as they grow.

A segment holds, for every token of a row, the row's id, its length and the places of the token in each column; the token '' is in
all rows and has no places. Postings of one token and block of ids lie in packs, and packs in files by ranges of (token, block),
so that a frequent token is split among files and a prefix is a range; a small table tells the range of each file. A pack says
how many rows it has, how often at most they have the token, and the least length, which bound any score in it. LIKE finds its rows over the vocabulary: its runs of letters or digits are looked for in the
tokens of a segment. A row that comes again, or goes, is dead in the segments that held it. A few segments of one level
are merged to one of the next, so that after n batches about log n are left; numbers of rows and tokens are kept by difference.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import tokens as T
from lexmill.plans.ftsquery import Phrase
from lexmill.schema import complete, remove, versions
from lexmill.storage import checkpoint_dir

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
COLUMNS = ("content", "title")
#: Ids of a block, segments of a level that are merged, bytes of text of a part of postings, and of one at least where there are few.
BLOCK_IDS, FAN, PART_BYTES, LEAST_PART_BYTES = 1024, 4, 8 << 20, 1 << 20
#: Rows whose tokens are sorted at once, and bytes of their text, if a row is no longer; postings of a pack.
GATHERED, GATHERED_BYTES, PACK = 1024, 8 << 20, 64
#: Rows that tell where files end, and those for each file; and packs that are told for each file.
SAMPLE, SAMPLE_OF_PART, MARKS = 4096, 32, 64
#: Blocks that a search reads first; each time it needs more it reads so many times as many, and past the last number all.
FIRST_BLOCKS, MORE_BLOCKS, MOST_BLOCKS = 16, 8, 2048
#: Runs of a pattern that are looked up, the longest; and tokens up to which postings tell the rows of a block.
MOST_RUNS, FEW_TOKENS = 8, 256


def postings(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """id, col, pos (from 0), token for every token of the columns."""
    parts = [rows.select("id", F.lit(c).alias("col"), F.posexplode(T.tokens(F.col(c))).alias("pos", "token")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lengths(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """id, n: the number of tokens of each row."""
    size = F.size(T.tokens(F.col(columns[0])))
    for c in columns[1:]:
        size = size + F.size(T.tokens(F.col(c)))
    return rows.select("id", size.cast("long").alias("n"))


def idf(rows, having) -> Column:
    return F.greatest(F.log((rows - having + 0.5) / (having + 0.5)), F.lit(LEAST_IDF))


def saturated(often: Column, n: Column, mean: float) -> Column:
    """What a term that occurs so often counts in a row of n tokens; it rises with the one and falls with the other."""
    return often * (K1 + 1) / (often + K1 * (1 - B + B * n / F.lit(mean or 1.0)))


@dataclass
class Segment:
    name: str
    level: int
    rows: int
    tokens: int
    parts: int
    dead: list[int] = field(default_factory=list)  # the batches that told dead rows of it


@dataclass
class Index:
    """The segments that a folder's last complete state names."""

    spark: SparkSession
    folder: str
    segments: list[Segment] = field(default_factory=list)
    batch: int = -1
    next: int = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The index of a folder; an empty one if there is none."""
        kept = versions(spark, f"{folder}/state")
        if not kept:
            return cls(spark, folder)
        said = json.loads(spark.read.parquet(f"{folder}/state/version={kept[-1]}/said").first()["said"])
        return cls(spark, folder, [Segment(**s) for s in said["segments"]], said["batch"], said["next"])

    @classmethod
    def build(cls, rows: DataFrame, folder: str, columns: tuple[str, ...] = COLUMNS) -> Index:
        """A new index of rows with an id that no two share; what was in the folder goes."""
        remove(rows.sparkSession, folder)
        return cls(rows.sparkSession, folder).add(rows, columns=columns)

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    @property
    def mean(self) -> float:
        """Tokens of a row, on average."""
        return sum(s.tokens for s in self.segments) / self.rows if self.rows else 0.0

    # Changes.

    def add(self, rows: DataFrame, gone: DataFrame | None = None, batch: int | None = None, columns: tuple[str, ...] = COLUMNS) -> Index:
        """The index with rows added, which supersede those of their ids, and without the rows of the ids (id) that are gone.

        A batch of a number that the index has, does nothing. The state counts once all of it is written.
        """
        if batch is not None and batch <= self.batch:
            return self
        name, ids = f"s{self.next}", rows.select(F.col("id").cast("long").alias("id"))
        ids = ids if gone is None else ids.unionByName(gone.select(F.col("id").cast("long").alias("id")))
        segments = [self._mark(s, ids) for s in self.segments]
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))), F.lit(0)).alias("bytes")).first()
        if size["n"]:
            few = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size["bytes"]) // LEAST_PART_BYTES))
            parts = max(1, few, -(-int(size["bytes"]) // PART_BYTES))
            bounds = _bounds(rows, columns, size["n"], size["bytes"], parts)
            # A block's rows come together, so that a token has few packs; then each pack goes to its file.
            dealt = _in_blocks(rows, columns).repartition(parts, "block").sortWithinPartitions("id")
            packs = _spelled(dealt).mapInArrow(_packs(bounds), f"part int, {_PACKS}")
            segments.append(self._write(name, 0, packs.repartitionById(parts, "part").drop("part"), parts))
        out = Index(self.spark, self.folder, [s for s in segments if s.rows], max(self.batch, -1 if batch is None else batch), self.next + 1)
        while len(same := out._crowded()) >= FAN:
            out = out._merged(same)
        return out._save()

    def _crowded(self) -> list[Segment]:
        levels: dict[int, list[Segment]] = {}
        for s in self.segments:
            levels.setdefault(s.level, []).append(s)
        return max(levels.values(), key=len, default=[])

    def _mark(self, segment: Segment, ids: DataFrame) -> Segment:
        """Writes which living rows of a segment are dead now, and takes them off its numbers."""
        place = f"{self.folder}/dead/{segment.name}/{self.next}"
        self._alive(segment, self._lengths(segment)).join(ids.distinct(), "id", "left_semi").write.mode("overwrite").parquet(place)
        lost = self.spark.read.parquet(place).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        if not lost["rows"]:
            return segment
        return Segment(segment.name, segment.level, segment.rows - lost["rows"], segment.tokens - lost["tokens"], segment.parts, [*segment.dead, self.next])

    def _merged(self, same: list[Segment]) -> Index:
        """The index with segments of one level as one of the next. Texts are not read again, dead rows stay behind."""
        parts = sum(s.parts for s in same)
        packs = _all(self._read(s, "packs") if not s.dead else _packed(self._alive(s, _posts(self._read(s, "packs")))) for s in same)
        segment = self._write(f"s{self.next}", same[0].level + 1, packs.repartitionByRange(parts, "token", "block"), parts)
        return Index(self.spark, self.folder, [*(s for s in self.segments if s not in same), segment], self.batch, self.next + 1)

    def _write(self, name: str, level: int, packs: DataFrame, parts: int) -> Segment:
        """packs: dealt by ranges of token and block."""
        place = f"{self.folder}/segments/{name}"
        packs.sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{place}/packs")
        written = self.spark.read.schema(_PACKS).parquet(f"{place}/packs")
        ends = written.select(F.col("_metadata.file_name").alias("file"), "token").mapInArrow(_ends, _SCHEMAS["ranges"])
        ends.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{place}/ranges")
        out = Segment(name, level, 0, 0, parts)
        total = self._lengths(out).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        out.rows, out.tokens = total["rows"], total["tokens"]
        return out

    def _save(self) -> Index:
        """Writes the state; segments that neither it nor the one before names go, as readers of the one before may be left."""
        kept = versions(self.spark, f"{self.folder}/state")
        place = f"{self.folder}/state/version={kept[-1] + 1 if kept else 0}"
        said = json.dumps({"segments": [vars(s) for s in self.segments], "batch": self.batch, "next": self.next})
        before = {s.name for s in Index.open(self.spark, self.folder).segments}
        self.spark.createDataFrame([(said,)], "said string").coalesce(1).write.mode("overwrite").parquet(f"{place}/said")
        complete(self.spark, place)
        named = before | {s.name for s in self.segments}
        for name in children_of(self.spark, f"{self.folder}/segments"):
            if name not in named:
                remove(self.spark, f"{self.folder}/segments/{name}")
                remove(self.spark, f"{self.folder}/dead/{name}")
        for old in kept[:-1]:
            remove(self.spark, f"{self.folder}/state/version={old}")
        return self

    # Reads.

    def _read(self, segment: Segment, what: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[what]).parquet(f"{self.folder}/segments/{segment.name}/{what}")

    def _blocks(self, segment: Segment) -> DataFrame:
        """token, block, docs, most, least, hits of all packs of tokens; the postings themselves are not read."""
        return self._read(segment, "packs").where("token != ''").select("token", "block", F.col("docs").cast("long").alias("docs"), "most", F.col("least").cast("long").alias("least"), "hits")

    def _lengths(self, segment: Segment) -> DataFrame:
        return self._pruned(segment, {""}, set(), places=False).select("id", "n")

    def _alive(self, segment: Segment, rows: DataFrame) -> DataFrame:
        """Without the rows of dead ids."""
        if not segment.dead:
            return rows
        return rows.join(self.spark.read.schema(_SCHEMAS["lengths"]).parquet(*(f"{self.folder}/dead/{segment.name}/{k}" for k in segment.dead)).select("id"), "id", "left_anti")

    def _files(self, segment: Segment, words: Iterable[str], prefixes: Iterable[str]) -> list[str]:
        """The files of postings whose range may hold one of the words, or a token that begins with one of the prefixes."""
        some = F.lit(False)
        for low, high in [(w, w) for w in words] + [(p, p + "\U0010ffff") for p in prefixes]:
            some = some | ((F.col("first") <= high) & (F.col("last") >= low))
        place = f"{self.folder}/segments/{segment.name}/packs"
        return [f"{place}/{r['file']}" for r in self._read(segment, "ranges").where(some).select("file").collect()]  # names alone

    def _pruned(self, segment: Segment, words: set[str], prefixes: set[str], places: bool = True) -> DataFrame:
        files = self._files(segment, words, prefixes)
        packs = self.spark.read.schema(_PACKS).parquet(*files) if files else self.spark.createDataFrame([], _PACKS)
        return _posts(packs.where(_said(words, prefixes)), places)

    def matching(self, words: set[str], prefixes: set[str] = frozenset(), places: bool = True) -> DataFrame:
        """token, id, n, often, block and, with places, content, title: living postings of words and of tokens that begin with a prefix."""
        if not self.segments:
            return _posts(self.spark.createDataFrame([], _PACKS), places)
        return _all(self._alive(s, self._pruned(s, words, prefixes, places)) for s in self.segments)

    def counted(self, phrases: list[Phrase]) -> tuple[DataFrame, dict[Phrase, Column]]:
        """id, _n and a count for each phrase, for all rows that hold a token of one; and the counts' columns.

        Postings meet by id; a phrase is where the places of its words, each set back by its turn, are the same.
        """
        pairs = list(dict.fromkeys((w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)))
        posts = self.matching({w for w, x in pairs if not x}, {w for w, x in pairs if x}, any(len(p.words) > 1 for p in phrases))
        slots = {}
        for i, (w, x) in enumerate(pairs):
            fits = F.col("token").startswith(w) if x else F.col("token") == w
            slots[w, x] = {c: F.flatten(F.collect_list(F.when(fits, F.col(c)))).alias(f"_{c[0]}{i}") for c in COLUMNS} | {"n": F.coalesce(F.sum(F.when(fits, F.col("often"))), F.lit(0)).alias(f"_s{i}")}
        number = {pair: i for i, pair in enumerate(pairs)}
        long = {(w, p.prefix and k == len(p.words) - 1) for p in phrases if len(p.words) > 1 for k, w in enumerate(p.words)}
        single = {(p.words[0], p.prefix) for p in phrases if len(p.words) == 1}
        rows = posts.groupBy("id").agg(F.max("n").alias("_n"), *(slots[s][c] for s in slots if s in long for c in COLUMNS), *(slots[s]["n"] for s in slots if s in single))

        def count(phrase: Phrase) -> Column:
            own = [number[w, phrase.prefix and k == len(phrase.words) - 1] for k, w in enumerate(phrase.words)]
            if len(own) == 1:
                return F.col(f"_s{own[0]}")
            total = F.lit(0)
            for c in COLUMNS:
                places = F.col(f"_{c[0]}{own[0]}")
                for k, i in enumerate(own[1:], 1):
                    places = F.array_intersect(places, _back(F.col(f"_{c[0]}{i}"), k))
                total = total + F.size(places)
            return total

        names = {p: f"_f{i}" for i, p in enumerate(phrases)}
        told = rows.select("id", "_n", *((count(p) if p.words else F.lit(0)).cast("long").alias(n) for p, n in names.items()))
        return told, {p: F.col(n) for p, n in names.items()}

    def dictionary(self) -> DataFrame:
        """token, rows, hits: living rows with each token, and how often they have it."""
        living = lambda s: self._alive(s, _posts(self._read(s, "packs").where("token != ''"), False))
        parts = [self._blocks(s).select("token", "docs", "hits") if not s.dead else living(s).select("token", F.lit(1).cast("long").alias("docs"), F.col("often").cast("long").alias("hits")) for s in self.segments]
        return (_all(parts) if parts else self.spark.createDataFrame([], "token string, docs long, hits long")).groupBy("token").agg(F.sum("docs").alias("rows"), F.sum("hits").alias("hits"))

    def having(self, words: list[str]) -> dict[str, int]:
        """How many living rows have each word; of a segment without dead rows its blocks tell."""
        parts = []
        for s in self.segments:
            clean = self._blocks(s).where(F.col("token").isin(*words)).select("token", "docs")
            parts.append(clean if not s.dead else self._alive(s, self._pruned(s, set(words), set(), False)).select("token", F.lit(1).cast("long").alias("docs")))
        found = _all(parts).groupBy("token").agg(F.sum("docs").alias("n")).collect() if parts else []  # a row a word
        return {w: 0 for w in words} | {r["token"]: r["n"] for r in found}

    def _weight(self, having: dict[str, int]) -> Column:
        return F.element_at(F.create_map(*(x for w, n in having.items() for x in (F.lit(w), idf(F.lit(float(self.rows)), F.lit(float(n)))))), F.col("token"))

    def _scored(self, posts: DataFrame, words: list[str], weight: Column, every: bool) -> DataFrame:
        part = weight * saturated(F.col("often"), F.col("n"), self.mean)
        scored = posts.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.round(-F.sum(part), 6).alias("relevance"))
        return (scored.where(F.col("words") == len(words)) if every else scored).select("id", "relevance")

    def ranked(self, words: list[str], every: bool = False) -> DataFrame:
        """id, relevance of all rows with any (or every) of the words, by BM25."""
        words = list(dict.fromkeys(words))
        return self._scored(self.matching(set(words), places=False), words, self._weight(self.having(words)), every)

    def top(self, words: list[str], k: int, every: bool = False, among: DataFrame | None = None) -> tuple[DataFrame, int]:
        """id, relevance of the k best rows with any (or every) of the words, by BM25; and how many blocks were read.

        Blocks are read in the order of what a row in them can score at most, until the k-th best scores better than any row
        in what is left. Ties go by id. `among` (id) bounds the rows that count; the words' weights are those of the whole.
        """
        words = list(dict.fromkeys(words))
        nothing = self.spark.createDataFrame([], "id long, relevance double")
        having = self.having(words)
        if not self.segments or not any(having.values()):
            return nothing, 0
        weight, mean = self._weight(having), self.mean
        told = _all(self._blocks(s).where(F.col("token").isin(*words)) for s in self.segments)
        # What a word counts at most in a block, whatever segments and pieces have it there.
        each = told.groupBy("block", "token").agg(F.max("most").alias("most"), F.min("least").alias("least"))
        bounds = each.groupBy("block").agg(F.sum(weight * saturated(F.col("most"), F.col("least"), mean)).alias("bound"), F.count(F.lit(1)).alias("words"))
        bounds = bounds.where(F.col("words") == len(words)) if every else bounds
        checkpoint_dir(self.spark)
        bounds = bounds.checkpoint()
        many, take = bounds.count(), FIRST_BLOCKS
        while True:
            best = bounds.orderBy(F.desc("bound"), "block").limit(take + 1).collect()  # MOST_BLOCKS at most
            whole = take >= many or take > MOST_BLOCKS
            posts = self.matching(set(words), places=False)
            posts = posts if whole else posts.where(F.col("block").isin([r["block"] for r in best[:take]]))
            scored = self._scored(posts, words, weight, every)
            scored = scored if among is None else scored.join(among.select("id"), "id", "left_semi")
            found = scored.orderBy("relevance", "id").limit(k).collect()  # k
            if whole or len(found) == k and -found[-1]["relevance"] > best[take]["bound"] + 1e-6:
                return self.spark.createDataFrame([tuple(r) for r in found], "id long, relevance double"), min(take, many) if not whole else many
            take = take * MORE_BLOCKS

    def _holding(self, segment: Segment, runs: list[str]) -> DataFrame:
        """run (its turn), token: the tokens of a segment that hold each run."""
        every = self._blocks(segment).select("token").distinct()
        held = F.array_compact(F.array(*(F.when(F.contains("token", F.lit(run)), F.lit(i)) for i, run in enumerate(runs))))
        return every.select(F.explode(held).alias("run"), "token")

    def like(self, rows: DataFrame, pattern: str, fits: Column, k: int, among: DataFrame | None = None) -> tuple[list[int], int] | None:
        """The k least ids of `rows` whose text fits a LIKE pattern, as `fits` tells of a row, and how many blocks were read.

        What the pattern says in ASCII letters and digits stands within tokens, so that only blocks with a token for each run
        can have a row that fits. They are read in the order of ids until k rows are found, and of them only the rows of those
        tokens where these are few. `among` (id) bounds the rows that count. None if the pattern has no run of two.
        """
        runs = sorted({r.lower() for r in re.findall("[0-9A-Za-z]{2,}", pattern)}, key=lambda r: (-len(r), r))[:MOST_RUNS]
        if not runs:
            return None
        if not self.segments:
            return [], 0
        checkpoint_dir(self.spark)
        whole, every = (1 << len(runs)) - 1, _all(self._holding(s, runs).withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)).checkpoint()
        held = [every.where(F.col("segment") == i).select("run", "token") for i in range(len(self.segments))]

        def all_runs(found: DataFrame, key: str) -> DataFrame:
            bits = F.bit_or(F.expr("shiftleft(1, run)"))
            return found.groupBy(key).agg(bits.alias("_runs")).where(F.col("_runs") == whole).select(key)

        blocks = _all(all_runs(self._blocks(s).select("token", "block").join(h, "token"), "block") for s, h in zip(self.segments, held)).distinct().checkpoint()
        told = every.select("segment", "token").distinct().limit(FEW_TOKENS + 1).collect()
        few, words = len(told) <= FEW_TOKENS, [{r["token"] for r in told if r["segment"] == i} for i in range(len(self.segments))]
        found, read, last, take = [], 0, None, FIRST_BLOCKS
        while True:
            left = blocks if last is None else blocks.where(F.col("block") > last)
            # MOST_BLOCKS at most; what is left beyond them is read at once, and not listed.
            listed = [r["block"] for r in left.orderBy("block").limit(take).collect()] if take <= MOST_BLOCKS else None
            if listed == [] or few and not told:
                return found, read
            if listed is None:
                here = rows.withColumn("block", F.floor(F.col("id") / BLOCK_IDS)).join(left, "block", "left_semi").drop("block")
            else:
                here = rows.where(F.col("id").between(listed[0] * BLOCK_IDS, (listed[-1] + 1) * BLOCK_IDS - 1) & F.floor(F.col("id") / BLOCK_IDS).isin(listed))
            if few:
                inside = F.col("block").isin(listed) if listed is not None else F.lit(True)
                ids = _all(all_runs(self._alive(s, self._pruned(s, w, set(), False).where(inside)).select("token", "id").join(h, "token"), "id") for s, h, w in zip(self.segments, held, words) if w)
                here = here.join(ids, "id", "left_semi")
            here = here.where(fits).select("id")
            here = here if among is None else here.join(among.select("id"), "id", "left_semi")
            found += [r["id"] for r in here.orderBy("id").limit(k - len(found)).collect()]  # k at most
            if listed is None:
                return found, blocks.count()
            read, last = read + len(listed), listed[-1]
            if len(found) >= k or len(listed) < take:
                return found, read
            take *= MORE_BLOCKS


#: A pack: ids of rows, tokens of each row, how often it has this one, and its places one row after the other: from 0 in the first
#: column, and from -1 down in the second.
_PACKS = "token string, block long, ids array<long>, n array<int>, often array<int>, places array<int>, docs int, most int, least int, hits long"
_SCHEMAS = {"packs": _PACKS, "lengths": "id long, n long", "ranges": "file string, first string, last string"}


def _posts(packs: DataFrame, places: bool = True) -> DataFrame:
    """token, block, id, n, often and, with places, content, title: a row for each posting of packs."""
    n = F.col("n").cast("long").alias("n")
    if not places:
        each = F.inline(F.arrays_zip(F.col("ids").alias("id"), "n", "often")).alias("id", "n", "often")
        return packs.select("token", "block", each).select("token", "block", "id", n, "often")
    begin = F.aggregate("often", F.array(F.lit(0)), lambda all, x: F.concat(all, F.array(F.element_at(all, -1) + x)))
    each = F.transform("ids", lambda id, i: F.struct(id.alias("id"), F.get("n", i).alias("n"), F.get("often", i).alias("often"), F.slice("places", F.get("begin", i) + 1, F.get("often", i)).alias("places")))
    content, title = F.filter("places", lambda x: x >= 0), F.transform(F.filter("places", lambda x: x < 0), lambda x: -1 - x)
    rows = packs.withColumn("begin", begin).select("token", "block", F.inline(each))
    return rows.select("token", "block", "id", n, "often", content.alias("content"), title.alias("title"))


def _packed(posts: DataFrame) -> DataFrame:
    """Packs of postings, for those that lost rows: one for each token and so many ids of a block."""
    places = F.concat("content", F.transform("title", lambda x: -1 - x)).alias("places")
    own = F.struct("id", F.col("n").cast("int").alias("n"), "often", places)
    packs = posts.groupBy("token", "block", F.floor(F.col("id") / PACK)).agg(F.sort_array(F.collect_list(own)).alias("p"))  # PACK at most
    hits = F.aggregate("p.often", F.lit(0).cast("long"), lambda total, y: total + y)
    lists = (F.col("p.id").alias("ids"), F.col("p.n").alias("n"), F.col("p.often").alias("often"), F.flatten("p.places").alias("places"))
    return packs.select("token", "block", *lists, F.size("p").alias("docs"), F.array_max("p.often").alias("most"), F.array_min("p.n").alias("least"), hits.alias("hits"))


def _in_blocks(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """id, block, and the two columns that an index tells apart; a sole column is the first."""
    id = F.col("id").cast("long")
    return rows.select(id.alias("id"), F.floor(id / BLOCK_IDS).alias("block"), F.col(columns[0]).alias("one"), (F.col(columns[1]) if len(columns) > 1 else F.lit("")).alias("two"))


def _spelled(rows: DataFrame) -> DataFrame:
    """id, block, both texts as one, and where (in bytes) the first ends."""
    each = rows.select("id", "block", T.spelled(F.col("one")).alias("one"), T.spelled(F.col("two")).alias("two"))
    return each.select("id", "block", F.octet_length("one").alias("cut"), F.concat("one", F.lit("\n"), "two").alias("said"))


def _bounds(rows: DataFrame, columns: tuple[str, ...], many: int, size: int, parts: int) -> list[tuple[str, int]]:
    """Where (token, block) files but the first begin, so that they have about as many postings each. A sample tells; whatever it
    tells, all postings lie in order."""
    if parts == 1:
        return []
    few = max(SAMPLE, SAMPLE_OF_PART * parts)
    share = min(1.0, few / many)
    some = rows if share == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(many)) < few)
    step = max(1, int(size * share) // (8 * MARKS * parts))
    marks = sorted(tuple(r) for r in _spelled(_in_blocks(some, columns)).mapInArrow(_marks(step), "token string, block long, times long").collect())  # about MARKS a part
    ends = np.cumsum([t for *_, t in marks])
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts) if marks else []
    return sorted({marks[i][:2] for i in cuts})


def _blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of postings of one token and block; postings come in the order of token and id."""
    for batch in batches:
        token, block, often, n = batch.columns
        block, often, n = (c.to_numpy(zero_copy_only=False) for c in (block, often, n))
        if not len(n):
            continue
        other = pc.not_equal(token.slice(1), token.slice(0, len(n) - 1)).to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.concatenate([[True], other | (block[1:] != block[:-1])]))
        most, least, hits = np.maximum.reduceat(often, head), np.minimum.reduceat(n, head), np.add.reduceat(often.astype(np.int64), head)
        yield pa.record_batch({"token": token.take(pa.array(head)), "block": block[head], "docs": np.diff(np.append(head, len(n))), "most": most.astype(np.int32), "least": least, "hits": hits})


#: Bytes of tokens, as `spelled` leaves a text.
_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, cut between blocks where that may be."""
    sizes = pc.binary_length(batch.column("said")).to_numpy(zero_copy_only=False)
    ends, block = np.cumsum(sizes.astype(np.int64)), batch.column("block").to_numpy(zero_copy_only=False)
    begin, many = 0, batch.num_rows
    while begin < many:
        most = int(np.searchsorted(ends, ends[begin] - sizes[begin] + GATHERED_BYTES, side="right"))
        end = max(begin + 1, min(most, begin + GATHERED, many))
        if end < many and (other := np.flatnonzero(block[begin + 1 : end + 1] != block[begin:end])).size:
            end = begin + 1 + int(other[-1])
        yield batch.slice(begin, end - begin)
        begin = end


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _gather(piece: pa.RecordBatch) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """The tokens of a piece in order, the first of them '', and its packs in the order of token and block."""
    ids, block, cut = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("id", "block", "cut"))
    said, rows = piece.column("said").cast(pa.large_binary()), piece.num_rows
    off = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + rows + 1]
    data = np.frombuffer(said.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    # Tokens, as they come: where they begin, and their letters alone.
    word = _WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[off[:-1]] = word[off[:-1]]  # no text is without its line end
    at = np.flatnonzero(begins)
    letters = data[word]
    token = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(np.cumsum(word)[at] - 1, len(letters)).astype(np.int64)), pa.py_buffer(letters))
    first = np.searchsorted(at, off)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    title = at - off[row] > cut[row]
    place = np.arange(len(at)) - first[row]
    place = np.where(title, np.bincount(row[~title], minlength=rows)[row] - 1 - place, place).astype(np.int32)
    coded = token.dictionary_encode()
    words, code = _ordered(coded.dictionary)
    code = code[coded.indices.to_numpy()]
    # By token, and within it as they come, which is by row and place.
    order = np.sort(code * max(1, len(at)) + np.arange(len(at))) % max(1, len(at))
    code, row, place = code[order], row[order], place[order]
    head = _heads(code, row)
    often = np.diff(np.append(head, len(code)))
    # Postings, those of '' first.
    none = np.zeros(rows, np.int64)
    code, row, often = np.concatenate([none, code[head]]), np.concatenate([np.arange(rows), row[head]]), np.concatenate([none, often])
    group = _heads(code, block[row])
    inside = np.arange(len(code)) - np.repeat(group, np.diff(np.append(group, len(code))))
    starts = np.flatnonzero(inside % PACK == 0)
    pack = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
    bounds = np.append(starts, len(code))
    made = {"code": code[starts], "block": block[row[starts]]}

    def lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))

    made |= {"ids": lists(bounds, ids[row]), "n": lists(bounds, n[row].astype(np.int32)), "often": lists(bounds, often.astype(np.int32)), "places": lists(_runs(often)[bounds], place)}
    (told,) = _blocked([pa.record_batch({"token": code, "block": pack, "often": often, "n": n[row]})])
    return words, made | {c: told.column(c).cast(pa.int64() if c == "hits" else pa.int32()) for c in ("docs", "most", "least", "hits")}


def _ordered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """'' and the words without diacritics, in order and each once; and for each given word its turn there."""
    marked = pc.invert(pc.string_is_ascii(words))
    plain = pc.replace_with_mask(words, marked, pa.array([T.plain(w) for w in words.filter(marked).to_pylist()], words.type)).dictionary_encode()
    order = pc.array_sort_indices(plain.dictionary).to_numpy()
    turn = np.zeros(len(order), np.int64)
    turn[order] = np.arange(1, len(order) + 1)
    return pa.concat_arrays([pa.array([""]), plain.dictionary.take(pa.array(order)).cast(pa.string())]), turn[plain.indices.to_numpy()]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    other = np.ones(len(keys[0]), bool)
    other[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(other)


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last token of what a batch has of a file; they come in order."""
    for batch in batches:
        if many := batch.num_rows:
            file, token = batch.columns
            head = np.flatnonzero(np.append(True, pc.not_equal(file.slice(1), file.slice(0, many - 1)).to_numpy(zero_copy_only=False)))
            yield pa.record_batch({"file": file.take(pa.array(head)), "first": token.take(pa.array(head)), "last": token.take(pa.array(np.append(head[1:], many) - 1))})


def _packs(bounds: list[tuple[str, int]]) -> Callable:
    """Packs of the rows of a task, each with the file that it goes to: files but the first begin at these bounds."""

    def packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                words, made = _gather(piece)
                code, block = made.pop("code"), made["block"]
                begin, after = [], np.searchsorted(code, np.arange(len(words) + 1))
                for w, b in bounds:
                    k = bisect_left(range(len(words)), w, key=lambda i: words[i].as_py())
                    same = k < len(words) and words[k].as_py() == w
                    begin.append(after[k] + (np.searchsorted(block[after[k] : after[k + 1]], b) if same else 0))
                part = np.searchsorted(np.array(begin, np.int64), np.arange(len(code)), side="right").astype(np.int32)
                yield pa.record_batch({"part": part, "token": words.take(pa.array(code)), **made})

    return packs


def _marks(step: int) -> Callable:
    """Packs at every so many postings, and how many such steps each makes."""

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                words, made = _gather(piece)
                times = np.diff((_runs(made["docs"].to_numpy()) + step // 2) // step)
                some = np.flatnonzero(times)
                yield pa.record_batch({"token": words.take(pa.array(made["code"][some])), "block": made["block"][some], "times": times[some]})

    return marks


def _back(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def _said(words: set[str], prefixes: set[str]) -> Column:
    some = F.col("token").isin(*words) if words else F.lit(False)
    for p in sorted(prefixes):
        some = some | F.col("token").startswith(p)
    return some


def _all(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def children_of(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [p.getPath().getName() for p in files.listStatus(path)] if files.exists(path) else []

