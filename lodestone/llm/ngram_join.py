"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1. Words are runs without white space, A-Z lower-cased; a document's set holds
   64-bit hashes of its distinct word k-grams (all words as one when fewer).
2. Shingle counts of all documents, in a table of fixed size indexed by part of
   the hash, give one order for all sets: rare first.  The order steers only
   the cost, any order gives the same links.
3. The prefix of a set of n is its first n - ceil(t n) + 1 shingles: two sets
   of similarity t share one.  Documents with equal prefixes and sizes form one
   group; each prefix shingle has the list of groups that hold it.
4. Groups of a list are compared by size and by how many shingles can still be
   shared from their positions on; what passes is expanded to the groups'
   distinct sets.  Parity bitmaps bound how much two sets differ from below and
   refuse most false pairs; the rest are verified by intersection.
5. Links are wanted for components, so pairs already joined need no
   verification: at first each list is compared with a few pivots only, then all
   that are in different components still are compared.  No list is cut.

Null or empty texts and texts without words have empty sets, n_shingles 0, and
are linked with nothing.  Equal texts, repeated rows and repeated ids are fine:
a row's component_id is the smallest id of any row that its set reaches.  Rows
with a null id count as others do but give no component_id of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, slices, texts_of
from lodestone.llm.components import components

#: Slots of the count table, and in how many pieces it is summed.
SLOT_BITS, PIECES = 23, 32
SLOTS = 1 << SLOT_BITS
#: Tasks whose counts are summed together before.
TOGETHER = 64
#: Bits of a set's parity bitmap.
BITS = 1024
#: Lists up to this size are compared throughout; the others by pivots first.
SMALL_LIST = 48
#: Of a set's large lists so many are remembered, so that a pair comes up in one of them only.
REMEMBERED_LISTS = 32
#: Sets of a list's largest component that its other sets are compared with, before all of them are.
PIVOTS = 16
#: Ids of wanted documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTES[_SPACE] = 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MULT
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Similarity:
    """Sets of word k-grams are alike when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n + (-self.percent * n // 100) + 1

    def alike(self, shared: Column, n_a: Column, n_b: Column) -> Column:
        return F.lit(100) * shared >= F.lit(self.percent) * (n_a + n_b - shared)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and at which of them each text begins (and the last ends)."""
    encoded = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    begins = np.cumsum([0, *(len(x) + 1 for x in encoded)])
    cuts = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), cuts
    data = data[starts[0] :]
    starts = starts - starts[0]
    gaps = np.diff(starts, append=len(data))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(gaps.max()), _MULT)]))
    place = np.arange(len(data)) - np.repeat(starts, gaps)
    return _mixed(np.add.reduceat(_BYTES[data] * powers[place], starts)), cuts


def shingles(texts: list[str], k: int) -> list[np.ndarray]:
    """Hashes of the word k-grams of each text, in order and with repetitions."""
    words, cuts = word_hashes(texts)
    grams = words
    for i in range(1, k):
        grams = _mixed(grams[:-1] * _MULT + words[i:]) if len(grams) > 1 else grams[:0]
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(grams[a : b - k + 1])
        elif b > a:
            whole = words[a : a + 1]
            for i in range(a + 1, b):
                whole = _mixed(whole * _MULT + words[i : i + 1])
            out.append(_mixed(whole + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counts_row(key: list, counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Counts as a byte for each slot, and the rest of those that need more."""
    large = np.flatnonzero(counts > 255)
    rest = np.stack([large, counts[large].astype(np.int64) - 255]).astype("<i8").tobytes()
    return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([np.minimum(counts, 255).astype(np.uint8).tobytes() + rest], pa.binary())], names)


def shingle_levels(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """For each slot how often its shingles occur in all documents, as steps of a logarithm (SLOTS numbers, whatever the input).

    Tasks are summed in groups of TOGETHER first, so that few tables meet in the PIECES tasks that sum all.
    """
    size = SLOTS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int32 if SLOTS > 1 << 16 else np.int64)
        for batch in slices(batches):
            slots = _slot(np.concatenate(shingles(texts_of(batch[0]), k)))
            np.add.at(counts, slots, 1)
        group = TaskContext.get().partitionId() // TOGETHER
        for i in range(PIECES):
            piece = counts[i * size : (i + 1) * size]
            if piece.any():
                yield _counts_row([i, group], piece, ["piece", "together", "counts"])

    def sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total = out.setdefault(piece, np.zeros(size, np.int64))
                total += np.frombuffer(counts, np.uint8, size)
                large, more = np.frombuffer(counts, "<i8", offset=size).reshape(2, -1)
                total[large] += more
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, counts in sums(batches).items():
            yield _counts_row([piece], counts, ["piece", "counts"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, counts in sums(batches).items():
            levels = np.round(4 * np.log2(counts + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["piece", "counts"])

    kind = "piece int, counts binary"
    grouped = docs.select(text_col).mapInArrow(count, "piece int, together int, counts binary").repartition("piece", "together").mapInArrow(add, kind)
    levels = np.zeros(SLOTS, np.uint8)
    for piece, counts in grouped.repartition(PIECES, "piece").mapInArrow(level, kind).collect():
        levels[piece * size : (piece + 1) * size] = np.frombuffer(counts, np.uint8)
    return levels


def _digest(*arrays: np.ndarray) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for x in arrays:
        h.update(x.tobytes())
    return h.digest()


def parities(found: np.ndarray) -> np.ndarray:
    """BITS bits as longs: of each residue whether an odd number of hashes has it.  Two sets differ in as many members at least as their bits do."""
    odd = (np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def prefixes(docs: DataFrame, id_col: str, text_col: str, sim: Similarity, levels: np.ndarray) -> DataFrame:
    """(id, mark, n, own, grp, bits, prefix): own names the set, grp its prefix and size; all null for empty sets."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "mark", "n", "own", "grp", "bits", "prefix"]
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for grams in shingles(texts_of(batch[2]), sim.words):
                found = np.unique(grams)
                n = len(found)
                if not n:
                    rows.append((0, None, None, None, None))
                    continue
                order = np.argsort(levels[_slot(found)], kind="stable")
                prefix = found[order[: sim.prefix(n)]].view(np.int64)
                rows.append((n, _digest(found), _digest(prefix, np.array([n])), parities(found), prefix))
            n, own, group, bits, prefix = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(n, pa.int32()), pa.array(own, pa.binary()), pa.array(group, pa.binary()), pa.array(bits, longs), pa.array(prefix, longs)], names)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, mark long, n int, own binary, grp binary, bits array<long>, prefix array<long>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, sim: Similarity, wanted: DataFrame) -> DataFrame:
    """(own, shingles) of the documents whose ids are in wanted (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(g) for g in shingles(texts_of(batch[0]), sim.words)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["own", "shingles"])

    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("d")
    rows = rows.join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")), "left_semi").select("text")
    return rows.mapInArrow(run, "own binary, shingles array<long>")


def set_lists(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(list, own, n, pos): for each prefix shingle of two groups at least the sets that hold it; for each group of two sets at least these."""
    groups = rows.where("n > 0").groupBy("grp").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    groups = scratch.write(groups.withColumn("g", F.monotonically_increasing_id()))  # a short name, fixed by writing it
    shared = groups.select(F.explode("prefix").alias("list")).groupBy("list").agg(F.count("*").alias("groups")).where("groups > 1").select("list")
    held = groups.select("g", "n", F.posexplode("prefix").alias("pos", "list")).join(shared, "list")
    members = rows.where("n > 0").groupBy("own").agg(F.any_value("grp").alias("grp"), F.any_value("n").alias("n"))
    members = scratch.write(members.join(groups.select("grp", "g"), "grp").select("own", "g", "n"))
    crowded = members.groupBy("g").agg(F.count("*").alias("sets")).where("sets > 1").select("g")
    within = members.join(crowded, "g").select(F.xxhash64("g").alias("list"), "own", "n", F.lit(0).alias("pos"))
    across = held.join(members.select("g", "own"), "g").select("list", "own", "n", "pos")
    lists = scratch.write(across.unionByName(within))
    scratch.drop(groups)
    return lists


class Linker:
    """Finds the components of the sets in lists: (list, own, n, pos)."""

    def __init__(self, scratch: Scratch, lists: DataFrame, rows: DataFrame, sim: Similarity, sets_for):
        """rows: with own and bits; sets_for(wanted): (own, shingles) of the wanted (own)."""
        self.scratch, self.sim, self.sets_for = scratch, sim, sets_for
        held = lists.select("own").distinct()
        # Copies are put together before the join, so that none of their sets fills a task.
        self.bits = scratch.write(rows.groupBy("own").agg(F.any_value("bits").alias("bits")).join(held, "own", "left_semi"))
        sized = lists.join(lists.groupBy("list").agg(F.count("*").alias("size")), "list")
        self.small = sized.where(F.col("size") <= SMALL_LIST).drop("size")
        # With each row of a large list the first of its set's large lists before this one: a pair that shares one of these has come up there.
        ordered = sized.where(F.col("size") > SMALL_LIST).groupBy("own", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "list"))).alias("lists"))
        head = F.transform(F.slice("lists", 1, REMEMBERED_LISTS), lambda x: x["list"])
        large = ordered.select("own", "n", head.alias("head"), F.posexplode("lists").alias("nth", "l"))
        self.large = scratch.write(large.select("l.list", "own", "n", "l.pos", F.slice("head", 1, F.least(F.col("nth"), F.lit(REMEMBERED_LISTS))).alias("before")))
        self.links: list[DataFrame] = []

    def near(self) -> Column:
        """Whether sizes and positions of a row and an o_ row of one list allow similarity."""
        n, o_n = F.col("n"), F.col("o_n")
        rest = F.least(n - F.col("pos"), o_n - F.col("o_pos"))
        sizes = F.lit(100) * F.least(n, o_n) >= F.lit(self.sim.percent) * F.greatest(n, o_n)
        return sizes & self.sim.alike(rest, n, o_n)

    def fits(self, bits: str, o_bits: str, n: str, o_n: str) -> Column:
        """Whether the bitmaps allow similarity: shared = (sizes - difference) / 2, and the bits differ in as many at most."""
        differ = F.aggregate(F.zip_with(bits, o_bits, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = F.col(n) + F.col(o_n)
        return F.lit(100) * (both - differ) >= F.lit(self.sim.percent) * (both + differ)

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (own, o_own, n, o_n) whose bitmaps allow similarity."""
        side = lambda name: self.bits.select(F.col("own").alias(f"{name}own"), F.col("bits").alias(f"{name}bits"))
        return pairs.join(side(""), "own").join(side("o_"), "o_own").where(self.fits("bits", "o_bits", "n", "o_n")).select("own", "o_own")

    def verify(self, pairs: DataFrame) -> None:
        """Keep those of the pairs (own, o_own) that are alike as links."""
        pairs = self.scratch.write(pairs.select(F.least("own", "o_own").alias("a"), F.greatest("own", "o_own").alias("b")).distinct())
        if pairs.isEmpty():
            return
        wanted = pairs.select(F.col("a").alias("own")).unionAll(pairs.select(F.col("b").alias("own"))).distinct()
        sets = self.scratch.write(self.sets_for(wanted))
        side = lambda name: sets.select(F.col("own").alias(name), F.col("shingles").alias(f"{name}_set"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        shared = F.size(F.array_intersect("a_set", "b_set"))
        self.links.append(self.scratch.write(both.where(self.sim.alike(shared, F.size("a_set"), F.size("b_set"))).select("a", "b")))
        self.scratch.drop(sets)

    def roots(self) -> DataFrame | None:
        """(own, root) by the links so far."""
        if not self.links:
            return None
        return components(self.scratch, reduce(DataFrame.unionAll, self.links)).withColumnRenamed("node", "own")

    @staticmethod
    def others(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("list", *(F.col(c).alias(f"o_{c}") for c in ("own", "n", "pos", *more)))

    def all_of_small(self) -> DataFrame:
        """All pairs of the small lists."""
        pairs = self.small.join(self.others(self.small), "list").where((F.col("own") < F.col("o_own")) & self.near())
        return self.fitting(pairs.select("own", "o_own", "n", "o_n").distinct())

    def pivots_of_large(self) -> DataFrame:
        """Pairs of every set of a large list with the smallest, the largest and one other."""
        me = F.struct("n", "own", "pos", "before")
        chosen = self.large.groupBy("list").agg(F.min(me).alias("p0"), F.max(me).alias("p1"), F.min_by(me, F.xxhash64("own", "list")).alias("p2"))
        chosen = chosen.select("list", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("p")).select("list", "p.*")
        first = (F.col("own") != F.col("o_own")) & ~F.arrays_overlap("before", "o_before")
        pairs = self.large.join(self.others(chosen, "before"), "list").where(first & self.near())
        return self.fitting(pairs.select("own", "o_own", "n", "o_n"))

    def zone(self, n: str) -> Column:
        """Sizes of sets that may be alike are in the same zone or in zones next to each other."""
        return F.floor(F.log(F.col(n).cast("double")) / F.lit(1.001 * math.log(100 / self.sim.percent))).cast("int")

    def apart(self, pivots: int | None) -> DataFrame:
        """Pairs of different components, of large lists that hold several: sets outside the list's largest component with about so many of that (None: all).

        Only sets of near sizes meet.
        """
        found = self.roots()
        if found is None:
            rooted = self.large.withColumn("root", F.col("own"))
        else:
            rooted = self.large.join(found, "own", "left").withColumn("root", F.coalesce("root", "own"))
        sizes = rooted.groupBy("list", "root").agg(F.count("*").alias("rows"))
        main = sizes.groupBy("list").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.max("rows").alias("rows"), F.count("*").alias("roots")).where("roots > 1")
        rows = self.scratch.write(rooted.join(main.select("list", "main", "rows"), "list").join(self.bits, "own").withColumn("zone", self.zone("n")))
        outside = rows.where("root != main").drop("rows")
        inside = rows
        if pivots is not None:  # by chance more or fewer, or none: the others are compared later
            inside = rows.where("root = main").where(F.pmod(F.xxhash64("own", "list"), F.col("rows")) < pivots)
        inside = inside.withColumn("zone", F.explode(F.array(F.col("zone") - 1, F.col("zone"), F.col("zone") + 1)))
        test = self.near() & (F.col("root") != F.col("o_root")) & ~F.arrays_overlap("before", "o_before") & self.fits("bits", "o_bits", "n", "o_n")
        others = inside.select("list", "zone", *(F.col(c).alias(f"o_{c}") for c in ("own", "n", "pos", "before", "bits", "root")))
        return outside.join(others, ["list", "zone"]).where(test).select("own", "o_own")

    def run(self) -> DataFrame | None:
        """(own, root) for the sets that any link joins; None without links."""
        if self.large.isEmpty():
            self.verify(self.all_of_small())
            return self.roots()
        self.verify(self.all_of_small().unionByName(self.pivots_of_large()))
        self.verify(self.apart(PIVOTS))
        self.verify(self.apart(None))
        return self.roots()


def near_groups(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id, mark (a hash of the text), n_shingles, component_id (the smallest id) and root.

    Root tells groups apart where one id occurs with several texts, so that two groups have the same smallest id; it is
    null for rows without shingles.
    """
    scratch = Scratch(docs.sparkSession)
    levels = shingle_levels(docs, text_col, sim.words)
    rows = scratch.write(prefixes(docs, id_col, text_col, sim, levels))
    classes = scratch.write(rows.where("n > 0").groupBy("own").agg(F.min("id").alias("least")))
    lists = set_lists(scratch, rows)

    def sets_for(wanted: DataFrame) -> DataFrame:
        ids = classes.join(wanted, "own", "left_semi").select(F.col("least").alias("id")).distinct()
        return sets_of(docs, id_col, text_col, sim, ids).join(wanted, "own", "left_semi").dropDuplicates(["own"])

    linker = Linker(scratch, lists, rows, sim, sets_for)
    light = scratch.write(rows.select("id", "mark", "n", "own"))
    scratch.drop(rows)
    roots = linker.run()
    if roots is None:
        roots = classes.select("own", F.col("own").alias("root"))
    named = classes.join(roots, "own", "left").select("own", "least", F.coalesce("root", "own").alias("root"))
    named = scratch.write(named)
    lowest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.write(named.join(lowest, "root").select("own", "root", "component"))
    out = light.join(named, "own", "left")
    return out.select(F.col("id").alias(id_col), "mark", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), "root")


def keep_one(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of alike documents: the smallest id, of equal ids in the group the smallest mark.

    Documents without shingles are alike to none and all stay; so do rows with a null id whose group has no other id.
    """
    found = Scratch(docs.sparkSession).write(near_groups(docs, sim, id_col, text_col))
    alone = found.where("n_shingles = 0 or component_id is null").select(id_col, "mark")
    least = found.where((F.col("n_shingles") > 0) & (F.col(id_col) == F.col("component_id"))).groupBy("root").agg(F.min(F.struct(id_col, "mark")).alias("v")).select("v.*")
    keep = least.unionByName(alone).distinct().alias("k")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col(f"k.{id_col}")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("k.mark"))
    out = docs.alias("d").join(keep, same, "left_semi")
    repeated = found.where("n_shingles > 0").groupBy(id_col, "mark").count().where("count > 1")
    if not repeated.isEmpty():
        full = out.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
        out = full.dropDuplicates([id_col, text_col]).unionByName(out.where(~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
    return out
