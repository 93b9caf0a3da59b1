"""Phrase collocations by position bitmaps.

Texts are cut into pieces at punctuation and line ends, pieces into words, and the
words of one language are laid out one after another in shards of bounded size,
with a gap between pieces.  In a shard each word has a bitmap of its places,
compressed to the blocks of eight places that it occurs in.  A phrase's bitmap has
the places where it ends: shifted by one place and combined by AND with the
bitmaps of the words in its blocks it gives all its extensions at once, whose
popcounts are their numbers of occurrences.  Since gaps belong to no word, no
phrase leaves its piece.  A shard that begins inside of a piece repeats the words
before it, so that phrases over the border are found, and counts what ends after
them only.

Popcounts are summed over shards, for words first; a word below Settings.least is
in no candidate, so the others get numbers, and only their bitmaps are kept.  Then
come pairs, triples and so on up to Settings.most words: a shard goes depth-first
from its words along the phrases that are frequent over all shards, as far as
those are known, and extends them by one word more, if what the new phrase holds
without its first word is frequent too.  Frequent phrases get numbers like words,
so a phrase is told by the number of what it extends and that of its last word.  Counts of parts, scores and containment
are joins over the frequent phrases.

Null texts are empty, a null language is named Settings.unknown.  Repeated rows
count each time.  An empty table, or one without frequent phrases, gives an empty
result; other columns are ignored, whatever their names.  Texts and pieces of any
length are whole: they go on in the next shard.

What is broadcast are the frequent words and phrases, up to Settings.broadcast of
them; beyond that each shard is joined with its own.  The driver sees how many
there are, and those that it broadcasts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, numbered_rows, slices


@dataclass(frozen=True)
class Settings:
    #: Words of a phrase at most, and its occurrences at least.
    most: int = 5
    least: int = 100
    #: A phrase goes if a longer one that holds it has this percentage of its occurrences.
    share: int = 100
    #: Phrases of each language that are reported.
    top: int = 2000
    unknown: str = "und"
    #: Places of a shard.
    places: int = 1 << 21
    #: Frequent words, and frequent phrases, that are broadcast at most (24 bytes each, and the text of words).
    broadcast: int = 400_000

    def __post_init__(self):
        if self.most < 2 or self.least < 1 or self.places < 64:
            raise ValueError("phrases have two words or more, occur at least once, and lie in shards of 64 places or more")

    @property
    def lead(self) -> int:
        """Places before a shard's own, for the words that its first phrases may begin with."""
        return -(-(self.most - 1) // 8) * 8


#: Bitmap entries that are extended at once.
CHUNK = 1 << 17

#: No byte of UTF-8; stands for the end of a piece.
_END = 0xFF
_BYTES = bytes(_END if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_and_ends(text: str) -> list[bytes]:
    """The words of a text in order, b"\\xff" after each piece."""
    return (text.encode().translate(_BYTES) + b"\xff").replace(b"\xff", b" \xff ").split()


def packed(array: np.ndarray) -> bytes:
    """An array of numbers compressed byte by byte of their width."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


@dataclass
class Bitmaps:
    """Bitmaps of words: for each entry its word, its block of eight places, and the bits in it; by word, then block."""

    word: np.ndarray
    block: np.ndarray
    bits: np.ndarray
    words: int

    @classmethod
    def of(cls, ids: np.ndarray, places: np.ndarray, words: int) -> Bitmaps:
        order = np.argsort(ids, kind="stable")  # places are in order already
        word, place = ids[order], places[order]
        block, bit = place >> 3, np.left_shift(1, place & 7).astype(np.uint8)
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), (word[1:] != word[:-1]) | (block[1:] != block[:-1])]))
        bits = np.add.reduceat(bit, begins, dtype=np.uint8) if len(begins) else bit
        return cls(word[begins].astype(np.int32), block[begins].astype(np.int32), bits, words)

    def stored(self) -> tuple[bytes, bytes, bytes]:
        """Entries of each word, steps between its blocks, bits."""
        steps = np.diff(self.block, prepend=np.int32(0))
        first = np.flatnonzero(np.diff(self.word, prepend=-1))
        steps[first] = self.block[first]
        return packed(np.bincount(self.word, minlength=self.words).astype(np.uint32)), packed(steps.astype(np.uint32)), packed(self.bits)

    @classmethod
    def read(cls, words: int, sizes: bytes, steps: bytes, bits: bytes) -> Bitmaps:
        size = unpacked(sizes, words, np.uint32).astype(np.int64)
        n = int(size.sum())
        block = np.cumsum(unpacked(steps, n, np.uint32).astype(np.int64))
        before = np.concatenate([[0], block])[(np.cumsum(size) - size)]
        return cls(np.repeat(np.arange(words, dtype=np.int32), size), (block - np.repeat(before, size)).astype(np.int32), unpacked(bits, n, np.uint8), words)

    def only(self, keep: np.ndarray) -> Bitmaps:
        """The bitmaps of the words in keep, which are numbered by their places in it."""
        number = np.full(self.words, -1, np.int32)
        number[keep] = np.arange(len(keep))
        word = number[self.word]
        kept = np.flatnonzero(word >= 0)
        kept = kept[np.argsort(word[kept], kind="stable")]
        return Bitmaps(word[kept], self.block[kept], self.bits[kept], len(keep))


class Extender:
    """Extends phrases of a shard by all words at once."""

    def __init__(self, maps: Bitmaps, lead: int):
        self.maps, self.first_own = maps, lead >> 3
        order = np.argsort(maps.block, kind="stable")
        self.word, self.bits = maps.word[order], maps.bits[order]
        blocks = int(maps.block.max(initial=-1)) + 2
        self.size = np.bincount(maps.block, minlength=blocks)
        self.start = np.cumsum(self.size) - self.size

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, phrase, block, bits) of the bitmaps of some words after another; phrase numbers those words."""
        maps = self.maps
        ends = np.cumsum(np.bincount(maps.word, minlength=maps.words))
        word = 0
        while word < maps.words:
            begin = int(ends[word - 1]) if word else 0
            to = max(word + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
            part = slice(begin, int(ends[to - 1]))
            yield np.arange(word, to), maps.word[part] - word, maps.block[part], maps.bits[part]
            word = to

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, allow: Callable | None = None) -> tuple[np.ndarray, ...]:
        """All phrases one word longer: the phrase that each goes on from, its last word, (phrase, block, bits) of their bitmaps, their occurrences.

        allow: tells for arrays of phrases and words which to go along with; None: all.
        """
        shifted, over = (bits << 1).astype(np.uint8), bits >> 7
        stay, go = np.flatnonzero(shifted), np.flatnonzero(over)
        phrase = np.concatenate([phrase[stay], phrase[go]])
        block = np.concatenate([block[stay], block[go] + 1])
        bits = np.concatenate([shifted[stay], over[go]])
        size = self.size[block]
        source = np.repeat(np.arange(len(block)), size)
        entry = np.arange(len(source)) + np.repeat(self.start[block] - (np.cumsum(size) - size), size)
        both = bits[source] & self.bits[entry]
        hit = np.flatnonzero(both)
        phrase, word, both = phrase[source[hit]], self.word[entry[hit]], both[hit]
        block = block[source[hit]]
        if allow is not None:
            known = np.flatnonzero(allow(phrase, word))
            phrase, block, word, both = phrase[known], block[known], word[known], both[known]
        n = self.maps.words
        key = phrase.astype(np.int64) * n + word
        order = np.argsort(key, kind="stable")
        key, block, both = key[order], block[order], both[order]
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
        ends_here = np.bitwise_count(both).astype(np.int64) * (block >= self.first_own)
        found = np.add.reduceat(ends_here, begins) if len(begins) else np.zeros(0, np.int64)
        return key[begins] // n, key[begins] % n, number, block, both, found


class Trie:
    """Frequent phrases in the words of a shard, by length; each knows its phrase without the first word."""

    def __init__(self, numbers: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """numbers: of the shard's words, ascending; tables: for each length from 2 on (number, phrase, word) of the phrases, by the numbers of what they extend and of the last word."""
        self.n = len(numbers)
        #: For each length: the phrases' numbers, the sorted keys (phrase without the last word, last word), the phrase without the first word.
        self.numbers, self.keys, self.suffix = [numbers], [np.arange(self.n)], [np.zeros(self.n, np.int64)]
        for number, phrase, word in tables:
            parent, last = _places(self.numbers[-1], phrase), _places(numbers, word)
            here = np.flatnonzero((parent >= 0) & (last >= 0))
            keys = parent[here] * self.n + last[here]
            order = np.argsort(keys)
            parent, last = parent[here][order], last[here][order]
            length = len(self.numbers)
            self.suffix.append(last if length == 1 else self.child(length, self.suffix[-1][parent], last))
            self.numbers.append(number[here][order])
            self.keys.append(keys[order])

    def child(self, length: int, phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The phrase of that length which each phrase is with the word behind it; -1 if there is none."""
        keys, key = self.keys[length - 1], phrase.astype(np.int64) * self.n + word
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (phrase >= 0), at, -1)


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number stands in known; -1 if it does not."""
    if not len(known):
        return np.full(len(wanted), -1)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known, wanted, sorter=order), len(known) - 1)
    return np.where(known[order[at]] == wanted, order[at], -1)


SHARDS = "shard long, lang string, n_words long, words array<string>, counts array<long>, sizes binary, steps binary, bits binary"
KEPT = "shard long, numbers array<long>, sizes binary, steps binary, bits binary"


class _Shard:
    """The words of one language, laid out until there are enough for a shard."""

    def __init__(self, settings: Settings, lang: str):
        self.settings, self.lang = settings, lang
        self.before: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.known[b"\xff"]  # 0: no word
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> Iterator[tuple]:
        at = 0
        while at < len(tokens):
            some = tokens[at : at + self.settings.places - self.size]
            self.parts.append(np.fromiter(map(self.known.__getitem__, some), np.int32, len(some)))
            at += len(some)
            self.size += len(some)
            if self.size >= self.settings.places:
                yield self.row()

    def row(self) -> tuple:
        """lang and what follows it in SHARDS; the next shard begins where this one ends."""
        ids = np.concatenate(self.parts)
        lead, before = self.settings.lead, [self.known[w] for w in self.before]
        words = list(self.known)
        tail = ids[len(ids) - min(self.settings.most - 1, len(ids)) :].tolist()
        carried = self.before + [words[i] for i in tail]
        after = len(carried) - (carried[::-1].index(b"\xff") if b"\xff" in carried else len(carried))
        every = np.concatenate([np.array(before, np.int32), ids])
        place = np.arange(lead - len(before), lead + len(ids), dtype=np.int32)
        real = every > 0
        maps = Bitmaps.of(every[real], place[real], len(words))
        counts = np.bincount(ids, minlength=len(words))
        counts[0] = 0
        self.before = carried[after:][-(self.settings.most - 1) :]
        self.clear()
        return (self.lang, int(counts.sum()), words[1:], counts[1:], *Bitmaps(maps.word - 1, maps.block, maps.bits, len(words) - 1).stored())


def shards(docs: DataFrame, settings: Settings, lang_col: str, text_col: str) -> DataFrame:
    """The words of all texts as bitmaps, SHARDS."""

    def batch_of(rows: list[tuple], at: int) -> pa.RecordBatch:
        lang, n, words, counts, *maps = zip(*rows, strict=True)
        texts = [pa.array(w, pa.binary()).cast(pa.string()) for w in words]
        lists = lambda arrays, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), pa.int32()), pa.concat_arrays([pa.array(a, kind) for a in arrays]))
        names = [x.split()[0] for x in SHARDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(lang), pa.array(n, pa.int64()), lists(texts, pa.string()), lists(counts, pa.int64()), *[pa.array(m, pa.binary()) for m in maps]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}
        at = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            for lang, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                lang = settings.unknown if lang is None else lang
                if not text:
                    continue
                shard = open_.get(lang) or open_.setdefault(lang, _Shard(settings, lang))
                for row in shard.add(words_and_ends(text)):
                    yield batch_of([row], at)
                    at += 1
            if sum(s.size for s in open_.values()) > 4 * settings.places:  # many languages
                for shard in open_.values():
                    yield batch_of([shard.row()], at)
                    at += 1
                open_.clear()
        for shard in open_.values():
            if shard.size:
                yield batch_of([shard.row()], at)
                at += 1

    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, SHARDS)


def frequent_words(scratch: Scratch, rows: DataFrame, settings: Settings) -> DataFrame:
    """(lang, word, f, number) of the words that occur often enough."""
    each = rows.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    f = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= settings.least)
    return numbered_rows(scratch, f)


def numbered(rows: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """The bitmaps of frequent words with the words' numbers, KEPT."""
    each = rows.select("shard", "lang", F.posexplode("words").alias("at", "word"))
    known = words.select("lang", "word", "number")
    known = F.broadcast(known) if words.count() <= settings.broadcast else known
    local = each.join(known, ["lang", "word"]).select(F.col("shard").alias("of"), "at", "number")

    names = [x.split()[0] for x in KEPT.split(", ")]

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a shard without frequent words
            return pa.table([pa.array([], kind) for kind in (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3)], names)
        (row,) = left.to_pylist()
        at, number = right["at"].to_numpy(), right["number"].to_numpy()
        order = np.argsort(number)
        maps = Bitmaps.read(row["n"], row["sizes"], row["steps"], row["bits"]).only(at[order])
        return pa.table([[row["shard"]], pa.array([number[order]], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in maps.stored()]], names)

    bitmaps = rows.select("shard", F.size("words").alias("n"), "sizes", "steps", "bits")
    return bitmaps.groupBy("shard").cogroup(local.groupBy("of")).applyInArrow(keep, KEPT)


def _extenders(batches: Iterator[pa.RecordBatch], lead: int) -> Iterator[tuple[int, np.ndarray, Extender]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch[name][i] for name in batch.schema.names}
            numbers = row["numbers"].values.to_numpy(zero_copy_only=False)
            maps = Bitmaps.read(len(numbers), *(row[x].as_py() for x in ("sizes", "steps", "bits")))
            yield row["shard"].as_py(), numbers, Extender(maps, lead)


FOUND = "shard long, phrase long, word long, f long"


def _extended(numbers: np.ndarray, extender: Extender, shard: int, tables: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """FOUND of the phrases of that length in a shard, depth-first along the shorter ones in tables; f is 0 where they end before the shard's own places."""
    trie = Trie(numbers, tables)
    for node, phrase, block, bits in extender.roots():
        for k in range(2, length):
            parent, word, phrase, block, bits, _ = extender.extend(phrase, block, bits, lambda p, w, k=k, node=node: trie.child(k, node[p], w) >= 0)
            node = trie.child(k, node[parent], word)
        rest = trie.suffix[length - 2][node]
        parent, word, *_, found = extender.extend(phrase, block, bits, None if length == 2 else lambda p, w, rest=rest: trie.child(length - 1, rest[p], w) >= 0)
        columns = [np.full(len(word), shard, np.int64), trie.numbers[length - 2][node[parent]], numbers[word], found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "phrase", "word", "f"])


class Levels:
    """Finds the frequent phrases of one length after the other."""

    def __init__(self, scratch: Scratch, kept: DataFrame, settings: Settings):
        self.scratch, self.kept, self.settings = scratch, kept, settings
        #: By length from 2 on: what each shard found, what is frequent, what of that is in each shard.
        self.found: list[DataFrame] = []
        self.frequent: list[DataFrame] = []
        self.own: list[DataFrame] = []
        self.tables: list[tuple] = []
        self.together = True

    def next(self) -> DataFrame:
        """(phrase, word, f, number) of the frequent phrases that are one word longer than those so far."""
        length = len(self.frequent) + 2
        found = self._with_all(length) if self.together else self._with_own(length)
        frequent = found.groupBy("phrase", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= self.settings.least)
        self.found.append(found)
        self.frequent.append(numbered_rows(self.scratch, frequent))
        if self.together:
            self.together = sum(f.count() for f in self.frequent) <= self.settings.broadcast
        if self.together:
            table = self.frequent[-1].select("number", "phrase", "word").toArrow()
            self.tables.append(tuple(c.to_numpy() for c in table.columns))
        return self.frequent[-1]

    def _with_all(self, length: int) -> DataFrame:
        """Every shard is told all frequent phrases."""
        lead, known = self.settings.lead, self.kept.sparkSession.sparkContext.broadcast(list(self.tables))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, numbers, extender in _extenders(batches, lead):
                yield from _extended(numbers, extender, shard, known.value, length)

        return self.kept.mapInArrow(run, FOUND)

    def _with_own(self, length: int) -> DataFrame:
        """Every shard is told those that it holds itself."""
        for k in range(len(self.own), len(self.frequent)):
            held = self.found[k].join(self.frequent[k].select("phrase", "word", "number"), ["phrase", "word"])
            self.own.append(self.scratch.write(held.select(F.col("shard").alias("of"), F.lit(k).alias("level"), "number", "phrase", "word")))
        own, lead = reduce(DataFrame.unionAll, self.own), self.settings.lead

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            level, *columns = (right[c].to_numpy() for c in ("level", "number", "phrase", "word"))
            tables = [tuple(c[level == k] for c in columns) for k in range(length - 2)]
            out = [b for x in _extenders(iter(left.to_batches()), lead) for b in _extended(x[1], x[2], x[0], tables, length)]
            return pa.Table.from_batches(out, pa.schema([(n, pa.int64()) for n in ("shard", "phrase", "word", "f")]))

        return self.kept.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(run, FOUND)


#: floor(1000 * a * n / (l * r)) in whole numbers of 38 digits.
SCORE = "cast(a * 1000 as decimal(19, 0)) * cast(n as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"


def collocations(docs: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first Settings.top phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(shards(docs, settings, lang_col, text_col))
    totals = rows.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = frequent_words(scratch, rows, settings)
    levels = Levels(scratch, scratch.write(numbered(rows, words, settings)), settings)
    shorter, found = words.select("number", F.array("number").alias("ids")), []
    for _ in range(2, settings.most + 1):
        spelled = levels.next().join(shorter.withColumnRenamed("number", "phrase"), "phrase").select("number", F.concat("ids", F.array("word")).alias("ids"), "f")
        found.append(scratch.write(spelled))
        shorter = found[-1].select("number", "ids")
    return report(reduce(DataFrame.unionAll, found).select("ids", "f"), words, totals, settings)


def report(phrases: DataFrame, words: DataFrame, totals: DataFrame, settings: Settings) -> DataFrame:
    """The first phrases (ids, f) of each language by their scores; words: (lang, word, f, number), totals: (lang, n)."""
    k = F.size("ids")
    # What a longer phrase holds, with the occurrences of the commonest that does.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(settings.most)), lambda m: F.when(m < k, F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.slice("ids", i, m))).otherwise(F.array().cast("array<array<bigint>>"))))
    held = phrases.where(k > 2).select(F.explode(spans).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("holder"))
    own = phrases.join(held, "ids", "left").where(F.col("holder").isNull() | (F.lit(100) * F.col("holder") < F.lit(settings.share) * F.col("f")))
    # Text and language.
    spelled = own.select("ids", F.posexplode("ids").alias("at", "number")).join(words.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("ids").agg(F.any_value("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"))
    # Every cut with the counts of its two parts.
    counts = phrases.unionAll(words.select(F.array("number").alias("ids"), "f"))
    cuts = own.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), k - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(counts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.join(spelled, "ids").join(totals, "lang").withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), *(F.any_value(c).alias(c) for c in ("lang", "phrase", "a", "n")))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of some shares of a language, then of those.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*first))
    best = best.withColumn("share", share).withColumn("rank", rank("lang", "share")).where(F.col("rank") <= settings.top)
    best = best.withColumn("rank", rank("lang")).where(F.col("rank") <= settings.top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
