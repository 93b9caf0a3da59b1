"""LM scoring: masked pseudo-likelihood by a bidirectional window network.

1. All texts are split into words (runs without white space, in lower case) once,
   and written as numbers of words beside the words, a slice of rows at a time.
2. All words of all documents are counted.  The most frequent ones are the
   vocabulary, which grows with the root of the distinct words, its classes with it;
   the bytes of all others give a byte bigram model.
3. A window network (window_net) is trained in numpy on every word of the corpus.
   Texts are cut into pieces, and hashes of ids and texts deal those out to slices
   once, whatever the partitions are; in each round every slice trains a copy of the
   network on all its pieces, and the copies are averaged, part by part, before the
   next.  Slices become more, and larger, with the root of the
   corpus; a task streams through its own.
4. The network predicts every word, masked, from two words on both sides.  A word
   outside the vocabulary has the chance of being one, times that of its bytes.  A
   document's score is the sum of the logarithms over its words.

What is gathered are the counts of all words and what all slices have learned, so
it grows with the corpus.  What reaches the driver and all tasks is the network
with its vocabulary: some 400 bytes a word of the vocabulary.  Rows that are the
same in id and text are learned as often as they occur, all in the same slice.

Null, empty and wordless texts have 0 tokens, log_likelihood 0.0 and a null
per_token.  Repeated rows and ids are scored as they are, null ids too; an empty
table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, slices, texts_of
from lodestone.llm.window_net import Network, Trainer, windows

REMEMBERED = 400_000
#: Before a word's first byte and after its last one.
END = 256
#: Parameters of a part of the network that is averaged by itself.
PART = 16_384
#: Words of a slice that are mixed with each other in training.
MIXED = 1 << 19


@dataclass(frozen=True)
class Settings:
    dim: int = 16
    #: Words of the vocabulary: these, and so many times the root of the distinct words, at most.
    words: int = 2048
    growth: int = 6
    #: Inputs that words outside the vocabulary share, by hash.
    others: int = 256
    #: Words that the network learns from, in pieces: this share of the corpus, which is all of it, and so many more (or all there are).
    learned: int = 600_000
    share: float = 1.0
    piece: int = 256
    #: A corpus with n times so many learned words has the root of n slices.
    slice: int = 50_000
    rounds: int = 2
    epochs: int = 1
    rate: float = 0.1
    seed: int = 3


def split_words(text: str) -> list[str]:
    return text.lower().split()


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows with their words as numbers, written: a row for each slice of them, beside its distinct words and their counts.

    ids: of the slice; keys, lengths: a hash of id and text, and the words of each (int64); words: the distinct ones, one
    a line; counts: of those (int64); places: the line of every word, one text after another (see places_of).
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(texts: list[str], lengths: list[int]) -> Iterator[list[str]]:
        for text in texts:
            split = split_words(text)
            lengths.append(len(split))
            yield split  # numbered before the next text is split

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch[1])
            own: list[int] = []
            known: dict[str, int] = defaultdict(count().__next__)
            places = np.fromiter(map(known.__getitem__, chain.from_iterable(each(texts, own))), np.uint32)
            lengths = np.array(own, np.int64)
            counts = np.bincount(places, minlength=len(known)).astype(np.int64)
            keys = np.array([xxhash.xxh64_intdigest(b"%b|%d" % (repr(doc).encode(), xxhash.xxh64_intdigest(text.encode()))) for doc, text in zip(batch[0].to_pylist(), texts, strict=True)], np.uint64)
            told = [keys, lengths, counts, places.astype(np.uint16) if len(known) <= 1 << 16 else places]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch[0])
            yield pa.RecordBatch.from_arrays([ids, pa.array(["\n".join(known)], pa.string()), *(pa.array([x.tobytes()], pa.binary()) for x in told)], ["ids", "words", "keys", "lengths", "counts", "places"])

    return Scratch(docs.sparkSession).write(docs.select(id_col, text_col).mapInArrow(code, f"ids array<{id_type}>, words string, keys binary, lengths binary, counts binary, places binary"))


def lines(words: str) -> list[str]:
    return words.split("\n") if words else []


def places_of(data: bytes, distinct: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if distinct <= 1 << 16 else np.uint32)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all documents, as coded."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for words, counts in zip(batch[0], batch[1], strict=True):
                own = pa.array(lines(words.as_py()), pa.string())
                held.append(pa.table([own, pa.array(np.frombuffer(counts.as_py(), np.int64))], ["word", "n"]))
                waiting += len(own)
                if waiting > 2 * REMEMBERED:
                    held[:] = [summed()]
                    waiting = len(held[0])
                    if waiting > REMEMBERED:
                        yield from held.pop().to_batches(max_chunksize=REMEMBERED)
                        waiting = 0
        if held:
            yield from summed().to_batches(max_chunksize=REMEMBERED)

    found = rows.select("words", "counts").mapInArrow(count_words, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def byte_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (byte before * 257 + byte) of all words with their ends, and where each word's pairs begin."""
    data = np.frombuffer(b"\n" + "\n".join(words).encode() + b"\n", np.uint8).astype(np.int32)
    data[data == 10] = END
    ends = np.flatnonzero(data == END)
    return data[:-1] * 257 + data[1:], ends[:-1]


def byte_chances(words: DataFrame) -> np.ndarray:
    """Log-probability of each byte (or END) after each byte, from words (word, n); a table of 257 x 257, flat."""

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257 * 257, np.int64)
        for batch in slices(batches, 65_536):
            pairs, begins = byte_pairs(batch[0].to_pylist())
            each = np.repeat(batch[1].to_numpy(zero_copy_only=False), np.diff(begins, append=len(pairs)))
            total += np.bincount(pairs, weights=each, minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["pair", "n"])

    counts = np.full(257 * 257, 0.1)
    for pair, n in words.mapInArrow(count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 257 * 257 rows at most
        counts[pair] += n
    counts = counts.reshape(257, 257)
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).ravel()


@dataclass
class Model:
    settings: Settings
    vocabulary: dict[str, int]
    bytes: np.ndarray
    network: Network

    @property
    def edge(self) -> int:
        return len(self.vocabulary) + self.settings.others


def looked_up(words: list[str], vocabulary: dict[str, int], others: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its input of the network, and its number in the vocabulary or -1."""
    number = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
    inputs, outside = number.copy(), np.flatnonzero(number < 0)
    hashes = pd.util.hash_array(np.array(words, dtype=object)[outside], categorize=False)
    inputs[outside] = len(vocabulary) + (hashes % np.uint64(others)).astype(np.int32)
    return inputs, number


def sample(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int], settings: Settings, total: int) -> DataFrame:
    """The pieces of a table of texts that the network learns from: all, if the settings name no lesser share."""
    return pieces(coded(docs, id_col, text_col), vocabulary, settings, total)


def pieces(rows: DataFrame, vocabulary: dict[str, int], settings: Settings, total: int, kind: type = np.int32) -> DataFrame:
    """The pieces of coded rows that the network learns from in each round: (name, piece: inputs as bytes of numbers of that kind)."""
    few = min(1.0, settings.learned / max(1, total) + settings.share)
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, keys, lengths, places in zip(*batch.columns, strict=True):
                distinct = lines(words.as_py())
                inputs, _ = looked_up(distinct, known.value, settings.others)
                inputs = inputs.astype(kind)[places_of(places.as_py(), len(distinct))]
                names, chosen, start = [], [], 0
                for key, length in zip(np.frombuffer(keys.as_py(), np.uint64).tolist(), np.frombuffer(lengths.as_py(), np.int64).tolist(), strict=True):
                    for at in range(0, length, settings.piece):
                        name = xxhash.xxh64_intdigest(struct.pack("<qQ", at, key))
                        if name < few * 2.0**64:
                            names.append(name - 2**63)
                            chosen.append(inputs[start + at : start + min(length, at + settings.piece)].tobytes())
                    start += length
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(chosen, pa.binary())], ["name", "piece"])

    return rows.select("words", "keys", "lengths", "places").mapInArrow(cut, "name long, piece binary")


def dealt(pieces: DataFrame, many: int) -> DataFrame:
    """Pieces (slice, name, piece) in so many tasks, each slice whole and in the order of its names: (slice, piece)."""
    return pieces.repartitionById(many, F.col("slice").cast("int")).sortWithinPartitions("slice", "name").select("slice", "piece")


def trained(pieces: DataFrame, network: Network, known: int, edge: int, settings: Settings, seed: int, many: int = 1) -> Network:
    """The network after a round on pieces (slice, name, piece) of int32.  many: tasks; slices of one task follow one another."""
    return averaged(dealt(pieces, many), network, known, edge, settings, seed)


def averaged(pieces: DataFrame, network: Network, known: int, edge: int, settings: Settings, seed: int, kind: type = np.int32) -> Network:
    """The network trained on each slice of dealt pieces by itself, then averaged."""
    start = pieces.sparkSession.sparkContext.broadcast(network)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, held, waiting, words = None, None, [], 0, 0

        def take() -> None:
            nonlocal waiting, words
            flat = np.concatenate(held).astype(np.int32)
            own.train(flat, np.where(flat < known, flat, -1), np.array([len(x) for x in held]), edge, settings.epochs, settings.rate, seed)
            held.clear()
            words, waiting = words + waiting, 0

        def told() -> pa.RecordBatch:
            if held:
                take()
            values = own.network.flat()
            parts = [values[i : i + PART].tobytes() for i in range(0, len(values), PART)]
            return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([float(words)] * len(parts)), pa.array(parts, pa.binary())], ["part", "slice", "weight", "data"])

        for batch in batches:
            for slice_, piece in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if slice_ != number:
                    if own is not None:
                        yield told()
                    number, own, words = slice_, Trainer(start.value.with_flat(start.value.flat())), 0
                held.append(np.frombuffer(piece, kind))
                waiting += len(held[-1])
                if waiting >= MIXED:
                    take()
        if own is not None:
            yield told()

    def mean(part: pa.Table) -> pa.Table:
        part = part.sort_by("slice")  # sums are the same each time
        weights = np.array(part["weight"].to_pylist())
        total = sum(w * np.frombuffer(d, np.float32).astype(np.float64) for w, d in zip(weights, part["data"].to_pylist(), strict=True))
        return pa.table([part["part"][:1], pa.array([(total / weights.sum()).astype(np.float32).tobytes()], pa.binary())], ["part", "data"])

    copies = pieces.mapInArrow(learn, "part int, slice long, weight double, data binary")
    rows = copies.groupBy("part").applyInArrow(mean, "part int, data binary").collect()  # one network
    if not rows:
        return network
    return network.with_flat(np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(rows, key=lambda r: r.part)]))


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, int]:
    """The model of a corpus, and the words in it."""
    return fit_coded(coded(docs, id_col, text_col), settings)


def fit_coded(rows: DataFrame, settings: Settings) -> tuple[Model, int]:
    words = Scratch(rows.sparkSession).write(word_counts(rows))
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()  # some hundreds
    distinct, total = sum(r.words for r in levels), sum(r.n for r in levels)
    most, taken, last = settings.words + settings.growth * math.isqrt(distinct), 0, None
    for r in levels:
        if taken + r.words > most:
            break
        taken, last = taken + r.words, r.level
    inside = F.lit(False) if last is None else level >= last
    chosen = sorted(words.where(inside).collect(), key=lambda r: (-r.n, r.word))  # `most` at most
    vocabulary = {r.word: i for i, r in enumerate(chosen)}
    counts = np.array([r.n for r in chosen], dtype=float)
    edge = len(vocabulary) + settings.others
    net = Network.start(counts, total - counts.sum(), edge + 1, settings.dim, settings.seed)
    learned = min(total, settings.learned + int(settings.share * total))
    many = max(1, math.isqrt(learned // settings.slice))
    kind = np.uint16 if edge <= 1 << 16 else np.int32
    cut = pieces(rows, vocabulary, settings, total, kind).select(F.pmod("name", F.lit(many)).alias("slice"), "name", "piece")
    each = dealt(cut, many).persist(StorageLevel.DISK_ONLY)  # cut and dealt once for all rounds
    for i in range(settings.rounds):
        net = averaged(each, net, len(vocabulary), edge, settings, settings.seed + i, kind)
    each.unpersist()
    return Model(settings, vocabulary, byte_chances(words.where(~inside)), net), total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """For each row: id, n_tokens, log_likelihood (the network's, summed over the words) and per_token (its mean) of its whole text."""
    written = coded(docs, id_col, text_col)
    fitted, _ = fit_coded(written, settings)
    id_type = docs.schema[id_col].dataType.simpleString()
    told = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            for ids, words, own, data in zip(*batch.columns, strict=True):
                distinct = lines(words.as_py())
                inputs, number = looked_up(distinct, model.vocabulary, settings.others)
                chance, outside = np.zeros(len(distinct), np.float32), np.flatnonzero(number < 0)
                if len(outside):
                    pairs, begins = byte_pairs([distinct[i] for i in outside])
                    chance[outside] = np.add.reduceat(model.bytes[pairs], begins)
                places, lengths = places_of(data.as_py(), len(distinct)), np.frombuffer(own.as_py(), np.int64)
                chances = model.network.log_chances(windows(inputs[places], lengths, model.edge), number[places]) + chance[places]
                sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=chances, minlength=len(lengths))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(lengths), pa.array(sums.astype(np.float64))], [id_col, "n_tokens", "log_likelihood"])

    rows = written.select("ids", "words", "lengths", "places").mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, log_likelihood double")
    return rows.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
