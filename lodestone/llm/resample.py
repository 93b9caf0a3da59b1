"""Importance resampling towards a target distribution, by word-id suffix arrays.

The words of a slice of documents become ids in one array, each document closed
by an id of its own.  The suffixes of that array, sorted by their first
Settings.words words, bring equal n-grams together: where neighbours share at
least k words (the LCP), a run of equal k-grams goes on.  Each run is hashed
once, and its bucket is scattered back to the places where the n-gram stands.

Counts of buckets in all documents and in all target texts give each bucket a
gain, the logarithm of how much more common it is in the target; a document's
weight is the mean gain of its features.  Adding Gumbel noise, made from a hash
of the id, and taking the highest scores draws without replacement in proportion
to the weights.

Words are runs of digits, of a-z (A-Z are lower-cased), and of all characters
beyond ASCII.  Documents without words (null, empty or blank text) have no
features and weight 0; those with less than Settings.least_words words are scored
but never drawn.  A null id is hashed as an empty one and comes last in ties;
rows of equal score and id are drawn in the order in which they are read, each
row by itself, so repeated rows count and are drawn like any others.  An empty
table gives an empty result, an empty target the same tables of zero counts.
Other columns are ignored, whatever their names.

What meets on the driver are two counts and the table of buckets, whose size is
Settings.buckets; it reaches all tasks.  Ranks come from a range sort, with the
sizes of its partitions added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, slices, texts_of


@dataclass(frozen=True)
class Settings:
    #: Features are the runs of 1 to so many consecutive words.
    words: int = 1
    buckets: int = 10_000
    seed: int = 2024
    #: Words that a document must have to be drawn, and how many of those documents are drawn.
    least_words: int = 20
    percent: int = 10


#: Letters of ASCII in lower case, everything else of ASCII but digits to a space.
_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ids in the order of their first `depth` ids at least, by doubling."""
    order = np.argsort(ids, kind="stable")
    rank, known = ids, 1
    while known < depth:
        steps = np.concatenate([[0], (rank[order][1:] != rank[order][:-1]).cumsum()]) if len(ids) else order
        rank = np.empty(len(ids), np.int64)
        rank[order] = steps
        after = np.zeros(len(ids), np.int64)
        after[: max(0, len(ids) - known)] = rank[known:] + 1
        rank = rank * (len(ids) + 1) + after
        order = np.argsort(rank, kind="stable")
        known *= 2
    return order


def shared_words(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, how many ids it shares with the one before, `depth` at most (the first: none)."""
    lcp = np.zeros(len(ids), np.int64)
    if len(ids) < 2:
        return lcp
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    padded = np.concatenate([ids, np.full(depth, -1, ids.dtype)])
    for j in range(depth):
        same &= (padded[a + j] == padded[b + j]) & (padded[a + j] >= 0)
        lcp[1:] += same
    return lcp


def bucket_lists(texts: list[list[bytes]], settings: Settings) -> list[np.ndarray]:
    """For each text, given by its words, the bucket of each feature: all single words in order, then all pairs, and so on."""
    sizes = np.array([len(t) for t in texts], np.int64)
    closed = sizes + 1
    ends = np.cumsum(closed) - 1
    known: dict[bytes, int] = {}
    ids = np.empty(int(closed.sum()), np.int64)
    at = np.ones(len(ids), bool)
    at[ends] = False
    ids[at] = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    ids[ends] = len(known) + np.arange(len(texts))  # an end of its own for each text: no n-gram goes over it
    room = np.repeat(ends, closed) - np.arange(len(ids))
    spelled = list(known)
    order = suffix_array(ids, settings.words)
    lcp = shared_words(ids, order, settings.words)
    found = []
    for k in range(1, settings.words + 1):
        begins = lcp < k
        run = np.cumsum(begins) - 1
        first = order[begins]
        fits = room[first] >= k
        bucket = np.zeros(len(first), np.int32)
        grams = ids[first[fits][:, None] + np.arange(k)].tolist()
        bucket[fits] = np.fromiter((zlib.crc32(b" ".join([spelled[i] for i in g])) % settings.buckets for g in grams), np.int64, len(grams))
        placed = np.empty(len(ids), np.int32)
        placed[order] = bucket[run]
        found.append(placed)
    starts = ends - sizes
    return [np.concatenate([f[i : j - k] if j - k > i else f[:0] for k, f in enumerate(found)]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def features(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, buckets) of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [words_of(t) for t in texts_of(batch[1])]
            lists = bucket_lists(texts, settings)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([len(t) for t in texts], pa.int64()), buckets], ["id", "n_words", "buckets"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_words long, buckets array<int>")


def bucket_counts(found: DataFrame, settings: Settings) -> np.ndarray:
    """How many features each bucket holds; each task adds up its own before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch[0].flatten().to_numpy(zero_copy_only=False), minlength=settings.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(settings.buckets, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln) of how much more common it is in the target, one count added everywhere."""
    s, t, b = own.astype(float), target.astype(float), float(len(own))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray, id_type: str) -> DataFrame:
    """(id, n_words, n_features, weight) of each row of found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[2]
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
            ends = np.cumsum(n)
            weight = np.where(n > 0, (total[ends] - total[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return found.select("id", "n_words", "buckets").mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, made from the id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def ranked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows with rank: from 1, by score descending, then id, then row."""
    in_order = rows.orderBy(F.desc("score"), F.asc_nulls_last("id"), "row").withColumn("place", F.monotonically_increasing_id())
    in_order = scratch.write(in_order.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = in_order.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # a row for each partition
    return in_order.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """For each row of docs its id, n_features, weight, score, and its rank if it is drawn (else null)."""
    scratch = Scratch(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    found = scratch.write(features(docs, settings, id_col, text_col))
    aims = features(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), settings, "id", "text")
    gain = gains(bucket_counts(found, settings), bucket_counts(aims, settings))
    scored = weighed(found, gain, id_type).withColumn("score", F.col("weight") + noise(F.col("id"), settings.seed))
    scored = scratch.write(scored.withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= settings.least_words
    drawn = settings.percent * scored.where(able).count() // 100
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    first = ranked(scratch, scored.where(able)).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return first.unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))
