"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are itself and its character n-grams, hashed into buckets
with an embedding each; a word is the mean of its features, a window of words
the mean of its words, and a linear softmax over that mean gives the two
classes.  An unseen misspelling thus shares most n-gram vectors with the word.

A label belongs to a whole text, mostly because of a few words, so training
starts on whole texts and goes on with each text's most toxic window; a text is
scored by its most toxic window, over the whole text, and the margin is turned
into a probability by a logistic fit on the training texts.

The classifier is fitted on a bounded sample of labelled documents: Settings.rows
of each class, by a hash of the id, of those whose text has 1 to Settings.longest
characters; labels without such a document take no place in it.  Everything else
covers all rows.  Only text is scored: null, empty and wordless texts get the
score of a text whose words say nothing.  Without rows of both classes every
score is the smoothed share of toxic labels.  Of several labels for one id the
largest counts.  Repeated rows and null ids are scored like any others; an empty
table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import slices, texts_of

REMEMBERED = 250_000


@dataclass(frozen=True)
class Settings:
    rows: int = 2500
    longest: int = 20_000
    window: int = 12
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 12
    #: Steps of an epoch at least, as far as the rows go (a step takes 4 to 128).
    steps: int = 60
    rate: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """What scoring needs: for each bucket its part of the margin, the bias, and the logistic fit (scale, shift)."""

    settings: Settings
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -50, 50)))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def features(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all words, and of which word each is.  A word is taken in lower case, between marks."""
    text = "".join([f"\x02{w.lower()}\x03" for w in words])
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.cumsum(points == 2) - 1
    starts = np.flatnonzero(points == 2)
    mixed = _mixed(points + np.uint64(1))
    place = (np.arange(len(points)) - starts[word]).astype(np.uint64)
    whole = np.add.reduceat(_mixed(mixed + place * _MULT), starts)
    buckets, owners = [_mixed(whole)], [np.arange(len(words))]
    for n in settings.grams:
        if len(points) < n:
            continue
        gram = mixed[: len(mixed) - n + 1].copy()
        for i in range(1, n):
            gram = gram * _MULT + mixed[i : len(mixed) - n + 1 + i]
        inside = np.flatnonzero(word[: len(gram)] == word[n - 1 :])
        buckets.append(_mixed(gram[inside] + np.uint64(n)))
        owners.append(word[inside])
    return (np.concatenate(buckets) % np.uint64(settings.buckets)).astype(np.int64), np.concatenate(owners)


def _means(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owners, weights=values, minlength=n) / np.maximum(np.bincount(owners, minlength=n), 1)


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (below size) in order, and which of them each value is; no sort."""
    seen = np.zeros(size, bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    number = np.empty(size, np.int64)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[values]


def best_windows(parts: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose words' parts lie one after another: where the window with the largest mean begins, its size, its mean (0 for no words)."""
    sums = np.concatenate([[0.0], np.cumsum(parts)])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    size = np.minimum(window, lengths)
    at, means = starts.copy(), np.zeros(len(lengths))
    full = np.flatnonzero(lengths >= window)
    if len(full):
        moving = np.concatenate([sums[window:] - sums[:-window], np.full(window, -np.inf)])
        counts = lengths[full] - window + 1
        index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[full], counts)
        values = moving[index]
        cuts = np.cumsum(counts) - counts
        most = np.maximum.reduceat(values, cuts)
        hit = np.flatnonzero(values == np.repeat(most, counts))
        owner = np.repeat(np.arange(len(full)), counts)[hit]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        at[full], means[full] = index[hit[first]], most / window
    short = np.flatnonzero((lengths < window) & (lengths > 0))
    means[short] = (sums[ends[short]] - sums[starts[short]]) / lengths[short]
    return at, size, means


def split_words(text: str) -> list[str]:
    return text.split()


def trimmed(word: str) -> str:
    """The word without punctuation at its ends, unless it is nothing else."""
    return word.strip(".,;:!?\"'()[]{}|*%&$#~-_/\\") or word


def train(texts: list[str], labels: np.ndarray, settings: Settings) -> Model:
    labels = np.asarray(labels, dtype=np.int64)
    positive = int(labels.sum())
    share = (positive + 1) / (len(labels) + 2)
    nothing = Model(settings, np.zeros(settings.buckets, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if positive in (0, len(labels)):
        return nothing
    rng = np.random.default_rng(settings.seed)
    known: dict[str, int] = {}
    tokens = [[known.setdefault(trimmed(w), len(known)) for w in split_words(t)] for t in texts]
    lengths = np.array([len(t) for t in tokens])
    flat = np.array([w for t in tokens for w in t], dtype=np.int64)
    if not len(flat):
        return nothing
    bucket, owner = features(list(known), settings)
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order], owner[order]
    per_word = np.bincount(owner, minlength=len(known))
    first = np.cumsum(per_word) - per_word
    vectors = rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32)
    output = rng.normal(0, 0.1, (settings.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_vectors, seen_output, seen_bias = np.full(settings.buckets, 1e-8, np.float32), np.full(output.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (len(labels) - positive)) * len(labels)
    starts = np.cumsum(lengths) - lengths
    has_words = np.flatnonzero(lengths)

    def parts() -> np.ndarray:
        margin = vectors @ (output[:, 1] - output[:, 0])
        return _means(margin[bucket], owner, len(known))

    def step(rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """One Adagrad step on a batch of windows."""
        nonlocal output, bias
        window = np.repeat(np.arange(len(rows)), size)
        words = flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)]
        # A word's vector is summed once a batch, however often it stands there.
        word, place = _numbered(words, len(known))
        n = per_word[word]
        begin = np.cumsum(n) - n
        feature = bucket[np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(first[word], n)]
        embedded = np.add.reduceat(vectors[feature], begin, axis=0) / n[:, None]
        share = 1.0 / size[window]  # of the word in its window's mean
        mean = np.empty((len(rows), settings.dim), np.float32)
        for d in range(settings.dim):
            mean[:, d] = np.bincount(window, weights=embedded[place, d] * share, minlength=len(rows))
        logits = mean @ output + bias
        logits -= logits.max(1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(1, keepdims=True)
        chance[np.arange(len(rows)), labels[rows]] -= 1
        error = (chance * weight[rows, None]).astype(np.float32) / len(rows)
        back = error @ output.T
        pull = np.empty((len(word), settings.dim))
        for d in range(settings.dim):
            pull[:, d] = np.bincount(place, weights=back[window, d] * share, minlength=len(word))
        pull /= n[:, None]
        touched, inverse = _numbered(feature, settings.buckets)
        change = np.empty((len(touched), settings.dim), np.float32)
        for d in range(settings.dim):
            change[:, d] = np.bincount(inverse, weights=np.repeat(pull[:, d], n), minlength=len(touched))
        grad_output, grad_bias = mean.T @ error, error.sum(0)
        seen_vectors[touched] += (change**2).mean(1)
        seen_output[...] += grad_output**2
        seen_bias[...] += grad_bias**2
        vectors[touched] -= settings.rate * change / np.sqrt(seen_vectors[touched])[:, None]
        output = output - settings.rate * grad_output / np.sqrt(seen_output)
        bias = bias - settings.rate * grad_bias / np.sqrt(seen_bias)

    for epoch in range(settings.epochs):
        # Whole texts, then ever smaller windows down to the window that scores.
        window = max(settings.window, int(lengths.max()) >> (2 * epoch)) if epoch < settings.epochs // 2 else settings.window
        at, size, _ = best_windows(parts()[flat], lengths, window)
        rows = has_words
        # Beside its most toxic window a clean text also gives one at random.
        clean = has_words[labels[has_words] == 0]
        other = starts[clean] + (rng.random(len(clean)) * (lengths[clean] - size[clean] + 1)).astype(np.int64)
        rows, at, size = np.concatenate([rows, clean]), np.concatenate([at[rows], other]), np.concatenate([size[rows], size[clean]])
        mixed = rng.permutation(len(rows))
        batch = int(np.clip(len(rows) // settings.steps, 4, 128))
        for i in range(0, len(rows), batch):
            some = mixed[i : i + batch]
            step(rows[some], at[some], size[some])
    weights = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)
    offset = float(bias[1] - bias[0])
    _, _, means = best_windows(_means(weights[bucket], owner, len(known))[flat], lengths, settings.window)
    margin = means + offset
    spread = margin.std() or 1.0
    scale, shift, x = 1.0, 0.0, (margin - margin.mean()) / spread
    for _ in range(500):  # logistic fit, slightly held back
        error = 1 / (1 + np.exp(-np.clip(scale * x + shift, -50, 50))) - labels
        scale -= 0.5 * (float((error * x).mean()) + 1e-3 * scale)
        shift -= 0.5 * float(error.mean())
    return Model(settings, weights, offset, float(scale / spread), float(shift - scale * margin.mean() / spread))


def fold(id_col: Column, folds: int = 5) -> Column:
    """Remainder of CRC-32 of the id's decimal text."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", held_out: int = 0) -> Model:
    """A model from labelled rows outside the fold held_out: at most settings.rows of each class, the lowest by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.where(fold(F.col("id")) != held_out)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, settings.longest))
    # Labels that a document can be trained on with.
    usable = known.join(texts.select("id"), "id", "left_semi")
    ordered = [usable.where(f"y {test} 0").orderBy(F.xxhash64("id"), "id").limit(settings.rows) for test in (">", "<=")]
    chosen = ordered[0].unionAll(ordered[1])  # 2 * settings.rows ids at most
    # One text for each id, the smallest: repeated ids can't enlarge the sample.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("id").collect()
    return train([r.text for r in rows], np.array([int(r.y > 0) for r in rows], dtype=np.int64), settings)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            bucket, owner = features([trimmed(w) for w in part], self.model.settings)
            self.known.update(zip(part, _means(self.model.weights[bucket], owner, len(part)).tolist(), strict=True))

    def margins(self, texts: list[str]) -> np.ndarray:
        split = [split_words(t) for t in texts]
        found = [list(map(self.known.get, s)) for s in split]
        gaps = [[i for i, x in enumerate(v) if x is None] for v in found]
        missing = {s[i] for s, g in zip(split, gaps, strict=True) for i in g}
        if missing:
            self.learn(list(missing))
            for s, v, g in zip(split, found, gaps, strict=True):
                for i in g:
                    v[i] = self.known[s[i]]
        lengths = np.array([len(v) for v in found], dtype=np.int64)
        parts = np.array([x for v in found for x in v])
        return best_windows(parts, lengths, self.model.settings.window)[2] + self.model.bias


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns keep of docs, and the score of each row's text under the given name."""
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`"))
    schema = StructType([*source.schema.fields[:-1], StructField(name, DoubleType())])
    scorer: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not scorer:
            scorer.append(Scorer(model))
        for batch in slices(batches):
            chance = model.probability(scorer[0].margins(texts_of(batch.column(batch.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chance, pa.float64())], schema.names)

    return source.mapInArrow(run, schema)


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores until no column is called so."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, held_out, score and predicted (1 if the score is at least one half)."""
    found = score(docs, fit(docs, labels, settings, id_col=id_col, text_col=text_col), [id_col], text_col)
    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out")
    return found.select(id_col, held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores one half or more; all columns as they are."""
    model = fit(docs, labels, settings, id_col=id_col, text_col=text_col)
    name = free_name(docs, "score")
    return score(docs, model, docs.columns, text_col, name).where(F.col(f"`{name}`") < 0.5).drop(name)
