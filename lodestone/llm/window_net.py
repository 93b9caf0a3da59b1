"""A bidirectional window network in numpy: predicts a word from the words on both sides of it.

An embedding for each place of the window, summed, tanh, and a softmax in two
levels: the class of the word (neighbours in the order of frequency), then the
word within its class.  Words outside the vocabulary share one class.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

#: Places of the window, relative to the word.
PLACES = (-2, -1, 1, 2)
#: Words of a step of training, and words scored at once.
BATCH, SCORED = 2048, 4096
#: Words whose logits are in use at once in training.
BLOCK = 2048
#: Classes whose words' weights are moved at once in training.
TOGETHER = 16
#: Stands for a bias of -inf, which times a 0 would be no number.
NEVER = -1e4


def windows(inputs: np.ndarray, lengths: np.ndarray, edge: int) -> np.ndarray:
    """(place, word): the inputs around each word of texts that lie one after another; edge beside a text's ends.  Those of a word lie side by side."""
    margin = max(map(abs, PLACES))
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(inputs)) + margin * (text + 1)
    padded = np.full(len(inputs) + margin * (len(lengths) + 1), edge, inputs.dtype)
    padded[at] = inputs
    return np.stack([padded[at + p] for p in PLACES], axis=1).T


def _with_ones(h: np.ndarray) -> np.ndarray:
    """h with a column of ones, which takes the bias."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)


def _exponents(logits: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits, in place, and the sum of each row.  Logits are held at 80, which trained ones are far from; most: what they can be."""
    if not most < 80:
        np.minimum(logits, 80, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype) + np.float32(1e-30)


def largest(stacked: np.ndarray) -> float:
    """The largest logit that weights with their biases as the last row can give."""
    return float((np.abs(stacked[..., :-1, :]).sum(-2) + stacked[..., -1, :]).max(initial=0))


def _row_sums(near: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct inputs of each place, all below `most`, as place * most + input, and the sums of their values; near: (place, word), values: (word, dim)."""
    order = np.concatenate([np.argsort(x.astype(np.uint16) if most <= 1 << 16 else x, kind="stable") for x in near])
    at = np.repeat(np.arange(len(near)), near.shape[1])
    ordered = np.take(near.ravel(), order + at * near.shape[1]) + at * most
    changes = np.empty(len(ordered), bool)
    changes[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=changes[1:])
    begins = np.flatnonzero(changes)
    counts = np.diff(begins, append=len(ordered))
    sums = np.take(values, np.take(order, begins), axis=0)
    # Most inputs occur once, twice or three times in a batch.
    for k in (1, 2):
        more = np.flatnonzero((counts == 2) | (counts == 3) if k == 1 else counts == 3)
        sums[more] += np.take(values, np.take(order, np.take(begins, more) + k), axis=0)
    several = np.flatnonzero(counts > 3)
    if len(several):
        some = np.take(values, order[np.repeat(counts > 3, counts)], axis=0)
        if values.shape[1] % 2 == 0:  # as complex numbers, two are added at once
            some = some.view(np.result_type(values, 1j))
        starts = np.cumsum(np.take(counts, several))
        starts = np.concatenate([[0], starts[:-1]])
        sums[several] = np.add.reduceat(some, starts, axis=0).view(values.dtype)
    return np.take(ordered, begins), sums


@dataclass(frozen=True)
class Gradients:
    """As the network's parameters, but of the inputs and the classes that occur alone."""

    rows: np.ndarray  # inputs of each place, as place * inputs + input
    of_rows: np.ndarray  # their gradients
    inputs: int
    hidden: np.ndarray
    by_class: np.ndarray  # of weights with their biases, as Network.stacked
    by_word: np.ndarray
    classes: list[int]

    @property
    def places(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place (inputs, their gradients)."""
        ends = np.searchsorted(self.rows, np.arange(1, len(PLACES)) * self.inputs)
        return list(zip((x % self.inputs for x in np.split(self.rows, ends)), np.split(self.of_rows, ends), strict=True))

    @property
    def to_class(self) -> np.ndarray:
        return self.by_class[:-1]

    @property
    def class_bias(self) -> np.ndarray:
        return self.by_class[-1]

    @property
    def to_word(self) -> list[tuple[int, np.ndarray]]:
        """(class, its gradient)"""
        return [(c, self.by_word[c, :-1]) for c in self.classes]

    @property
    def word_bias(self) -> np.ndarray:
        return self.by_word[:, -1]


@dataclass
class Network:
    places: np.ndarray  # (place, input, dim)
    hidden: np.ndarray  # (dim,)
    to_class: np.ndarray  # (dim, class); the last class: words outside the vocabulary
    class_bias: np.ndarray
    to_word: np.ndarray  # (class, dim, word in class)
    word_bias: np.ndarray  # -inf where a class is not full

    @classmethod
    def start(cls, counts: np.ndarray, outside: float, inputs: int, dim: int, seed: int) -> Network:
        """counts: of the vocabulary, most frequent first; outside: of all other words together.  It predicts their shares."""
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        size = max(1, int(np.ceil(np.sqrt(len(counts)))))
        classes = -(-len(counts) // size)
        each = np.zeros(classes * size)
        each[: len(counts)] = counts
        each = each.reshape(classes, size)
        totals = np.append(each.sum(1), outside + 0.5)
        with np.errstate(divide="ignore"):
            word_bias = np.log(each / each.sum(1, keepdims=True)) if classes else each
        return cls(normal(0.3, len(PLACES), inputs, dim), np.zeros(dim, np.float32), normal(0.1, dim, classes + 1), np.log(totals / totals.sum()).astype(np.float32), normal(0.1, classes, dim, size), word_bias.astype(np.float32))

    def activation(self, around: np.ndarray) -> np.ndarray:
        total = np.take(self.places[0], around[0], axis=0) + self.hidden
        for i in range(1, len(PLACES)):
            total += np.take(self.places[i], around[i], axis=0)
        return np.tanh(total)

    def stacked(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights with their biases as the last row: of the classes, and of the words in each."""
        whole = lambda weights, bias: np.concatenate([weights, np.expand_dims(bias, -2)], -2)
        return whole(self.to_class, self.class_bias), whole(self.to_word, np.maximum(self.word_bias, NEVER))

    def by_class(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of words (numbers in the vocabulary, or -1) by class, with those outside at the end, their classes in it, and (class, from, to) of the others."""
        classes, size = self.word_bias.shape
        kind = np.where(word < 0, classes, word // max(1, size))
        order = np.argsort(kind.astype(np.uint16) if classes < 1 << 16 else kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=classes + 1)[:classes]).tolist()
        return order, np.take(kind, order), [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]

    def within(self, h: np.ndarray, by_word: np.ndarray, groups: list[tuple[int, int, int]], most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """As _exponents, of the words in the class of each row of h; rows lie by class."""
        logits = np.empty((len(h), self.word_bias.shape[1]), h.dtype)
        for c, a, b in groups:
            np.dot(h[a:b], by_word[c], out=logits[a:b])
        return _exponents(logits, most)

    def log_chances(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log-probability of each word, or of being outside the vocabulary (-1)."""
        out = np.empty(len(word), np.float32)
        size = self.word_bias.shape[1]
        by_class, by_word = self.stacked()
        most, most_within = largest(by_class), largest(by_word)
        for i in range(0, len(word), SCORED):
            order, kind, groups = self.by_class(word[i : i + SCORED])
            order += i
            h = _with_ones(self.activation(np.take(around.T, order, axis=0).T))
            share, sums = _exponents(h @ by_class, most)
            chance = share[np.arange(len(order)), kind] / sums
            if groups:
                inside = groups[-1][2]
                share, sums = self.within(h[:inside], by_word, groups, most_within)
                chance[:inside] *= share[np.arange(inside), np.take(word, order[:inside]) % size] / sums
            out[order] = np.log(np.maximum(chance, 1e-30))
        return out

    def gradients(self, near: np.ndarray, word: np.ndarray, stacked: tuple[np.ndarray, np.ndarray] | None = None, most: tuple[float, float] | None = None, some: np.ndarray | None = None) -> Gradients:
        """Of the mean of -log_chances over words, with what is around them.

        stacked: weights in place of the network's own; most: what is known to be no less than their logits; some: the words to take.
        """
        by_class, by_word = stacked or self.stacked()
        most, most_within = most or (largest(by_class), largest(by_word))
        order, kind, groups = self.by_class(word if some is None else np.take(word, some))
        if some is not None:
            order = np.take(some, order)
        near, dim, n = np.take(near.T, order, axis=0).T, len(self.hidden), len(order)
        h = self.activation(near)
        ones = _with_ones(h)
        back, of_class, of_word = np.empty_like(h), np.zeros_like(by_class), np.zeros_like(by_word)
        # A block's logits stay in the cache from the product that makes them to those that use them.
        for i in range(0, n, BLOCK):
            part, own = ones[i : i + BLOCK], kind[i : i + BLOCK]
            error, sums = _exponents(part @ by_class, most)
            error[np.arange(len(own)), own] -= sums
            share = (1 / (n * sums))[:, None]  # what would divide the errors divides the narrower sides of the products
            np.multiply(error @ by_class[:dim].T, share, out=back[i : i + BLOCK])
            of_class += (part * share).T @ error
        inside = groups[-1][2] if groups else 0
        place = np.take(word, order[:inside]) % max(1, by_word.shape[2])
        inner, first = np.empty((inside, dim), h.dtype), 0
        while first < len(groups):
            start, last = groups[first][1], first + 1
            while last < len(groups) and groups[last][2] - start <= BLOCK:
                last += 1
            block, end = [(c, a - start, b - start) for c, a, b in groups[first:last]], groups[last - 1][2]
            part, own, first = ones[start:end], inner[start:end], last
            error, sums = self.within(part, by_word, block, most_within)
            error[np.arange(end - start), place[start:end]] -= sums
            share = (1 / (n * sums))[:, None]
            part = part * share
            for c, a, b in block:
                some_error = error[a:b]
                np.dot(some_error, by_word[c, :dim].T, out=own[a:b])
                np.dot(part[a:b].T, some_error, out=of_word[c])
            own *= share
        back[:inside] += inner
        back *= 1 - h * h
        inputs = self.places.shape[1]
        return Gradients(*_row_sums(near, back, inputs), inputs, back.sum(0), of_class, of_word, [c for c, _, _ in groups])

    def train(self, inputs: np.ndarray, words: np.ndarray, lengths: np.ndarray, edge: int, epochs: int, rate: float, seed: int) -> None:
        """Adagrad over texts that lie one after another, in a fixed order of batches."""
        Trainer(self).train(inputs, words, lengths, edge, epochs, rate, seed)

    def flat(self) -> np.ndarray:
        """All parameters one after another."""
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)]).astype(np.float32)

    def with_flat(self, values: np.ndarray) -> Network:
        """A network of this shape with other parameters."""
        out, at = {}, 0
        for f in fields(self):
            old = getattr(self, f.name)
            out[f.name] = values[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Network(**out)


class Trainer:
    """Trains a network in place by Adagrad, and remembers how far each parameter has moved from one call to the next."""

    def __init__(self, network: Network):
        self.network = network
        self.stacked = network.stacked()
        self.seen = [np.full(v.shape, 1e-6, np.float32) for v in (*self.stacked, network.hidden)]
        self.seen_places = np.full(network.places.shape[0] * network.places.shape[1], 1e-6, np.float32)

    def train(self, inputs: np.ndarray, words: np.ndarray, lengths: np.ndarray, edge: int, epochs: int, rate: float, seed: int) -> None:
        """Learn from texts that lie one after another, in a fixed order of batches."""
        rng, net = np.random.default_rng(seed), self.network
        around = windows(inputs, lengths, edge)
        places, dim = net.places.reshape(-1, net.places.shape[2]), len(net.hidden)
        whole = np.dtype((np.void, places.itemsize * dim))  # rows are written as one item each
        items = places.view(whole).ravel()
        # A few classes at once: what is made in between stays in the cache.
        parts = [(k, slice(i, i + TOGETHER), value[i : i + TOGETHER], seen[i : i + TOGETHER]) for k, (value, seen) in enumerate(zip((*self.stacked, net.hidden), self.seen, strict=True)) for i in range(0, len(value), TOGETHER)]
        most, moved = (0.0, 0.0), np.inf
        for _ in range(epochs):
            mixed = rng.permutation(len(words))
            for i in range(0, len(words), BATCH):
                if max(most) + moved >= 80:  # a step of Adagrad moves no parameter by more than the rate
                    most, moved = tuple(largest(v) for v in self.stacked), 0.0
                g = net.gradients(around, words, self.stacked, tuple(m + moved for m in most), mixed[i : i + BATCH])
                moved += 1.01 * rate * (dim + 1)
                total = np.take(self.seen_places, g.rows) + np.einsum("ij,ij->i", g.of_rows, g.of_rows) / dim
                self.seen_places[g.rows] = total
                moved_rows = np.take(places, g.rows, axis=0)
                moved_rows -= g.of_rows * (rate / np.sqrt(total))[:, None]
                items[g.rows] = moved_rows.view(whole).ravel()
                changes = g.by_class, g.by_word, g.hidden
                for k, part, value, seen in parts:
                    change = changes[k][part]
                    step = change * change
                    seen += step
                    np.sqrt(seen, out=step)
                    np.divide(change, step, out=step)
                    step *= rate
                    value -= step
        by_class, by_word = self.stacked
        net.to_class, net.class_bias, net.to_word = by_class[:-1], by_class[-1], by_word[:, :-1]
        net.word_bias = np.where(np.isneginf(net.word_bias), net.word_bias, by_word[:, -1])
