"""Token counts: rank-synchronous array merging over batched pre-tokens.

Each batch of unseen pre-tokens is held as one ragged numpy array of symbol
ids.  In every round each pre-token applies its own lowest-rank pair, all
pre-tokens at once; a pre-token leaves when no pair of it is a merge.  The
surviving symbols are its tokens.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows and ids are kept
as they are; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices, texts_of, utf8_lengths

#: Words remembered by a Python worker, and as many from before; beyond it, those that are asked for again stay.
REMEMBERED = 400_000
#: New words merged at once.
WORDS = 50_000

NONE = np.iinfo(np.int64).max

# White space, letters and numbers up to U+024F follow Unicode's categories; beyond, the library's own rules are asked.
_LETTERS = "".join(chr(i) for i in range(0x250) if unicodedata.category(chr(i))[0] == "L")
_NUMBERS = "".join(chr(i) for i in range(0x250) if unicodedata.category(chr(i))[0] == "N")
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: 0 letters, 1 numbers, 2 others, 3 the line feed between words.
_KINDS = np.full(0x250, 2, np.int8)
_KINDS[[ord(c) for c in _LETTERS]] = 0
_KINDS[[ord(c) for c in _NUMBERS]] = 1
_KINDS[10] = 3
#: Characters for which str.split or the pattern above could differ from the library, and the mark of its added tokens.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-įı-ɏ]|<\\|")
#: The same in ASCII.
_MARKS = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


def is_unusual(text: str) -> bool:
    return any(mark in text for mark in _MARKS) if text.isascii() else _UNUSUAL.search(text) is not None


class RankMerger:
    """Byte-pair merges of many symbol sequences at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """merges: (left, right, merged) in rank order."""
        left, right, new = np.array(merges, dtype=np.int64).reshape(-1, 3).T
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order, new
        # Most keys have a slot of their own in a table by hash; the few others are searched for.
        self.shift = np.uint64(64 - max(4, len(keys).bit_length() + 3))
        slots = self.slots(self.keys)
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slots] = np.arange(len(keys))
        self.shared = np.zeros(len(self.table), bool)
        self.shared[slots[self.table[slots] != np.arange(len(keys))]] = True
        # A rank is settled if the symbol it makes takes part in no merge of a lower rank:
        # then all occurrences of the pair may be merged in one round.
        first_use = np.full(int(max(left.max(), right.max(), new.max())) + 1, NONE)
        np.minimum.at(first_use, left, np.arange(len(left)))
        np.minimum.at(first_use, right, np.arange(len(left)))
        self.settled = first_use[new] > np.arange(len(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slots = self.slots(keys)
        at = self.table[slots]
        some = np.flatnonzero(self.shared[slots])
        at[some] = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: the sequences one after another; lengths: of each, none 0.  The same after all merges."""
        done_rows, done_lengths, done_symbols = [], [], []
        symbols, names = symbols.astype(np.int64), np.arange(len(lengths))
        lengths = lengths.astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), NONE)  # of the pair that begins here
        inner = np.flatnonzero(row[:-1] == row[1:])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(lengths):
            best = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            over = best == NONE
            if over.any():
                gone = over[row]
                done_rows.append(names[over])
                done_lengths.append(lengths[over])
                done_symbols.append(symbols[gone])
                symbols, rank = symbols[~gone], rank[~gone]
                names, lengths, best = names[~over], lengths[~over], best[~over]
                row = np.repeat(np.arange(len(lengths)), lengths)
                if not len(lengths):
                    break
            hit = np.flatnonzero(rank == best[row])
            # Of overlapping occurrences (aaa) every second counts, from the left.
            begins = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            run = np.repeat(hit[begins], np.diff(begins, append=len(hit)))
            hit = hit[(hit - run) % 2 == 0]
            leftmost = np.diff(row[hit], prepend=-1) != 0
            hit = hit[leftmost | self.settled[best[row[hit]]]]
            symbols[hit] = self.new[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            lengths = lengths - np.bincount(row[hit], minlength=len(lengths))
            symbols, row, rank = symbols[keep], row[keep], rank[keep]
            # Only pairs with a merged symbol have another rank now.
            at = hit - np.arange(len(hit))
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = NONE
            at = at[at < len(row) - 1]
            at = at[row[at] == row[at + 1]]
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        rows, lengths = np.concatenate(done_rows), np.concatenate(done_lengths)
        flat = np.concatenate(done_symbols)
        order = np.argsort(rows, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        return flat[at], lengths


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """The word-end vocabulary of a tokenizers .json file: split, lower-case, merge."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.merger = RankMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]])
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], dtype=np.int64)

    def pretokens(self, word: str) -> list[str]:
        """Pre-tokens of a text without unusual characters."""
        return _PRETOKEN.findall(word.lower())

    def unusual_pretokens(self, text: str) -> list[str | int]:
        """Pre-tokens of any text by the library's normalizer and splitter; added tokens as their ids."""
        out: list[str | int] = []
        for part in self.added_pattern.split(text) if self.added_pattern else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(mapped)
        return out

    def merged(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens given as bytes, flat, and how many each has."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        data = np.frombuffer(b"".join(rows), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        return self.merger.merge(symbols, lengths)


class WordMemory:
    """Tokens of words (runs without white space), computed a batch at a time and remembered."""

    def __init__(self, bpe: WordBpe, ids: bool):
        self.bpe, self.ids = bpe, ids
        self.known: dict = {}
        #: What was known before the last renewal; a word that is asked for again is taken over from there.
        self.old: dict = {}
        self.unmap = {c: b for b, c in enumerate(byte_characters())}

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:  # what this batch lacks is learned below, the rest of it is found already
            self.old, self.known = self.known, {}
        quoted = [w for w in words if "'" in w]
        if quoted:
            words = [w for w in words if "'" not in w]
            pieces = [[x.encode() for x in self.bpe.pretokens(w)] for w in quoted]
            self.known.update(zip(quoted, self.values([x for p in pieces for x in p], list(map(len, pieces))), strict=True))
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            self.known.update(zip(part, self.plain(part), strict=True))

    def plain(self, words: list[str]) -> list:
        """Values of words without apostrophes: pre-tokens are runs of letters, single numbers, runs of others."""
        text = "\n".join(words).lower() + "\n"
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = _KINDS[points]
        begins = (kind != np.concatenate([[3], kind[:-1]])) | (kind == 1)
        inside = kind != 3
        width = 1 + (points >= 0x80).astype(np.int64)  # UTF-8 bytes of these characters
        piece = np.cumsum(begins & inside)[inside] - 1
        lengths = np.bincount(piece, weights=width[inside]).astype(np.int64)
        data = np.frombuffer(text.encode(), np.uint8)[np.repeat(inside, width)]
        symbols, ends = self.bpe.inner[data], np.cumsum(lengths) - 1
        symbols[ends] = self.bpe.last[data[ends]]
        flat, n = self.bpe.merger.merge(symbols, lengths)
        word = np.cumsum(~inside)[np.flatnonzero(begins & inside)]
        return self.cut(flat, np.bincount(word, weights=n, minlength=len(words)).astype(np.int64))

    def cut(self, flat: np.ndarray, counts: np.ndarray) -> list:
        if not self.ids:
            return counts.tolist()
        data = flat.astype("<u4").tobytes()
        cuts = [0, *(np.cumsum(counts) * 4).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def values(self, pieces: list[bytes], counts: list[int]) -> list:
        """For each group of counts[i] pieces: its ids as little-endian bytes, or its number of tokens."""
        if not pieces:
            return [b"" if self.ids else 0] * len(counts)
        flat, lengths = self.bpe.merged(pieces)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return self.cut(flat, np.diff(ends))

    def numbered(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of the distinct words of all texts, the number of each word among them, one text after another, and the words of each text.

        A small table, which stays in the cache, numbers all words; the memory is asked for the distinct ones.
        """
        lengths = []

        def each() -> Iterator[list]:
            for text in texts:
                split = [(x,) for x in self.unusual(text)] if is_unusual(text) else text.split()
                lengths.append(len(split))
                yield split  # numbered before the next text is split

        numbers: dict = defaultdict(count().__next__)
        places = np.fromiter(map(numbers.__getitem__, chain.from_iterable(each())), np.int64)
        words = list(numbers)
        values = list(map(self.known.get, words))
        missing, old = [], self.old.get
        for i in [i for i, x in enumerate(values) if x is None]:
            word = words[i]
            # A tuple holds the value of a pre-token of an unusual text.
            values[i] = value = word[0] if isinstance(word, tuple) else old(word)
            if value is None:
                missing.append(i)
            elif not isinstance(word, tuple):
                self.known[word] = value
        if missing:
            self.learn([words[i] for i in missing])
            for i in missing:
                values[i] = self.known[words[i]]
        return values, places, np.array(lengths, np.int64)

    def words(self, texts: list[str]) -> list[list]:
        """For each text the values of its words, in order."""
        values, places, lengths = self.numbered(texts)
        told = map(values.__getitem__, places.tolist())
        return [list(islice(told, n)) for n in lengths.tolist()]

    def token_counts(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text, of a memory without ids."""
        values, places, lengths = self.numbered(texts)
        before = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[places])]) if values else np.zeros(1, np.int64)
        ends = np.cumsum(lengths)
        return before[ends] - before[ends - lengths]

    def token_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has, of a memory with ids."""
        values, places, lengths = self.numbered(texts)
        flat = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        n = size[places]
        before = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(size) - size)[places] - before[:-1], n)
        at += np.arange(len(at))
        ends = np.cumsum(lengths)
        return flat[at], before[ends] - before[ends - lengths]

    def unusual(self, text: str) -> list:
        found = self.bpe.unusual_pretokens(text)
        own = iter(self.values([bytes(self.unmap[c] for c in x) for x in found if isinstance(x, str)], [1] * sum(isinstance(x, str) for x in found)))
        return [next(own) if isinstance(x, str) else int(x).to_bytes(4, "little") if self.ids else 1 for x in found]


@cache
def word_memory(path: str, ids: bool) -> WordMemory:
    """One memory for each Python worker, file and kind of value."""
    return WordMemory(WordBpe(path), ids)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_bytes, n_tokens and over_limit (n_tokens > limit) of its whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory(path, False)
        for batch in slices(batches):
            n = memory.token_counts(texts_of(batch[1]))
            yield pa.RecordBatch.from_arrays([batch[0], utf8_lengths(batch[1]), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(tell, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
