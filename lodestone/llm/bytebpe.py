"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A .tiktoken rank file becomes a tokenizers BPE model: bytes are written as the
256 characters of byte-level vocabularies, and every split of a token into two
tokens becomes a merge, in the order of the token's rank.  Texts are cut where
the pattern can be applied to each part by itself; each distinct part of a
batch is encoded once, and its offsets tell which bytes each id stands for.
Decoding takes ids back to characters and those to bytes; since an id may hold
a piece of a character, texts are put together as bytes before they are read
as UTF-8, and decode_text() holds a split character back until it is whole.

The library breaks ties between two splits of one token by merge order, the
rank file's own rule by position.  That can matter only for tokens with several
splits: where such a token overlaps itself in a match, or, if a longer token that
begins or ends with it has a lower rank, where it occurs twice.  An automaton over
these patterns finds such matches, 1 in 50 of the distinct ones of the test
tables; they are merged by the rule itself (by_rank).

Null texts count as empty: 0 tokens and the digests of no bytes.  Repeated rows
and ids are encoded like any others, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices, texts_of
from lodestone.llm.wordbpe import byte_characters

REMEMBERED = 500_000

#: Where white space is doubled, first or last, the library's own splitter finds the matches of the pattern.
_UNUSUAL = re.compile("\\s\\s|^\\s|\\s\\Z")


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core already
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        chars = byte_characters()
        table = {i: c for i, c in enumerate(chars)}
        self.byte_of = {ord(c): i for i, c in enumerate(chars)}
        show = lambda token: token.decode("latin-1").translate(table)
        vocab = {show(token): rank for token, rank in self.ranks.items()}
        merges = [
            (show(token[:k]), show(token[k:]))
            for token in sorted(self.ranks, key=self.ranks.get)
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.shown = {rank: token for token, rank in vocab.items()}
        top = max(self.tokens) + 1
        self.size = np.zeros(top, np.int64)
        self.size[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.decimal = [b"%d," % i for i in range(top)]
        self.digits = np.array([len(d) for d in self.decimal])
        self.library = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([self.splitter, to_bytes])
        self.longest = max(map(len, self.ranks))
        self.doubts = self._doubts()

    def _doubts(self) -> ahocorasick.Automaton:
        """Patterns with numbers: a match is in doubt that holds one of number 0, or one of another number twice.

        Two candidates for the next merge tie only if they make the same token.  By equal splits both rules take the left
        one.  By different splits the order matters if they share bytes, or if what the first makes is merged on, with what
        stands between them, before the second's turn: then a longer token has a lower rank.
        """
        ranks = self.ranks
        split = [t for t in ranks if sum(t[:k] in ranks and t[k:] in ranks for k in range(1, len(t))) > 1]
        eager = set()
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = token[:k], token[k:]
                if a in ranks and b in ranks:
                    eager |= {t for t in (a, b) if ranks[t] > rank}
        found = ahocorasick.Automaton()
        for number, t in enumerate(filter(eager.__contains__, split), 1):
            found.add_word(t.decode("latin-1"), number)
        for t in split:
            for k in range(1, len(t)):
                if t.endswith(t[:k]):
                    found.add_word((t + t[k:]).decode("latin-1"), 0)
        found.make_automaton()
        return found

    def doubtful(self, data: bytes) -> bool:
        """Whether the library's order of merges could differ from the rank rule's in a match."""
        seen = set()
        for _, number in self.doubts.iter(data.decode("latin-1")) if len(self.doubts) else ():
            if not number or number in seen:
                return True
            seen.add(number)
        return False

    def matches(self, text: str) -> list[str]:
        """The matches of the pattern, which tile the text."""
        return [part for part, _ in self.splitter.pre_tokenize_str(text)]

    def encode_run(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that may follow one another in one text, flat, and how many belong to each part.

        They are encoded as that text; the bytes that the ids stand for tell where each part ends.
        """
        return self.settled(parts, np.array(self.library.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, dtype=np.int64))

    def encode_each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that stand for themselves."""
        return self.settled(parts, np.fromiter((i for x in self.library.encode_batch_fast(parts, add_special_tokens=False) for i in x.ids), np.int64))

    def settled(self, parts: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids dealt out to the parts, with ties within a match as the rank file has them."""
        data = [p.encode() for p in parts]
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(d) for d in data]), "right")
        counts = np.diff(ends, prepend=0)
        doubtful = [i for i, d in enumerate(data) if self.doubtful(d)]
        if doubtful:
            split = np.split(ids, ends[:-1])
            for i in doubtful:
                split[i] = np.array([x for m in self.matches(parts[i]) for x in self.by_rank(m.encode())], dtype=np.int64)
                counts[i] = len(split[i])
            ids = np.concatenate(split)
        return ids, counts

    def by_rank(self, data: bytes) -> list[int]:
        """Ids of one match: the pair of the lowest rank is merged first, of equal ranks the leftmost."""
        if data in self.ranks:
            return [self.ranks[data]]
        n = len(data)
        end = list(range(1, n + 1))  # of the symbol that begins here; 0: none does
        before = list(range(-1, n))  # where the symbol before begins
        waiting: list[tuple[int, int, int]] = []

        def offer(at: int, to: int) -> None:
            rank = self.ranks.get(data[at:to]) if to - at <= self.longest else None
            if rank is not None:
                heapq.heappush(waiting, (rank, at, to))

        for i in range(n - 1):
            offer(i, i + 2)
        while waiting:
            _, at, to = heapq.heappop(waiting)
            middle = end[at]
            if not middle or middle >= n or end[middle] != to:
                continue  # one of the two is part of another symbol by now
            end[at], end[middle], before[to] = to, 0, at
            if to < n:
                offer(at, end[to])
            if at:
                offer(before[at], to)
        return [self.ranks[data[i:j]] for i, j in enumerate(end) if j]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids: their characters, each turned back by the byte table."""
        return "".join(map(self.shown.__getitem__, ids)).translate(self.byte_of).encode("latin-1")

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as ids come in; a character split between ids appears with the id that completes it."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield reader.decode(self.decode([i]))
        yield reader.decode(b"", True)


class PartMemory:
    """For each distinct part of the texts its ids as decimals with commas, and the bytes that the ids decode to."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        #: By the text after a space, by the text at a beginning, by the match in an unusual text.
        self.after, self.first, self.match = {}, {}, {}

    def learn(self, known: dict, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        if len(known) > REMEMBERED:  # what this batch lacks is learned here, the rest of it is found already
            known.clear()
        bpe, flat = self.bpe, ids.tolist()
        decimals, decoded = b"".join(map(bpe.decimal.__getitem__, flat)), bpe.decode(flat)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.concatenate([[0], np.cumsum(bpe.digits[ids])])[ends].tolist()
        to = np.concatenate([[0], np.cumsum(bpe.size[ids])])[ends].tolist()
        for i, part in enumerate(parts):
            known[part] = (decimals[at[i] : at[i + 1]], decoded[to[i] : to[i + 1]])

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text all its ids as decimals, a comma after each, and the bytes they decode to."""
        # Without doubled white space no match crosses from one part to the next: a match takes at most one space, in front.
        usual = [not _UNUSUAL.search(t) for t in texts]
        split = [t.split(" ") if u else self.bpe.matches(t) for t, u in zip(texts, usual, strict=True)]
        self.first.clear()  # beginnings do not come again
        if heads := list({s[0] for s, u in zip(split, usual, strict=True) if u}):
            self.learn(self.first, heads, *self.bpe.encode_each(heads))
        known = [self.after if u else self.match for u in usual]
        rest = [s[1:] if u else s for s, u in zip(split, usual, strict=True)]
        found = [list(map(k.get, r)) for k, r in zip(known, rest, strict=True)]
        gaps = [[i for i, x in enumerate(v) if x is None] for v in found]
        lacking = lambda kind: list({r[i] for u, r, g in zip(usual, rest, gaps, strict=True) if u == kind for i in g})
        if parts := lacking(True):
            self.learn(self.after, parts, *self.bpe.encode_run([" " + p for p in parts]))
        if parts := lacking(False):
            self.learn(self.match, parts, *self.bpe.encode_each(parts))
        for k, r, v, g in zip(known, rest, found, gaps, strict=True):
            for i in g:
                v[i] = k[r[i]]
        whole = [[self.first[s[0]], *v] if u else v for s, u, v in zip(split, usual, found, strict=True)]
        return [(b"".join([x[0] for x in v]), b"".join([x[1] for x in v])) for v in whole]


@cache
def part_memory(path: str, pattern: str) -> PartMemory:
    """One memory for each Python worker and file."""
    return PartMemory(ByteBpe(path, pattern))


def character_starts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The characters in which bytes of UTF-8 lie."""
    return np.cumsum(np.append((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, True))[starts] - 1


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, the ids of its whole text, and where each of them begins: the byte of the UTF-8, and the character that this byte is part of."""
    id_type = docs.schema[id_col].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = part_memory(path, pattern)
        for batch in slices(batches, 64):
            found = memory.texts(texts_of(batch[1]))
            ids = [np.array(decimals.split(b",")[:-1], dtype=np.int64) for decimals, _ in found]
            starts = [np.cumsum(memory.bpe.size[x]) - memory.bpe.size[x] for x in ids]
            # The library's own offsets, unless a tie was settled otherwise.
            told = memory.bpe.library.encode_batch(texts_of(batch[1]), add_special_tokens=False)
            chars = [np.array([a for a, _ in e.offsets], np.int64) if e.ids == x.tolist() else character_starts(data, y) for e, x, (_, data), y in zip(told, ids, found, starts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(ids, pa.list_(pa.int64())).cast(pa.list_(pa.int32())), pa.array(starts, longs), pa.array(chars, longs)], [id_col, "ids", "starts", "char_starts"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, starts array<long>, char_starts array<long>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """For each row of encode()'s result its id and text; a null list gives the empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = part_memory(path, pattern).bpe
        for batch in slices(batches, 64):
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, text string")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_tokens, and SHA-256 of its decimal ids joined by commas and of the bytes they decode to."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = part_memory(path, pattern)
        for batch in slices(batches):
            found = memory.texts(texts_of(batch[1]))
            columns = [
                batch[0],
                pa.array([decimals.count(b",") for decimals, _ in found], pa.int64()),
                pa.array([hashlib.sha256(decimals[:-1]).hexdigest() for decimals, _ in found]),
                pa.array([hashlib.sha256(decoded).hexdigest() for _, decoded in found]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
