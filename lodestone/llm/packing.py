"""Packing of examples into training sequences: vector bin packing by dot product.

A sequence has three limits at once: tokens, segments (pieces of examples) and
loss-bearing tokens.  Each example asks for a vector of the three; the open
sequence takes the example whose vector has the largest dot product with what
the sequence still has free, as long as one fits whole.  Then the gap is filled
with a cut from the largest example left, so that sequences end full.  Of an
example with a prompt (instruction data) only the ids after the prompt bear loss.

Every Spark task packs its own rows, a window of examples at a time, and keeps
only those that are not placed yet; there is no shuffle.  The last examples of
a task go into sequences whose lengths are powers of two, which need no padding.

Null texts and prompts count as empty: an example without either is its end
token alone.  An empty table gives no row.  Repeated rows and ids are packed like
any others, other columns are ignored.  Sequence ids are unique across tasks
and the same when a task runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, texts_of
from lodestone.llm.wordbpe import word_memory

#: Bits of a sequence id that count within a task.
TASK_BITS = 33


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    #: Loss-bearing tokens of a sequence; None: as many as tokens.
    loss: int | None = None

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, 1 if self.loss is None else self.loss) < 1:
            raise ValueError("a sequence holds a token, a segment and a loss-bearing token at least")

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.tokens if self.loss is None else self.loss], dtype=float)


@dataclass
class Packer:
    """Places examples; `pieces` gets (example, start, length, sequence, offset, loss-bearing tokens) for each piece."""

    limits: Limits
    pieces: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def __post_init__(self) -> None:
        self.name = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.left = np.zeros(0, np.int64)
        #: Ids of the example that bear no loss, from its start on (a prompt).
        self.quiet = np.zeros(0, np.int64)

    def add(self, name: list[int], length: list[int], quiet: list[int] | None = None) -> None:
        self.name = np.concatenate([self.name, np.array(name, np.int64)])
        self.start = np.concatenate([self.start, np.zeros(len(name), np.int64)])
        self.left = np.concatenate([self.left, np.array(length, np.int64)])
        self.quiet = np.concatenate([self.quiet, np.zeros(len(name), np.int64) if quiet is None else np.array(quiet, np.int64)])

    def loss(self) -> np.ndarray:
        """Loss-bearing tokens that are left of each example."""
        return np.minimum(self.left, np.maximum(self.start + self.left - self.quiet, 0))

    def drop(self, at: int) -> None:
        """Forget an example; the last one takes its place."""
        for values in (self.name, self.start, self.left, self.quiet):
            values[at] = values[-1]
        self.name, self.start, self.left, self.quiet = self.name[:-1], self.start[:-1], self.left[:-1], self.quiet[:-1]

    def fill(self, tokens: int) -> None:
        """One sequence of at most `tokens` tokens."""
        most = self.limits.vector
        free = np.minimum(most, [tokens, np.inf, np.inf])
        offset = 0
        while free[0] >= 1 and free[1] >= 1 and len(self.left):
            loss = self.loss()
            fits = (self.left <= free[0]) & (loss <= free[2])
            if free[1] == 1:  # the last segment should fill the gap
                fits &= self.left == free[0]
            if fits.any():
                # What an example asks for is (left, 1, loss); the product is of shares of the limits.
                weight = free / most**2
                product = self.left * weight[0] + (loss * weight[2] + weight[1])
                at = int(np.argmax(np.where(fits, product, -1)))
                length = int(self.left[at])
            else:
                # A cut may take what bears no loss, and as much loss as is still allowed.
                cut = np.minimum(np.minimum(self.left, free[0]), np.maximum(self.quiet - self.start, 0) + free[2])
                at = int(np.argmax(np.where(cut >= 1, self.left, -1)))
                length = int(cut[at])
                if length < 1:  # no example has a prompt left, and no more loss is allowed here
                    break
            borne = max(0, length - max(0, int(self.quiet[at] - self.start[at])))
            self.pieces.append((int(self.name[at]), int(self.start[at]), length, self.sequences, offset, borne))
            offset += length
            free -= [length, 1, borne]
            self.start[at] += length
            self.left[at] -= length
            if not self.left[at]:
                self.drop(at)
        self.sequences += 1

    def drain(self, keep: int) -> None:
        """Full sequences until at most `keep` sequences' worth of tokens is left to choose from."""
        while len(self.left) and int(self.left.sum()) > keep * self.limits.tokens:
            self.fill(self.limits.tokens)

    def finish(self) -> None:
        """Everything that is left; the end in sequences of a power of two."""
        self.drain(1)
        while len(self.left):
            total = int(self.left.sum())
            self.fill(min(self.limits.tokens, 1 << (total.bit_length() - 1)))


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, kept: int = 32) -> DataFrame:
    """One row for each piece of each text's ids (tokenizers file at path, then end_id) in sequences under limits.

    prompt_col: text whose ids come before those of the text and bear no loss (for example the turns of a conversation
    that are not the assistant's).  kept: sequences' worth of tokens that a task leaves open while more examples come.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = [id_col, *(part.split()[0] for part in SCHEMA.split(", "))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory(path, True)
        first = TaskContext.get().partitionId() << TASK_BITS
        packer, open_docs, number, kind = Packer(limits), {}, 0, None

        def each(texts: list[str]) -> list[memoryview]:
            ids, n = memory.token_ids(texts)
            data, ends = memoryview(ids.tobytes()), (4 * np.cumsum(n)).tolist()
            return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

        def placed() -> pa.RecordBatch:
            rows = []
            for name, start, length, sequence, offset, borne in packer.pieces:
                doc, data = open_docs[name]
                rows.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(data) // 4, first + sequence, offset, borne))
            packer.pieces.clear()
            waiting = set(packer.name.tolist())
            for name in [n for n in open_docs if n not in waiting]:
                del open_docs[name]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in slices(batches):
            kind = batch.schema.types[0]
            prompts = each(texts_of(batch[2])) if prompt_col else [b""] * batch.num_rows
            added, quiet = [], []
            for doc, before, own in zip(batch[0].to_pylist(), prompts, each(texts_of(batch[1])), strict=True):
                open_docs[number] = (doc, b"".join([before, own, end]))
                added.append(number)
                quiet.append(len(before) // 4)
                number += 1
            packer.add(added, [len(open_docs[n][1]) // 4 for n in added], quiet)
            packer.drain(kept)
            yield placed()
        if kind is not None:
            packer.finish()
            yield placed()

    source = docs.select(*(F.col(f"`{c}`") for c in (id_col, text_col, prompt_col) if c))
    return source.mapInArrow(pack, f"`{id_col}` {id_type}, {SCHEMA}")
