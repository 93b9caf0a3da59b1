"""BPE encoding and decoding by forced boundaries.

No merge can join two bytes that stand side by side in no vocabulary token, so a
text may be cut between them before it is encoded: the pieces on both sides are
encoded by themselves and their ids follow one another.  A table of 256 x 256
byte pairs, made from the vocabulary, marks these cuts; the distinct fragments of
a text are encoded once by the tokenizers library and remembered.

The library also splits texts by a pattern before it merges, and takes added
tokens out before that.  A cut must leave both as they were:

* It lies between characters, so every fragment is text.
* It never follows white space: what the pattern makes of a run of white space
  depends on what follows it.
* It never precedes an apostrophe, which could begin a contraction there.
* Pairs inside of contractions and of added tokens are no cuts.

Elsewhere a match that a cut divides is a run of one kind of character, and both
parts are matched as such runs.  Tokenizers of another make are refused.

Null texts count as empty: 0 tokens and the digests of no bytes.  Repeated rows,
equal or null ids are encoded like any others, an empty table gives an empty
result, and other columns are ignored whatever their names.  A text without cuts
is one fragment, however long.  Strings of added tokens inside a text become
their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices, texts_of
from lodestone.llm.wordbpe import byte_characters

#: Fragments that a worker remembers, and the bytes of the longest of them.
REMEMBERED, SHORT = 400_000, 64

#: The contractions of the pattern that byte-level tokenizers split texts by; the fixed part of their format.
CONTRACTIONS = [b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"]
#: White space of one byte, control characters that some tables count as white space among it.
_SPACES = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])


class CutBpe:
    """A byte-level BPE tokenizer whose texts are cut at forced boundaries."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self._refuse_others(made)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        own = {i: bytes(map(byte_of.__getitem__, token)) for token, i in made["model"]["vocab"].items()}
        added = {x["id"]: x["content"].encode() for x in made["added_tokens"]}
        self.bytes_of = own | added
        self.inside = np.zeros((256, 256), bool)
        for token in [*own.values(), *added.values(), *CONTRACTIONS]:
            self.inside[list(token[:-1]), list(token[1:])] = True
        cuts = ~self.inside
        cuts[_SPACES, :] = False
        cuts[:, ord("'")] = False
        cuts[:, 0x80:0xC0] = False  # the middle of a character
        self.cuts = cuts.ravel()
        self.known: dict[bytes, tuple[bytes, int, bytes]] = {}

    @staticmethod
    def _refuse_others(made: dict) -> None:
        """Only tokenizers for which the reasons above hold."""
        split, model, added = made["pre_tokenizer"] or {}, made["model"], made["added_tokens"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and made["normalizer"] is None
        whole = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not (plain and whole) or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("forced boundaries need a byte-level BPE model, its own pattern and added tokens that take no white space")

    def boundaries(self, data: bytes) -> np.ndarray:
        """Where UTF-8 text is cut: the byte that each fragment begins with."""
        b = np.frombuffer(data, np.uint8)
        if len(b) < 2:
            return np.zeros(len(b), np.int64)
        at = np.flatnonzero(self.cuts[(b[:-1].astype(np.intp) << 8) | b[1:]]) + 1
        wide = b[at - 1] >= 0x80
        if wide.any():  # the last byte of a longer character: of white space perhaps
            i = at[wide]
            one, two, three = b[i - 1], b[i - 2], b[np.maximum(i - 3, 0)]
            blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
            blank |= (three == 0xE1) & ((two == 0x9A) & (one == 0x80) | (two == 0xA0) & (one == 0x8E))
            blank |= (three == 0xE2) & ((two == 0x80) | (two == 0x81))
            blank |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
            keep = np.ones(len(at), bool)
            keep[wide] = ~blank
            at = at[keep]
        return np.concatenate([[0], at])

    def fragments(self, data: bytes) -> list[bytes]:
        """The text in pieces that are encoded by themselves."""
        starts = self.boundaries(data).tolist()
        return [data[i:j] for i, j in zip(starts, [*starts[1:], len(data)], strict=True)] if data else []

    def encode_each(self, fragments: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id may hold a part of a character."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def texts(self, texts: list[str]) -> list[list[tuple[bytes, int, bytes]]]:
        """For each text its fragments in order: their ids as decimals with a comma after each, how many, and the bytes that they decode to."""
        pieces = [self.fragments(t.encode()) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({f for p in pieces for f in p if f not in known})
        extra: dict[bytes, tuple[bytes, int, bytes]] = {}
        for fragment, ids in zip(new, self.encode_each(new), strict=True):
            decoded = self.decode_bytes(ids)
            entry = (b"".join([b"%d," % i for i in ids]), len(ids), fragment if decoded == fragment else decoded)
            (known if len(fragment) <= SHORT else extra)[fragment] = entry
        if not extra:
            return [list(map(known.__getitem__, p)) for p in pieces]
        return [[known.get(f) or extra[f] for f in p] for p in pieces]


@cache
def cut_bpe(path: str) -> CutBpe:
    """One for each Python worker and file."""
    return CutBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, the ids of its whole text, and the fragments that it was cut into."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cut_bpe(path)
        for batch in slices(batches, 64):
            found = bpe.texts(texts_of(batch[1]))
            ids = [np.array(b"".join([x[0] for x in f]).split(b",")[:-1], dtype=np.int32) for f in found]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(ids, pa.list_(pa.int32())), pa.array([len(f) for f in found], pa.int64())], [id_col, "ids", "n_fragments"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, n_fragments long")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """For each row of encode()'s result its id and text; a null list gives the empty text, bytes that are no text U+FFFD."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cut_bpe(path)
        for batch in slices(batches, 64):
            texts = [bpe.decode_bytes(ids or []).decode("utf-8", "replace") for ids in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_tokens, and SHA-256 of its decimal ids joined by commas and of the text they decode to."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def digest(parts: list[bytes]) -> str:
        return hashlib.sha256(b"".join(parts)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cut_bpe(path)
        for batch in slices(batches):
            found = bpe.texts(texts_of(batch[1]))
            decoded = [b"".join([x[2] for x in f]).decode("utf-8", "replace").encode() for f in found]
            columns = [
                batch[0],
                pa.array([sum([x[1] for x in f]) for f in found], pa.int64()),
                pa.array([digest([b"".join([x[0] for x in f])[:-1]]) for f in found], pa.string()),
                pa.array([digest([d]) for d in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
