"""Document fingerprints by winnowing.

The k-gram hashes of a text come from doubling a polynomial hash; of every
window of w successive k-grams the smallest hash is chosen, the rightmost one
in a tie, and kept with its position.  Two texts that share w + k - 1
characters in a row share a chosen hash.

A fingerprint is a string of ten hexadecimal digits for each chosen k-gram: two
for the step from the position before (from 0 for the first), eight for the
hash; a step is never longer than the window, which is 255 at most.  A text of fewer than k characters is hashed as one; the empty (or null)
text has the empty fingerprint.  Likeness is the Jaccard similarity of the sets
of chosen hashes; two empty fingerprints are alike (1.0).

neighbours() also compares each text with an edited one and with the next row
by id, which has to be a whole number.  Rows with a null id come first; equal ids
are ordered by text.  No row gives an empty result; a single row is its own next.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm.common import slices, texts_of

K, WINDOW = 12, 48
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(32))


def chosen(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes that winnowing chooses."""
    if not 1 <= window <= 255 or k < 1:
        raise ValueError(f"k of at least 1 and windows from 1 to 255: {k}, {window}")
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    k = min(k, len(points))
    points = _mixed(points + np.uint64(1))
    # Hashes of 1, 2, 4, ... characters; k is put together from the powers of two in it.
    power, length, step, have, hashes = points, 1, np.array([_BASE]), 0, None
    while True:
        if k & length:
            if hashes is None:
                hashes, have = power, length
            else:
                n = len(points) - have - length + 1
                hashes = hashes[:n] * step + power[have : have + n]
                have += length
        if length * 2 > k:
            break
        power = power[:-length] * step + power[length:]
        step, length = np.multiply(step, step), length * 2
    hashes = _mixed(hashes) >> np.uint64(32)
    at = np.arange(len(hashes), dtype=np.uint64)
    least, size = hashes << np.uint64(32) | (_LOW - at), 1  # of equal hashes the rightmost is the smallest
    window = min(window, len(hashes))
    while size < window:
        step_by = min(size, window - size)
        least = np.minimum(least[:-step_by], least[step_by:])
        size += step_by
    least = least[np.flatnonzero(np.diff(least, prepend=~least[:1]))]
    return (_LOW - (least & _LOW)).astype(np.int64), (least >> np.uint64(32)).astype(np.uint32)


def fingerprint(positions: np.ndarray, hashes: np.ndarray) -> str:
    rows = np.empty((len(hashes), 5), np.uint8)
    rows[:, 0] = np.diff(positions, prepend=0)
    rows[:, 1:] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    return rows.tobytes().hex()


def likeness(a: set[int], b: set[int]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """For each row its id and the fingerprint of its whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(*chosen(t, k, window)) for t in texts_of(batch[1])]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(found, pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (bucket, tail, id, text), dealt by bucket and sorted: in each bucket the ids of one range, then with tail = 1 the row that follows it.

    The ranges begin at ids that are quantiles of all ids; only these bounds reach the driver.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} is no whole number: {kind.simpleString()}")
    shares = [i / (4 * parts) for i in range(4 * parts)]
    bounds, nulls, null_text = docs.agg(F.expr(f"approx_percentile(`{id_col}`, array({','.join(map(str, shares))}), {max(10_000, 40 * parts)})"), F.count_if(F.col(id_col).isNull()), F.xxhash64(F.min(F.when(F.col(id_col).isNull(), F.coalesce(text_col, F.lit("")))))).first()
    bounds = np.array(sorted(set(bounds or [])), dtype=np.int64)
    last = max(0, len(bounds) - 1)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = np.searchsorted(bounds, ids.fillna(-(2**63)).to_numpy(np.int64), "right") - 1
        return pd.Series(np.maximum(known, 0), dtype="int32")

    @F.pandas_udf("boolean")
    def begins(ids: pd.Series) -> pd.Series:
        return ids.isin(bounds)

    place = lambda bucket, tail: F.struct(bucket.cast("int").alias("bucket"), F.lit(tail).alias("tail"))
    # Of rows without an id only those with the smallest text can come first.
    first = F.col("id").isNull() & (F.xxhash64(F.coalesce("text", F.lit(""))) == null_text) if nulls else F.col("id") == F.lit(int(bounds[0]) if len(bounds) else 0)
    copies = F.array(
        place(F.col("bucket"), 0),
        F.when(F.col("begins") & (F.col("bucket") > 0), place(F.col("bucket") - 1, 1)),
        F.when(first, place(F.lit(last), 1)),
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"bucket": range_of("id"), "begins": begins("id")})
    return (
        rows.select("id", "text", F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("place"))
        .select("place.bucket", "place.tail", "id", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "tail", "id", "text")
    )


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """For each row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # bucket, id, text, positions and hashes, set of hashes
        for batch in slices(batches):
            out = []
            for bucket, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                same = before is not None and before[0] == bucket
                if tail and not same:
                    continue  # the rest of several rows that could follow
                marks = chosen(text, k, window)
                hashes = set(marks[1].tolist())
                if same:
                    _, own, own_text, own_marks, own_hashes = before
                    new = edited(own_text, text)
                    new_marks = chosen(new, k, window)
                    out.append((own, len(own_text), hashlib.sha256(new.encode()).hexdigest(), fingerprint(*own_marks), fingerprint(*new_marks), likeness(own_hashes, set(new_marks[1].tolist())), likeness(own_hashes, hashes)))
                before = None if tail else (bucket, doc, text, marks, hashes)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[2]), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names)

    return with_next(docs, id_col, text_col, parts).mapInArrow(run, f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
