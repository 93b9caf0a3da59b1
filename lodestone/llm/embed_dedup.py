"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Equal vectors of a label are one class with a weight, so copies cost nothing.
Spherical k-means, fitted on a bounded sample of classes (the lowest by a hash
of the vector, SAMPLE rows and SAMPLE_BYTES at most), gives coarse cells, and
within each of them fine cells, as many as hold about RESIDENTS vectors each or
as the sample allows.  Every class has a home cell.  It also visits each cell
whose border with its home is nearer than half the largest distance of a link:
of two linked vectors with different homes, one at least is that near to the
border between them, so comparing the residents of a cell with its residents and
visitors finds every link.  A visitor of a coarse cell visits fine cells there
up to the whole distance of a link, so it meets the residents whatever their
own place.  A smaller margin visits less and may miss links.  Cells are compared
in blocks of at most BLOCK rows, block against block, so no task holds more than
two.

Vectors are compared when their labels are equal and not null.  Null vectors,
empty ones, and such with a zero norm, null or non-finite components link with
nothing; so do vectors of different length.  Vectors of another length than most
of the sample share one cell.  Every row gives one row; repeated rows and ids
count as other vectors.  Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, slices
from lodestone.llm.components import components

SAMPLE, SAMPLE_BYTES, BLOCK = 16_384, 32_000_000, 2048
#: Rows of the sample for each cell at least.
SAMPLED = 4
#: Residents of a cell aimed at, for each label.
RESIDENTS = 1024


def unit_vectors(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares may be too large or too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids of the unit rows x."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        dead = norms < 1e-12
        sums[dead] = x[rng.choice(len(x), int(dead.sum()))]
        norms[dead] = 1.0
        centroids = sums / norms[:, None]
    return centroids


def distances(centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))


def visited(x: np.ndarray, centroids: np.ndarray, apart: np.ndarray, margin: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cells of the unit rows x, and for each row and cell whether it goes there.  apart: distances of the centroids."""
    dots = x @ centroids.T
    home = np.argmax(dots, axis=1)
    border = dots[np.arange(len(x)), home][:, None] - dots
    go = border <= np.broadcast_to(margin, len(x))[:, None] * apart[home] + 1e-12
    go[np.arange(len(x)), home] = True
    return home, go


class Cells:
    """Coarse cells, and fine ones in each; a cell is named by its number among all fine ones."""

    def __init__(self, x: np.ndarray, wanted: int):
        """About `wanted` cells, fitted on the unit rows x."""
        wanted = max(1, min(wanted, len(x) // SAMPLED))
        self.coarse = spherical_kmeans(x, math.ceil(math.sqrt(wanted))) if wanted > 1 else np.eye(1, x.shape[1])
        home = np.argmax(x @ self.coarse.T, axis=1)
        self.fine = []
        for c in range(len(self.coarse)):
            own = x[home == c]
            k = min(len(own), round(wanted * len(own) / max(1, len(x))))
            self.fine.append(spherical_kmeans(own, k) if k > 1 else self.coarse[c : c + 1])
        self.first = np.cumsum([0, *map(len, self.fine)])
        self.apart, self.fine_apart = distances(self.coarse), [distances(f) for f in self.fine]

    def __len__(self) -> int:
        return int(self.first[-1])

    def of(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each unit row, and pairs (row, cell) of all cells that rows go to, in order."""
        home_coarse, go_coarse = visited(x, self.coarse, self.apart, margin)
        home, at, cell = np.zeros(len(x), np.int64), [], []
        for c in range(len(self.coarse)):
            rows = np.flatnonzero(go_coarse[:, c])
            resident = home_coarse[rows] == c
            own, go = visited(x[rows], self.fine[c], self.fine_apart[c], np.where(resident, margin, 2 * margin))
            home[rows[resident]] = self.first[c] + own[resident]
            i, j = np.nonzero(go)
            at.append(rows[i])
            cell.append(self.first[c] + j)
        at, cell = np.concatenate(at), np.concatenate(cell)
        order = np.lexsort((cell, at))
        return home, at[order], cell[order]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of n rows reaches by the pairs a, b."""
    src, dst = np.concatenate([a, b, np.arange(n)]), np.concatenate([b, a, np.arange(n)])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    starts = np.searchsorted(src, np.arange(n))
    root = np.arange(n)
    while True:
        new = np.minimum.reduceat(root[dst], starts)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of two blocks of one cell: for each class that has any the weight linked, and the smallest class that its links in here reach."""
    i, j, cell = int(rows["i"].iloc[0]), int(rows["j"].iloc[0]), int(rows["cell"].iloc[0])
    # The same class comes once for each key, so order alone fixes the result.
    rows = rows.sort_values("own", ignore_index=True)
    x = unit_vectors(rows["vector"].tolist())
    block, home = rows["block"].to_numpy(), rows["home"].to_numpy()
    weight = rows["weight"].to_numpy(np.float64)
    resident = home == cell
    homes, place = np.unique(home, return_inverse=True)
    visits = np.concatenate(rows["visits"].to_list())
    found = np.minimum(np.searchsorted(homes, visits), len(homes) - 1)
    hit = np.flatnonzero(homes[found] == visits)
    goes = np.zeros((len(rows), len(homes)), bool)  # (row, home of any row here)
    goes[np.repeat(np.arange(len(rows)), rows["visits"].map(len))[hit], found[hit]] = True
    found_a, found_b = [], []
    left = np.flatnonzero(resident)
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        hit = x[part] @ x.T >= threshold
        if i != j:
            hit &= block[part][:, None] != block[None]
        # Residents meet twice here: once is enough.  A visitor's own cell has this link too if the resident goes there, and the lower cell keeps it.
        hit &= np.where(resident[None], part[:, None] < np.arange(len(rows))[None], True)
        hit &= ~(~resident[None] & (home[None] < cell) & goes[part][:, place])
        a, b = np.nonzero(hit)
        found_a.append(part[a])
        found_b.append(b)
    a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
    if not len(a):
        return pd.DataFrame({"own": [], "root": [], "linked": []})
    linked = np.bincount(a, weights=weight[b], minlength=len(rows)) + np.bincount(b, weights=weight[a], minlength=len(rows))
    root = forest(a, b, len(rows))
    own = rows["own"].to_numpy()
    some = np.flatnonzero(linked)
    return pd.DataFrame({"own": own[some], "root": own[root[some]], "linked": linked[some].astype(np.int64)})


def near_vectors(vectors: DataFrame, threshold: float = 0.93, margin: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each row: id, n_links, component_id and kept.  margin: None for every link."""
    scratch = Scratch(vectors.sparkSession)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 if margin is None else margin
    id_type = vectors.schema[id_col].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """own: the digest of label and vector, null where nothing can be linked."""
        for batch in slices(batches, 4096):
            own = []
            for vector, label in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                good = vector and label is not None and None not in vector
                if good:
                    x = np.array(vector, dtype=np.float64) + 0.0  # -0.0 is 0.0
                    good = bool(np.isfinite(x).all() and x.any())
                own.append(hashlib.blake2b(repr(label).encode() + b"|" + x.tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(own, pa.binary()), batch[2].cast(pa.string()), batch[1].cast(pa.list_(pa.float64()))], ["id", "own", "label", "vector"])

    rows = scratch.write(vectors.select(id_col, vector_col, label_col).mapInArrow(name, f"id {id_type}, own binary, label string, vector array<double>"))
    classes = rows.where("own is not null").groupBy("own").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.count("*").alias("weight"), F.min("id").alias("least"))
    classes = scratch.write(classes.withColumn("dim", F.size("vector")))
    n, labels = classes.agg(F.count("*"), F.count_distinct("label", "dim")).first()
    # The length of most vectors, and as many of the first ones by hash as the bounds allow.
    usual = classes.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max_by("dim", F.struct("n", "dim"))).first()[0] or 1
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * usual)))
    sample = classes.where(F.col("dim") == usual).select("own", "vector").orderBy("own").limit(most).select("vector").toArrow()["vector"].combine_chunks()
    cells = Cells(unit_vectors(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, usual)) if len(sample) else np.zeros((0, usual)), math.ceil(n / max(1, labels) / RESIDENTS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each class and cell it goes to; vectors of another length than the centroids all stay in cell 0."""
        for batch in slices(batches, 1024):
            own, label, vector, weight, size = (c.to_pylist() for c in batch.columns)
            same = np.array(size) == usual
            home, at, cell = np.zeros(len(own), np.int64), np.flatnonzero(~same), np.zeros(int((~same).sum()), np.int64)
            if same.any():
                rows = np.flatnonzero(same)
                home[rows], i, j = cells.of(unit_vectors([vector[r] for r in rows]), reach)
                at, cell = np.concatenate([rows[i], at]), np.concatenate([j, cell])
            goes: list[list[int]] = [[] for _ in own]
            for i, c in zip(at.tolist(), cell.tolist(), strict=True):
                goes[i].append(c)
            visits = goes
            take = lambda values: [values[i] for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(take(own), pa.binary()), pa.array(take(label)), pa.array(take(vector), pa.list_(pa.float64())), pa.array(take(weight), pa.int64()), pa.array(take(size), pa.int32()), pa.array(cell, pa.int32()), pa.array(home[at], pa.int32()), pa.array(take(visits), pa.list_(pa.int32()))],
                ["own", "label", "vector", "weight", "dim", "cell", "home", "visits"],
            )

    there = classes.select("own", "label", "vector", "weight", "dim").mapInArrow(assign, "own binary, label string, vector array<double>, weight long, dim int, cell int, home int, visits array<int>")
    there = scratch.write(there)
    place = ["label", "dim", "cell"]
    blocks = there.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    keyed = there.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int"))
    # Block b meets every block: as i where b <= j, as j where i < b.
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    keyed = keyed.withColumn("end", F.explode(ends)).select("*", "end.i", "end.j").drop("end", "blocks")
    found = keyed.groupBy(*place, "i", "j").applyInPandas(lambda rows: compare(rows, threshold), "own binary, root binary, linked long")
    found = scratch.write(found)
    linked = found.groupBy("own").agg(F.sum("linked").alias("linked"))
    roots = components(scratch, found.select(F.col("own").alias("a"), F.col("root").alias("b")))
    named = classes.select("own", "least", "weight").join(linked, "own", "left").join(roots.withColumnRenamed("node", "own"), "own", "left")
    named = scratch.write(named.select("own", "least", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "own").alias("root")))
    lowest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.write(named.join(lowest, "root").select("own", "n_links", "component"))
    out = rows.select("id", "own").join(named, "own", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
