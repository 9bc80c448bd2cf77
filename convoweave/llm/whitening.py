"""Embedding whitening by Chan merging.

Entries are put on an integer grid, so that sums are exact. Each partition computes its count, exact sums, local mean and
the scatter about that mean; two parts merge by the pairwise formula (their scatters, and the outer product of the
difference of their means weighted by n * m / (n + m)), in a treeReduce whose depth grows with the partitions, so that no
merge takes more than a few matrices. The driver gets one matrix of d * d and its eigenvectors (eigh). A second pass
whitens every row and merges the covariance of the results in the same way: its largest distance from the identity is
`identity_error`. A third pass gives the rows; nothing is shuffled but the partial matrices.

The work grows with the rows, memory with d * d alone.

Defined results: rows whose vector is null or holds a null, non-finite or not representable entry (an x of 2^52 or more) are
dropped; vectors of each length are fitted by themselves, empty ones have no component and so no row; repeated rows count and
come out as often as they stand there, rows without vec_id as well; extra columns are ignored. Components without variance
(eigenvalue within rounding of zero) have a null `whitened` and take no part in `identity_error`, which is null where
none has any, as `explained` is where nothing varies; a deviation beyond a long is null. Equal eigenvalues leave the choice
of their eigenvectors open; it is the same for all rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from convoweave.llm.rows import slices
from convoweave.session import table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
WIDEST = 2.0**52  # of an x; sums of SLICE of them fit into a long
SLICE = 1024
FAN = 8  # matrices that a merge takes, about
LARGEST = 2**63 - 1


@dataclass
class Moments:
    """Count, exact sums, mean and scatter about the mean of some rows."""

    n: int
    sums: np.ndarray  # of Python integers
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n))
        return Moments(n, self.sums + other.sums, self.mean + gap * (other.n / n), scatter)


def moments(x: np.ndarray, pivot: int | float) -> Moments:
    """Of the rows of x, integers (whose sums are exact) or doubles; `pivot` is near all of them."""
    near = (x - pivot).astype(np.float64)
    mean = near.mean(axis=0)
    centred = near - mean
    return Moments(len(x), x.sum(axis=0).astype(object), mean, centred.T @ centred)


def merge(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """By length of vector."""
    return {d: a[d].merged(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length above 0: the places of the vectors of that length, and their entries as doubles, NaN for null."""
    ends = vectors.offsets.to_numpy()
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, flat[ends[at][:, None] + np.arange(d)]


def grid(vectors: pa.ListArray, scale: int, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that remain, and their entries on the grid, as longs."""
    for at, entries in by_length(vectors):
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(entries * scale) + offset
        sound = (np.abs(x) < WIDEST).all(axis=1)  # false for what is not finite
        if sound.any():
            yield at[sound], x[sound].astype(np.int64)


def tree_moments(rows: DataFrame, tell: Callable[[pa.ListArray], Iterator[tuple[int, Moments]]]) -> dict[int, Moments]:
    """The moments of all rows: `tell` gives those of a slice of vectors, by length."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Moments] = {}
        for b in slices(batches, SLICE):
            for d, m in tell(b.column(0)):
                mine = merge(mine, {d: m})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary())], ["part"])

    parts = rows.mapInArrow(part, "part binary").rdd
    n = parts.getNumPartitions()
    if not n:
        return {}
    return parts.map(lambda r: pickle.loads(r.part)).treeReduce(merge, depth=max(2, math.ceil(math.log(n, FAN)))) or {}


@dataclass
class Whitener:
    """What is fitted to the vectors of one length. axes: unit eigenvectors by falling eigenvalue, as columns."""

    n: int
    sums: list[int]
    mean: np.ndarray  # from OFFSET
    axes: np.ndarray
    values: np.ndarray
    trace: float
    offset: int
    identity_error: float | None = None

    @property
    def whole(self) -> np.ndarray:
        """Which components have a variance."""
        return self.values > self.trace * len(self.mean) * np.finfo(float).eps

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x on all components; NaN on those without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = ((x - self.offset) - self.mean) @ self.axes / np.sqrt(np.where(self.whole, self.values, np.nan))
        return scaled

    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.full(len(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n * x - sums)^2, exactly."""
        most = max(map(abs, self.sums)) + self.n * int(np.abs(x).max())
        if most < 2**62:
            gap = self.n * x - np.array(self.sums, np.int64)
            widest = int(np.abs(gap).max())
            if widest * widest * x.shape[1] <= LARGEST:
                return (gap * gap).sum(axis=1).tolist()
        exact = [sum((self.n * e - s) ** 2 for e, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [e if e <= LARGEST else None for e in exact]


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> dict[int, Whitener]:
    """The whiteners of the first column of `rows`, by length of vector, verified on all rows."""
    found = {}
    for d, m in tree_moments(rows, lambda vectors: ((x.shape[1], moments(x, offset)) for _, x in grid(vectors, scale, offset))).items():
        values, axes = np.linalg.eigh(m.scatter / m.n)
        order = np.argsort(-values, kind="stable")[:components]
        mean = np.array([(s - m.n * offset) / m.n for s in m.sums])
        found[d] = Whitener(m.n, list(map(int, m.sums)), mean, axes[:, order], values[order], float(np.trace(m.scatter) / m.n), offset)

    def results(vectors: pa.ListArray) -> Iterator[tuple[int, Moments]]:
        for _, x in grid(vectors, scale, offset):
            w = found[x.shape[1]]
            yield x.shape[1], moments(w.whitened(x)[:, w.whole], 0)

    for d, m in tree_moments(rows, results).items():
        if m.scatter.size:
            found[d].identity_error = float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max())
    return found


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each remaining row and component."""
    rows = vectors.select(F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{vec_id}`").alias("vec_id"))
    shared = vectors.sparkSession.sparkContext.broadcast(fit(rows.select("embedding"), components, scale, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            for at, x in grid(b.column(0), scale, offset):
                w = shared.value[x.shape[1]]
                k, m = len(w.values), len(at)
                found = w.whitened(x).ravel()
                explained = w.explained()
                columns = [
                    b.column(1).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n, np.int64)),
                    pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(found, mask=np.isnan(found)),
                    pa.array(np.tile(explained, m), mask=np.tile(np.isnan(explained), m)),
                    pa.array([w.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = rows.select("vec_id").schema.add("component", T.IntegerType()).add("n", T.LongType()).add("deviation", T.LongType())
    for name in ("whitened", "explained", "identity_error"):
        schema = schema.add(name, T.DoubleType())
    return rows.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `embeddings` on their first 32 whitened components."""
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLE_SQL: dict[str, str] = {}
