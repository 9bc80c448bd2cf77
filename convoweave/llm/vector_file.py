"""Exact top-k search by inner product with a vector-approximation file.

Every vector is put on an integer grid and stored twice: whole, and as one byte for each dimension, which names its cell
there. Cells are parted by quantiles of a bounded sample and end at the exact minimum and maximum of all rows, so any vector lies
between the corners of its cells. The corners bound a query's score from both sides.

Queries come in blocks of BLOCK rows, in the order of a distributed rank; a block is broadcast. It reads the file twice:
1. The scan reads the cells alone. Each task keeps, for every query, the k highest lower bounds that it meets; the tasks'
   bounds merge in a treeReduce. The kth of them all is a floor that k candidates are certain to reach.
2. The search skips candidates whose upper bound is under the floor. The exact vectors of the others are read in the order of
   their upper bounds, until the kth best exact score so far is above the next bound; then the result is certain. Each task
   gives k rows a query at most, and a window ranks those of all tasks.

The file is written once and read from the shared folder, so a lost executor costs a task's scan. Tasks hold slices of
SLICE candidates against ASKED queries. Nothing is capped: the sample decides only where cells part, and so how much is skipped.

Defined results: vectors that are null, empty or hold null or non-finite components (or one whose integer passes 2^62) take no part; only
vectors of the query's length are its candidates; rows that have the query's own identifier are its own and no candidates,
repeated ones too, but each of them is a query and gives its rows; rows without an identifier are candidates, after
others of the same score; equal candidates are each listed; a score beyond a long is the nearest long; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from convoweave.llm.rows import ranked, slices
from convoweave.llm.whitening import by_length
from convoweave.session import new_path, table

SCALE, TOP, EVERY = 256, 5, 50
CELLS = 64  # in each dimension
SAMPLE = 4096  # vectors of each partition's first slices at most, of which quantiles part the cells
BLOCK = 1 << 15  # rows of a block of queries
SLICE, ASKED = 2048, 1024  # candidates and queries that are bounded at once
EXACT = 2.0**53  # doubles hold all integers below
WIDEST = 2.0**62
LONGS = -(2**63), 2**63 - 1
ROUNDING = 2.0**-50  # more than a long loses as a double
LARGEST = 2.0**63 * (1 - ROUNDING)
NOBODY = LONGS[0]  # stands for a missing identifier


def on_grid(vectors: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that take part, and their integers."""
    for at, entries in by_length(vectors):
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(entries * scale)
            sound = (np.abs(x) <= WIDEST).all(axis=1)
        if sound.any():
            yield at[sound], x[sound].astype(np.int64)


def gridded(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, known (false for rows without an identifier), dims and vec: the integers of the vectors that take part, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            for at, x in on_grid(b.column(1), scale):
                ids = b.column(0).take(pa.array(at))
                vec = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.fill_null(NOBODY), ids.is_valid(), pa.array(np.full(len(at), x.shape[1], np.int32)), vec], ["vec_id", "known", "dims", "vec"])

    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("e"))
    return rows.mapInArrow(run, "vec_id long, known boolean, dims int, vec binary")


def unpacked(b: pa.RecordBatch, name: str, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By dims: the rows of `b` and their column `name`, fixed-width numbers in bytes."""
    dims = b.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, np.frombuffer(b"".join(b.column(name).take(pa.array(at)).to_pylist()), kind).reshape(len(at), d)


def tree(rows: DataFrame, part, merge, empty):
    """What `part` makes of each partition's batches, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part(batches))], pa.binary())], ["part"])

    parts = rows.mapInArrow(run, "part binary").rdd
    n = parts.getNumPartitions()
    return parts.map(lambda r: pickle.loads(r.part)).treeReduce(merge, depth=max(2, math.ceil(math.log(n, 8)))) if n else empty


class Cells:
    """By dims: the borders of the cells in each dimension; cell c holds the integers from border c to before border c + 1."""

    def __init__(self, rows: DataFrame, cells: int, sample: int):
        def ranges(batches: Iterator[pa.RecordBatch]) -> dict:
            found: dict = {}
            for b in slices(batches, SLICE):
                for d, _, x in unpacked(b, "vec", np.int64):
                    found = widened(found, {d: (x.min(axis=0), x.max(axis=0), x[:sample])})
            return found

        def widened(a: dict, b: dict) -> dict:
            out = dict(a)
            for d, (low, high, some) in b.items():
                if d in out:
                    known = out[d]
                    both = np.concatenate([known[2], some])
                    # of two samples every other vector in a row of both, so neither side is left out
                    out[d] = np.minimum(known[0], low), np.maximum(known[1], high), both if len(both) <= sample else both[:: -(-len(both) // sample)]
                else:
                    out[d] = low, high, some
            return out

        self.borders = {}
        for d, (low, high, some) in tree(rows, ranges, widened, {}).items():
            inner = np.quantile(some, np.arange(1, cells) / cells, axis=0, method="higher")
            self.borders[d] = np.vstack([low, np.clip(inner, low, high), high + 1]).T  # of longs

    def codes(self, x: np.ndarray) -> np.ndarray:
        borders = self.borders[x.shape[1]]
        return np.stack([np.clip(np.searchsorted(b[1:-1], e, side="right"), 0, len(b) - 2) for b, e in zip(borders, x.T, strict=True)], axis=1).astype(np.uint8)

    def corners(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of the cells, in doubles."""
        borders = self.borders[codes.shape[1]].astype(np.float64)
        every = np.arange(codes.shape[1])
        low, high = borders[every, codes], borders[every, codes.astype(np.intp) + 1] - 1
        return (low + high) / 2, (high - low) / 2

    def slack(self, d: int, q: np.ndarray) -> np.ndarray | float:
        """What rounding may add to a query's bounds: nothing while doubles hold every sum exactly."""
        widest = float(np.abs(self.borders[d]).max())
        most = np.abs(q.astype(np.float64)).sum(axis=1) * widest
        return np.where(4 * most < EXACT, 0.0, most * (d + 4) * ROUNDING)


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, cells: int = CELLS, sample: int = SAMPLE) -> tuple[str, Cells]:
    """Writes the vector-approximation file; its path, and the cells."""
    spark = vectors.sparkSession
    rows = gridded(vectors, vec_id, embedding, scale)
    made = Cells(rows, cells, sample)
    shared = spark.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            code: list = [None] * b.num_rows
            for _, at, x in unpacked(b, "vec", np.int64):
                for k, row in zip(at.tolist(), shared.value.codes(x), strict=True):
                    code[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.binary())], [*b.schema.names, "code"])

    path = new_path(spark, "vector-file")
    rows.mapInArrow(run, "vec_id long, known boolean, dims int, vec binary, code binary").write.parquet(path)
    return path, made


class Block:
    """Queries of one length, ordered by identifier, with the best that is known of their candidates."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int):
        order = np.argsort(ids, kind="stable")
        self.number, self.ids, self.x, self.top = number[order], ids[order], x[order], top
        self.floor = np.full(len(ids), -np.inf)

    def own(self, ids: np.ndarray, known: np.ndarray, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of queries (from a to z) and candidates of one identifier."""
        first, last = (np.searchsorted(self.ids[a:z], ids, side=s) for s in ("left", "right"))
        n = np.where(known, last - first, 0)
        column = np.repeat(np.arange(len(ids)), n)
        return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), column


def bounds(block: Block, cells: Cells, ids: np.ndarray, known: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each ASKED queries of the block: their places, and lower and upper bounds for every candidate, -inf for their own."""
    middle, half = cells.corners(codes)
    for a in range(0, len(block.ids), ASKED):
        z = min(a + ASKED, len(block.ids))
        q = block.x[a:z].astype(np.float64)
        centre, reach = q @ middle.T, np.abs(q) @ half.T + np.reshape(cells.slack(codes.shape[1], block.x[a:z]), (-1, 1))
        lower, upper = centre - reach, np.maximum(centre + reach, LONGS[0])
        row, column = block.own(ids, known, a, z)
        lower[row, column] = upper[row, column] = -np.inf
        yield a, z, lower, upper


def scan(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block], cells: Cells) -> dict[int, np.ndarray]:
    """By dims: the highest lower bounds of a partition's candidates, `top` for each query."""
    best = {d: np.full((len(b.ids), b.top), -np.inf) for d, b in blocks.items()}
    for b in slices(batches, SLICE):
        ids, known = b.column("vec_id").to_numpy(), b.column("known").to_numpy(zero_copy_only=False)
        for d, at, codes in unpacked(b, "code", np.uint8):
            if d in blocks:
                for a, z, lower, _ in bounds(blocks[d], cells, ids[at], known[at], codes):
                    mine = best[d][a:z]
                    higher = np.flatnonzero(lower.max(axis=1) > mine[:, 0])
                    mine[higher] = highest(np.hstack([mine[higher], lower[higher]]), mine.shape[1])
    return best


def highest(x: np.ndarray, top: int) -> np.ndarray:
    """The `top` highest of each row, the lowest of them first."""
    return np.partition(x, x.shape[1] - top, axis=1)[:, x.shape[1] - top :]


def higher_of(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {d: highest(np.hstack([a[d], b[d]]), a[d].shape[1]) for d in a}


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of q and x, as longs."""
    most = np.abs(q.astype(np.float64)).max(initial=0) * np.abs(x.astype(np.float64)).max(initial=0) * q.shape[1]
    if most < WIDEST:
        return (q * x).sum(axis=1)
    return np.array([min(max(sum(map(int.__mul__, a, b)), LONGS[0]), LONGS[1]) for a, b in zip(q.tolist(), x.tolist(), strict=True)], np.int64)


class Found:
    """The best exact scores so far of the queries of a block from a to z: of each query `top` at most, in order."""

    def __init__(self, block: Block, a: int, z: int):
        self.x, self.top = block.x[a:z], block.top
        self.row = np.zeros(0, np.int64)
        self.score, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.kth = block.floor[a:z].copy()  # no candidate of a lower score counts

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        row, score, ids, known = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, np.invert(score), row))  # invert: falling scores, without overflow
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = order[place == self.top - 1]
        order = order[place < self.top]
        self.row, self.score, self.ids, self.known = row[place < self.top], score[order], ids[order], known[order]
        kth = score[last].astype(np.float64)
        at = row[place == self.top - 1]
        self.kth[at] = np.maximum(self.kth[at], kth - np.abs(kth) * ROUNDING)

    def read(self, upper: np.ndarray, x: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Reads exact vectors of a slice in the order of their upper bounds, until each query's kth score is above all that is left."""
        row, column = np.nonzero((upper >= self.kth[:, None]) & (upper > -np.inf))
        bound = upper[row, column]
        order = np.lexsort((-bound, row))
        row, column, bound = row[order], column[order], bound[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        start, step = 0, self.top
        while True:
            now = (place >= start) & (place < start + step) & (bound >= self.kth[row])
            if not now.any():  # bounds only fall from here on
                return
            r, c = row[now], column[now]
            self.add(r, products(self.x[r], x[c]), ids[c], known[c])
            start, step = start + step, step * 2


def search(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block], cells: Cells) -> Iterator[pa.RecordBatch]:
    """number, query_id, vec_id, known and score: of a partition's candidates the best of each query, none under the floor."""
    found = {(d, a): Found(b, a, a + ASKED) for d, b in blocks.items() for a in range(0, len(b.ids), ASKED)}
    for b in slices(batches, SLICE):
        ids, known = b.column("vec_id").to_numpy(), b.column("known").to_numpy(zero_copy_only=False)
        for d, at, codes in unpacked(b, "code", np.uint8):
            if d in blocks:
                x = np.frombuffer(b"".join(b.column("vec").take(pa.array(at)).to_pylist()), np.int64).reshape(len(at), d)
                for a, _, _, upper in bounds(blocks[d], cells, ids[at], known[at], codes):
                    found[d, a].read(upper, x, ids[at], known[at])
    for (d, a), f in found.items():
        block, row = blocks[d], f.row + a
        good = f.score >= block.floor[row]
        columns = [pa.array(x[good]) for x in (block.number[row], block.ids[row], f.ids, f.known, f.score)]
        yield pa.RecordBatch.from_arrays(columns, ["number", "query_id", "vec_id", "known", "score"])


def top_scores(
    vectors: DataFrame, asked: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP, scale: int = SCALE, cells: int = CELLS, queries: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id and score: for every row that `asked` marks the `top` best other rows by inner product."""
    spark = vectors.sparkSession
    path, made = index(vectors, vec_id, embedding, scale, cells, sample)
    file, shared = spark.read.parquet(path), spark.sparkContext.broadcast(made)
    numbered = ranked(gridded(vectors.where(asked), vec_id, embedding, scale).where("known").select("vec_id", "dims", "vec"), [F.col("vec_id")], "number")
    out, n = new_path(spark, "found"), numbered.count()
    for k in range(-(-n // queries)):
        rows = numbered.where((F.col("number") >= k * queries) & (F.col("number") < (k + 1) * queries)).toArrow().combine_chunks()
        rows = rows.to_batches()[0] if rows.num_rows else rows
        blocks = {d: Block(rows.column("number").to_numpy()[at], rows.column("vec_id").to_numpy()[at], x, top) for d, at, x in unpacked(rows, "vec", np.int64)}
        sent = spark.sparkContext.broadcast(blocks)
        floors = tree(file.select("vec_id", "known", "dims", "code"), lambda batches, sent=sent: scan(batches, sent.value, shared.value), higher_of, {})
        for d, best in floors.items():
            blocks[d].floor = np.clip(best[:, 0] - np.abs(best[:, 0]) * ROUNDING, -np.inf, LARGEST)
        floored = spark.sparkContext.broadcast(blocks)
        schema = "number long, query_id long, vec_id long, known boolean, score long"
        hits = file.mapInArrow(lambda batches, floored=floored: search(batches, floored.value, shared.value), schema)
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.desc("known"), "vec_id")
        hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).write.mode("append").parquet(out)
        sent.destroy()
        floored.destroy()
    schema = "number long, query_id long, vec_id long, known boolean, score long, rank int"
    found = spark.read.schema(schema).parquet(out) if n else spark.createDataFrame([], schema)
    return found.select("query_id", "rank", F.when(F.col("known"), F.col("vec_id")).alias("vec_id"), "score")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth of `embeddings` asks all others."""
    return top_scores(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op13_exact_search": op13_exact_search}
ORACLE_SQL = {
    "op13_exact_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
