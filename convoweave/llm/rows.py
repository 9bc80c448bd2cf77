"""Small steps that several operators share: distributed ranks, joins with a checked broadcast, component labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convoweave.session import cut

BROADCAST_BYTES = 32 << 20
SLICE = 256
SALTS = 32


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so that Python never holds a whole batch of long texts."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def small_or_shuffled(df: DataFrame, rows: int, bytes_per_row: int = 64) -> DataFrame:
    """`df` marked for broadcast if its counted rows fit BROADCAST_BYTES; else left to a shuffled join."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def salted_join(rows: DataFrame, side: DataFrame, on: Column, spread: Column, n: int, bytes_per_row: int = 64, salts: int = SALTS) -> DataFrame:
    """`rows` left-joined with `side`, of `n` rows: broadcast if small; else each of its rows is copied to `salts` cells, and a
    row of `rows` goes to the cell that `spread` (a long) names, so that a key's rows fill no single task."""
    if n * bytes_per_row <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), on, "left")
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_cell", F.pmod(spread, F.lit(salts)).cast("int"))
    return salted.join(copies, on & (F.col("_cell") == F.col("_salt")), "left").drop("_salt", "_cell")


def free(columns: Sequence[str], name: str) -> str:
    """`name`, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def kept_rows(docs: DataFrame, digest: Column, told: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs`, with their own columns, that `told` (doc_id, digest, kept) keeps; of repeated rows one.

    A row is told by its identifier and the digest of its text. Only rows that go, or stand there again, are joined;
    their table is broadcast if it is small, else joined by a shuffle that moves each text once.
    """
    row_digest, mark_id, mark_digest, mark_kept = (free(docs.columns, x) for x in ("_row_digest", "_mark_id", "_mark_digest", "_mark_kept"))
    marks = told.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    marks = cut(marks.select(F.col("doc_id").alias(mark_id), F.col("digest").alias(mark_digest), F.col("kept").alias(mark_kept)))
    n, again = marks.agg(F.count("*"), F.count(F.when(F.col(mark_kept), 1))).first()
    rows = docs.withColumn(row_digest, digest)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(mark_id)) & (F.col(row_digest) == F.col(mark_digest))
    left = rows.join(small_or_shuffled(marks.drop(mark_kept), n, 128), same, "left_anti")
    if again:
        repeated = rows.join(small_or_shuffled(marks.where(mark_kept).drop(mark_kept), again, 128), same, "left_semi")
        left = left.union(repeated.dropDuplicates([doc_id, row_digest]))
    return left.drop(row_digest)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """`df` with each row's place, from 0, in a total order, by one distributed sort.

    A row's place is its position in its sorted partition plus the rows of the partitions before; only those
    counts, one for each partition, come to the driver.
    """
    at = cut(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(at.groupBy(part.alias("p")).count().collect())
    before, so_far = [], 0
    for p, n in counts:
        before.append((p, so_far))
        so_far += n
    starts = df.sparkSession.createDataFrame(before, "_part long, _before long")
    joined = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b: long), root being the smallest node that it reaches.

    Alternating large and small stars: each round every node hands its larger neighbours, then its smaller ones, to
    the smallest node it knows. Rounds grow with the logarithm of the longest chain; nothing is gathered anywhere.
    The minima are cut off from the joins, so that adaptive execution can split a hub's rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


class Forest:
    """A spanning forest of the links a task sees; `links` gives a star for each tree, which keeps all components."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, root)
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def links(self) -> tuple[list[int], list[int]]:
        nodes = [x for x, above in self.up.items() if x != above]
        return nodes, [self.find(x) for x in nodes]
