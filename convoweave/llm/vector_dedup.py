"""Near-deduplication of embeddings by p-stable hashing, followed by exact cosine checks.

Equal vectors are one class, whose size counts in the links. A class is hashed into TABLES tables: each takes HASHES
random projections of the normalised vector, quantised with WIDTH, so vectors at a small Euclidean distance often
share all of them. Buckets of one class, and of the classes of which another bucket consists, are dropped before any
vector moves; the classes of the other buckets meet with their vectors, and every pair's cosine is computed in double precision. A pair that shares several buckets counts in the
first table that both share, so links need no removal of doubles and no list of pairs: tasks give sums of links and a
star for each tree of a spanning forest. With a vector go its buckets that others share, not all of its hashes, and
its components in single precision where that holds them exactly.

Buckets of over TILE classes are dealt over parts by hash, and each pair of parts meets in a cell of its own; nothing is
capped. At cosine 0.95 a pair shares a bucket with probability 0.995 (22 hashes, width 6 times the distance at the
threshold, 120 tables), above it with more; every link that is found is exact.

Identifiers are whole numbers. Defined results: vectors that are null, empty, zero or hold a null or non-finite number link with nothing and are
kept; vectors of other lengths never meet; rows without vec_id have no component; repeated rows link to each other;
a vec_id with several vectors links wherever one of them does; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from convoweave.llm.rows import components, slices
from convoweave.session import cut, table

THRESHOLD = 0.95
TABLES, HASHES, WIDTH = 120, 22, 6.0
SINGLE, DOUBLE = b"s", b"d"
TILE = 512
SEED = 20240229


def sound(vector: list | None) -> np.ndarray | None:
    """The vector as float64, or None if it links with nothing."""
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by the largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def digests(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, digest (null for vectors that link with nothing) and vec, the components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            found = [sound(v) for v in b.column(1).to_pylist()]
            raw = [None if x is None else packed(x + 0.0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r and hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "vec"]
            )

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), embedding).mapInArrow(run, "vec_id long, digest binary, vec binary")


def signed(classes: DataFrame, threshold: float, tables: int, hashes: int, width: float) -> DataFrame:
    """id of `classes` (id, vec), and keys: their bucket in each table."""
    quantum = width * np.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in slices(batches, 512):
            keys: list = [None] * b.num_rows
            vectors = [numbers(v) for v in b.column("vec").to_pylist()]
            for d in {len(v) for v in vectors}:
                if d not in known:
                    rng = np.random.default_rng([SEED, d])
                    known[d] = (rng.standard_normal((d, tables * hashes)), rng.random(tables * hashes) * quantum, rng.integers(1, 2**63, (tables, hashes), dtype=np.uint64) | np.uint64(1))
                planes, shifts, mix = known[d]
                rows = [k for k, v in enumerate(vectors) if len(v) == d]
                cells = np.floor((unit(np.array([vectors[k] for k in rows])) @ planes + shifts) / quantum).astype(np.int64).view(np.uint64)
                sums = (cells.reshape(-1, tables, hashes) * mix).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64)
                sums ^= sums >> np.uint64(29)
                for k, row in zip(rows, (sums * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    return classes.select("id", "vec").mapInArrow(run, "id long, keys array<long>")


def meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b, links of a partition sorted by cell: stars (links null), and sums of the links that count in this table (b null)."""
    held = None
    for b in batches:
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        cell = [b.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "a", "b")]
        starts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in cell], axis=0)]) if b.num_rows else np.array([0])
        held = b.slice(int(starts[-1]))
        if len(starts) > 1:
            yield from compared(b, starts, threshold)
    if held is not None and held.num_rows:
        yield from compared(held, np.array([0, held.num_rows]), threshold)


def compared(b: pa.RecordBatch, starts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The cells of `b` between `starts`; vectors of other lengths whose hashes happen to be equal are told apart."""
    part, first, last, at, ids, n = (b.column(k).to_numpy(zero_copy_only=False) for k in ("part", "a", "b", "at", "id", "n"))
    vec, keys, tables = b.column("vec"), b.column("buckets"), b.column("tables")
    out_a, out_b, out_n = [], [], []
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        raw = vec.slice(s, e - s).to_pylist()
        k, live = dense(keys.slice(s, e - s), tables.slice(s, e - s))
        raw = same_precision(raw)
        for size in sorted({len(r) for r in raw}):
            here = np.array([j for j, r in enumerate(raw) if len(r) == size])
            if len(here) < 2:
                continue
            kind = np.float32 if raw[here[0]][:1] == SINGLE else np.float64
            x = unit(np.frombuffer(b"".join(raw[j][1:] for j in here), kind).reshape(len(here), -1).astype(np.float64))
            found = cell_links(x, k[here], live[here], part[s + here], first[s], last[s], at[s], ids[s + here], n[s + here], threshold)
            for out, new in zip((out_a, out_b, out_n), found, strict=True):
                out += new
    if out_a:
        a, z, count = (np.concatenate(x) for x in (out_a, out_b, out_n))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z, mask=count >= 0), pa.array(count, mask=count < 0)], ["a", "b", "links"])


def dense(buckets: pa.ListArray, tables: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """By row and table the bucket, and whether it is a shared one."""
    at, bucket = tables.flatten().to_numpy(), buckets.flatten().to_numpy()
    row = np.repeat(np.arange(len(tables)), tables.value_lengths().to_numpy())
    k = np.zeros((len(tables), int(at.max()) + 1), np.int64)
    live = np.zeros(k.shape, bool)
    k[row, at], live[row, at] = bucket, True
    return k, live


def packed(x: np.ndarray) -> bytes:
    """The components in single precision if it holds them exactly, else in double; the first byte says which."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return SINGLE + single.tobytes() if (single == x).all() else DOUBLE + x.tobytes()


def same_precision(raw: list[bytes]) -> list[bytes]:
    """`raw` in double precision, if any vector is."""
    if all(r[:1] == SINGLE for r in raw):
        return raw
    return [DOUBLE + np.frombuffer(r[1:], np.float32).astype(np.float64).tobytes() if r[:1] == SINGLE else r for r in raw]


def numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], np.float32 if raw[:1] == SINGLE else np.float64).astype(np.float64)


def cell_links(
    x: np.ndarray, k: np.ndarray, live: np.ndarray, part: np.ndarray, first: int, last: int, at: int, ids: np.ndarray, n: np.ndarray, threshold: float
) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of vectors of one length in a cell: ids with sums of links (other -1), and stars (sum -1)."""
    rows = np.flatnonzero(part == first)
    columns = np.flatnonzero(part == last) if first != last else rows
    near = (x[rows] @ x[columns].T) >= threshold
    near &= ids[rows][:, None] != ids[columns][None]
    i, j = np.nonzero(near)
    if not len(i):
        return [], [], []
    counts = np.zeros((2, len(x)), np.int64)
    for c in range(0, len(i), 1 << 14):
        p, q = rows[i[c : c + (1 << 14)]], columns[j[c : c + (1 << 14)]]
        here = ((k[p] == k[q]) & live[p] & live[q]).argmax(axis=1) == at
        np.add.at(counts[0], p[here], n[q[here]])
        np.add.at(counts[1], q[here], n[p[here]])
    total = counts[0] if first == last else counts[0] + counts[1]
    some = np.flatnonzero(total)
    label = np.arange(len(x))
    while True:  # the smallest row that links reach
        new = label.copy()
        np.minimum.at(new, rows[i], label[columns[j]])
        np.minimum.at(new, columns[j], label[rows[i]])
        new = new[new]
        if (new == label).all():
            break
        label = new
    joined = np.flatnonzero(label != np.arange(len(x)))
    return [ids[some], ids[joined]], [np.full(len(some), -1), ids[label[joined]]], [total[some], np.full(len(joined), -1)]


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors`."""
    rows = digests(vectors, vec_id, embedding)
    sound_rows = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = cut(sound_rows.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    marked = cut(signed(classes, threshold, tables, hashes, width))
    entries = marked.select("id", F.posexplode("keys").alias("at", "bucket"))
    members = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"_{k}") for k in range(2)]
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.min("at").alias("at"), *members).where("m > 1")
    first = F.min(F.struct("at", "bucket"))  # a pair counts in the first table that it shares, so of buckets with the same members the first does
    shared = cut(shared.groupBy("m", "_0", "_1").agg(first.alias("x")).select("x.bucket", "m"))
    live = cut(entries.join(shared, "bucket"))
    told = live.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "bucket"))).alias("x")).select(F.col("id").alias("_id"), F.col("x.at").alias("tables"), F.col("x.bucket").alias("buckets"))
    vectors_of = classes.select("id", "n", "vec").join(told, F.col("id") == F.col("_id")).drop("_id")  # a row a class, with its shared buckets
    live = live.withColumn("parts", F.ceil(F.col("m") / tile))
    live = live.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = live.select("bucket", "at", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "id").join(vectors_of, "id")
    met = cells.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(lambda batches: meet(batches, threshold), "a long, b long, links long")
    met = cut(met)
    links = met.where("links IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(met.where("b IS NOT NULL").select("a", "b"))
    told = classes.select("digest", "id", "n").join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    told = cut(told.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component")))
    found = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(told, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components over all `embeddings`."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE_SQL: dict[str, str] = {}
