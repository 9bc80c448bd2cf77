"""Density clusters of vectors: a neighbour graph, its minimum spanning forest by mutual reachability, and the leaves of the
condensed tree, made without the tree.

Vectors are scaled to length one, so that Euclidean distance orders like cosine. Equal vectors are one node with a size. A
merge is a true split of the condensed tree if both parts are heavy (the least cluster size at least). As many true splits as leaves less one
exist; taken out of the forest, they leave pieces with one leaf each, which is the part that the piece's first split joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from convoweave.functions.ordering import running_sum
from convoweave.functions.vectors import norm, normalised
from convoweave.operators.graphs import WITHIN, components, cut, merges_of_heavy, spanning_forest, spread_join

SAMPLES, LEAST, SHARE = 3, 15, 150  # rows within a core distance, least cluster, clusters at most
NEIGHBOURS, TABLES, BLOCK, BITS, SEED, ROUNDS, HUB = 15, 8, 2048, 24, 42, 2, 1000
LISTS = "a long, near array<struct<d: double, b: long, n: long>>"


def nodes(vectors: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """`vectors` with digest, and node, digest, v (unit length) and n (rows) for each different vector.

    The digest is null for vectors that are null, zero, of another length than most, or hold null or non-finite components; these are no nodes.
    Nodes are numbered by digest, so that ties fall alike in each run.
    """
    x = F.col(embedding)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf)) & (norm(x) > 0)
    rows = vectors.withColumn("digest", F.when(sound, F.sha2(x.cast("string"), 256)))
    each = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.any_value(normalised(x)).alias("v"), F.count("*").alias("n"))
    each = cut(each.withColumn("_d", F.size("v")))
    usual = each.groupBy("_d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("_d")).first()
    if usual is None:
        return rows, each.select(F.lit(0).cast("long").alias("node"), "digest", "v", "n")
    each = each.where(F.col("_d") == usual["_d"]).withColumn("_one", F.lit(1))
    numbers = running_sum(each.select("digest", "_one"), [F.col("digest")], "_one", "node")
    return rows, cut(each.join(numbers.select("digest", "node"), "digest").select("node", "digest", "v", "n"))


def neighbours(points: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """a, near: up to k structs d, b, n of the nearest other nodes that the tables found, in order, for each of `points` (node, v, n).

    Each table sorts all nodes along the signs of random projections, cuts the order into blocks and compares all pairs inside a block.
    Blocks have a size, not a key, so none is hot; `rounds` of descent follow. Up to `block` nodes lie in one block, and the graph is exact.
    Vectors move as the bytes of their doubles, and neighbours as lists, so that rows are as many as nodes, not as pairs.
    """
    total = points.count()
    if total < 2:
        return points.select(F.col("node").alias("a"), F.expr("array(named_struct('d', 0D, 'b', node, 'n', n))").alias("near")).limit(0)
    means = points.select(Summarizer.mean(array_to_vector("v")).alias("m")).first()["m"].toArray()  # as many numbers as a vector has
    planes = np.random.default_rng(SEED).standard_normal((tables, BITS + 1, len(means)))
    tables = tables if total > block else 1

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"].flatten().to_numpy().reshape(-1, len(means))
            flat = (v - means) @ planes[:tables].reshape(-1, len(means)).T
            flat = flat.reshape(len(v), tables, BITS + 1)
            signs = (flat[:, :, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])
            # the place in a Gray code: places that follow each other differ by one sign
            gray = signs
            for step in (1, 2, 4, 8, 16):
                gray = gray ^ (gray >> step)
            bits = pa.array([x.tobytes() for x in v], pa.binary())
            places = {f"s{t}": gray[:, t].astype(np.int64) for t in range(tables)} | {f"o{t}": np.ascontiguousarray(flat[:, t, BITS]) for t in range(tables)}
            yield pa.RecordBatch.from_pydict({"node": batch["node"], "v": bits, "n": batch["n"], **places})

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append((batch["node"].to_numpy(), vectors_of(batch), batch["n"].to_numpy()))
            while sum(len(x[0]) for x in held) >= 2 * block:
                whole = [np.concatenate(x) for x in zip(*held)]
                held = [tuple(x[block:] for x in whole)]
                yield nearest(*(x[:block] for x in whole), k)
        if sum(len(x[0]) for x in held) > 1:
            whole = [np.concatenate(x) for x in zip(*held)]
            size = len(whole[0])
            half = size if size <= block else (size + 1) // 2
            for at in range(0, size, half):
                yield nearest(*(x[at : at + half] for x in whole), k)

    places = "".join(f", s{t} long" for t in range(tables)) + "".join(f", o{t} double" for t in range(tables))
    rows = cut(points.select("node", "v", "n").mapInArrow(keyed, f"node long, v binary, n long{places}"))
    parts = max(1, math.ceil(total / (16 * block)))
    found = None
    for t in range(tables):
        order = [f"s{t}", f"o{t}", "node"]
        ordered = rows.select("node", "v", "n", *order[:2]).repartitionByRange(parts, *order)
        lists = ordered.sortWithinPartitions(*order).select("node", "v", "n").mapInArrow(compared, LISTS)
        found = lists if found is None else found.union(lists)
    near = best(found, k)
    for _ in range(rounds if tables > 1 else 0):
        near = descended(rows.select("node", "v", "n"), near, k)
    return near


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    """The column v, bytes of doubles, as a matrix."""
    return np.frombuffer(b"".join(batch["v"].to_pylist())).reshape(batch.num_rows, -1)


def listed(a: np.ndarray, sizes: np.ndarray, d: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """a, near: for each of `a` its next `sizes` of d, b, n."""
    near = pa.StructArray.from_arrays([pa.array(x) for x in (d, b, n)], names=["d", "b", "n"])
    return pa.RecordBatch.from_pydict({"a": a, "near": pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), near)})


def topmost(a: np.ndarray, d: np.ndarray, b: np.ndarray, n: np.ndarray, k: int) -> list[np.ndarray]:
    """The k least d, b, n of each a in order, each b once."""
    order = np.lexsort((b, d, a))
    a, d, b, n = a[order], d[order], b[order], n[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]  # a pair has one distance, so it follows itself
    a, d, b, n = a[first], d[first], b[first], n[first]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return [x[place < k] for x in (a, d, b, n)]


def best(lists: DataFrame, k: int) -> DataFrame:
    """a and near: the k nearest in all of `lists` (a, near) in order, each b once.

    A node's lists come one after another to a task, which keeps k of them at a time.
    """

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            near = batch["near"]
            d, b, n = (x.to_numpy() for x in near.flatten().flatten())
            rows = [np.repeat(batch["a"].to_numpy(), near.value_lengths().to_numpy()), d, b, n]
            rows = topmost(*(rows if held is None else [np.concatenate(x) for x in zip(held, rows)]), k)
            last = rows[0] == rows[0][-1:]  # its lists may go on
            held = [x[last] for x in rows]
            if not last.all():
                yield whole([x[~last] for x in rows])
        if held is not None and len(held[0]):
            yield whole(held)

    return cut(lists.repartition("a").sortWithinPartitions("a").mapInArrow(merged, LISTS))


def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
    """a, near of `rows` (a, d, b, n), which are in order."""
    a, sizes = np.unique(rows[0], return_counts=True)
    return listed(a, sizes, *rows[1:])


def descended(points: DataFrame, near: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """`near` bettered once: the neighbours of each node are compared with each other, and nearer ones are kept.

    points: node, v (bytes), n. Each node gathers the vectors of its k neighbours at most. Nodes that over HUB others have as a neighbour
    are copied once for each HUB of those.
    """
    edges = near.select(F.col("a").alias("owner"), F.explode(F.concat(F.array("a"), "near.b")).alias("c"))
    hubs = cut(edges.groupBy("c").count().where(F.col("count") > HUB).select("c", F.ceil(F.col("count") / HUB).cast("int").alias("copies")))
    edges = spread_join(edges, hubs, ["c"], "left").withColumn("cell", F.pmod(F.xxhash64("owner"), F.coalesce("copies", F.lit(1))).cast("int"))
    far = F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(math.inf)
    held = points.join(near.select(F.col("a").alias("node"), far.alias("far")), "node").withColumnRenamed("node", "c").join(hubs, "c", "left")
    held = held.withColumn("cell", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    groups = edges.select("owner", "c", "cell").join(held.drop("copies"), ["c", "cell"]).select("owner", "c", "v", "n", "far")

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            owner, c, n, far = (batch[x].to_numpy() for x in ("owner", "c", "n", "far"))
            rows = [owner, c, vectors_of(batch), n, far]
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
            last = rows[0] == rows[0][-1]  # its group may go on
            rest = [x[last] for x in rows]
            if not last.all():
                yield nearer(*(x[~last] for x in rows), k)
        if rest is not None:
            yield nearer(*rest, k)

    lists = groups.repartition("owner").sortWithinPartitions("owner").mapInArrow(met, LISTS)
    return best(lists.union(near.select("a", "near")), k)


def nearer(owner: np.ndarray, c: np.ndarray, v: np.ndarray, n: np.ndarray, far: np.ndarray, k: int) -> pa.RecordBatch:
    """a, near: pairs inside each owner's rows that are nearer than a's `far`; the best k of each a."""
    _, starts, sizes = np.unique(owner, return_index=True, return_counts=True)
    parts = []
    for size in np.unique(sizes):
        groups = starts[sizes == size]
        for at in range(0, len(groups), 256):
            rows = groups[at : at + 256, None] + np.arange(size)
            x, most = v[rows], far[rows]
            product = x @ x.transpose(0, 2, 1)
            square = np.diagonal(product, axis1=1, axis2=2)
            square = square[:, :, None] + square[:, None, :]
            # products round, so that they only leave out what is surely no nearer
            maybe = square - 2 * product < (most * most)[:, :, None] + 1e-9 * square
            maybe[:, np.arange(size), np.arange(size)] = False
            g, i, j = np.nonzero(maybe)
            d = np.sqrt(((x[g, i] - x[g, j]) ** 2).sum(axis=1))
            kept = d < most[g, i]
            parts.append((rows[g, i][kept], rows[g, j][kept], d[kept]))
    i, j, d = (np.concatenate(x) for x in zip(*parts))
    return whole(topmost(c[i], d, c[j], n[j], k))


def nearest(node: np.ndarray, v: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
    """a, near: the k nearest other rows of each row; distances are alike in each block and from both ends."""
    more = min(len(node), k + 9)  # some more than k and the row itself, since products round
    parts = []
    for at in range(0, len(node), 256):
        product = v[at : at + 256] @ v.T
        if more < len(node):
            near = np.argpartition(-product, more - 1, axis=1)[:, :more]
        else:
            near = np.broadcast_to(np.arange(len(node)), product.shape)
        d = np.stack([np.sqrt(((v[c] - x) ** 2).sum(axis=1)) for x, c in zip(v[at : at + 256], near)])
        d[near == np.arange(at, at + len(d))[:, None]] = np.inf
        order = np.lexsort((node[near], d), axis=1)[:, : min(k, len(node) - 1)]
        near = np.take_along_axis(near, order, axis=1)
        parts.append((np.take_along_axis(d, order, axis=1), node[near], n[near]))
    d, b, n = (np.concatenate(x) for x in zip(*parts))
    return listed(node, np.full(len(node), d.shape[1]), d.ravel(), b.ravel(), n.ravel())


def reachability(points: DataFrame, near: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """a, b, w: the edges of the neighbour graph, w the greatest of both core distances and the distance.

    A core distance reaches `samples` rows, the node's own among them; it is infinite where the graph has too few.
    """
    rows = points.select(F.col("node").alias("a"), F.col("n").alias("own")).join(near, "a")
    start = F.struct(F.col("own").alias("rows"), F.when(F.col("own") >= samples, 0.0).otherwise(math.inf).alias("d"))
    reach = F.aggregate(
        "near", start, lambda s, x: F.struct((s["rows"] + x["n"]).alias("rows"), F.when((s["d"] == math.inf) & (s["rows"] + x["n"] >= samples), x["d"]).otherwise(s["d"]).alias("d"))
    )["d"]
    rows = cut(rows.withColumn("core", reach))
    cores = rows.select(F.col("a").alias("b"), F.col("core").alias("other"))
    edges = rows.select("a", "core", F.explode("near").alias("e")).select("a", "core", "e.b", "e.d")
    return spread_join(edges, cores, ["b"]).select("a", "b", F.greatest("core", "other", "d").alias("w"))


def leaves(points: DataFrame, edges: DataFrame, least: int, within: int = WITHIN) -> DataFrame:
    """node and cluster (0, 1, ... by smallest node) of the nodes in leaves of the condensed tree; no rows where it has no split.

    points: node, n. edges: a, b, w. Parts that no edge joins meet at an infinite distance.
    """
    sizes = cut(points.select("node", "n"))
    forest = spanning_forest(edges, within)
    tree = sizes.join(components(forest, within=within), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heavy = cut(tree.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") >= least))  # the sort below reads it twice
    # heavy trees are the rows' number / least at most, so that one task may order them
    links = heavy.select(F.lag("root").over(Window.orderBy("root")).alias("a"), F.col("root").alias("b"), F.lit(math.inf).alias("w")).where("a IS NOT NULL")
    forest = forest.union(links).withColumn("_one", F.lit(1))
    forest = cut(running_sum(forest, [F.col("w"), F.col("a"), F.col("b")], "_one", "rank").select("rank", "a", "b"))
    splits = cut(merges_of_heavy(forest, sizes, least, within).distinct())
    rest = cut(forest.join(splits, "rank", "left_anti"))
    borders = forest.join(splits, "rank", "left_semi")
    ends = borders.select("rank", F.col("a").alias("node")).union(borders.select("rank", F.col("b").alias("node")))
    piece = cut(components(rest, within=within))
    ends = ends.join(piece, "node", "left").select(F.coalesce("root", "node").alias("piece"), F.struct("rank", "node").alias("m"))
    first = cut(ends.groupBy("piece").agg(F.min("m").alias("m")).select("piece", "m.rank", "m.node"))
    inside = spread_join(rest.withColumnRenamed("rank", "_rank"), piece.select(F.col("node").alias("a"), F.col("root").alias("piece")), ["a"])
    inside = spread_join(inside, first.select("piece", "rank"), ["piece"]).where("_rank < rank")
    part = cut(components(inside.select("a", "b"), within=within))
    roots = first.select("node").join(part, "node", "left").select(F.coalesce("root", "node").alias("root"))
    numbered = cut(roots.withColumn("cluster", F.row_number().over(Window.orderBy("root")) - 1))  # rows / least at most
    alone = numbered.join(part, "root", "left_anti").select(F.col("root").alias("node"), "cluster")
    return cut(spread_join(part, numbered, ["root"]).select("node", "cluster").union(alone))


def absorbed(points: DataFrame, labels: DataFrame) -> DataFrame:
    """node, cluster and dense for all `points` (node, v, n): nodes outside of all clusters go to the nearest mean (ties: the first)."""
    rows = cut(points.join(labels, "node", "left"))
    means = rows.where("cluster IS NOT NULL").groupBy("cluster").agg(Summarizer.mean(array_to_vector("v"), F.col("n").cast("double")).alias("m"))
    centre = {r["cluster"]: r["m"] for r in means.withColumn("m", vector_to_array("m")).collect()}  # SHARE vectors at most
    ids = np.array(sorted(centre))
    middle = np.array([centre[c] for c in ids])

    def placed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            off = [((middle - v) ** 2).sum(axis=1).argmin() for v in frame["v"]]
            dense = frame["cluster"].notna()
            yield pd.DataFrame({"node": frame["node"], "cluster": frame["cluster"].where(dense, ids[off]).astype("int32"), "dense": dense})

    return rows.select("node", "v", "cluster").mapInPandas(placed, "node long, cluster int, dense boolean")


def clustered(vectors: DataFrame, embedding: str = "embedding", within: int = WITHIN, block: int = BLOCK) -> DataFrame | None:
    """`vectors` with cluster and dense (in a leaf, not only near it); None where there are under six vectors or two clusters.

    The least cluster is LEAST rows, or one SHARE-th of all, so that there are SHARE clusters at most. Vectors that are null, zero, of another
    length than most, or hold null or non-finite components have neither. Columns of `vectors` stay; digest, cluster and dense are made anew.
    """
    rows, points = nodes(vectors.drop("digest", "cluster", "dense"), embedding)
    total = points.agg(F.sum("n")).first()[0] or 0
    if total < 6:
        return None
    edges = reachability(points, neighbours(points, block=block))
    labels = leaves(points, edges, max(LEAST, total // SHARE), within)
    if labels.isEmpty():
        return None
    each = absorbed(points, labels).join(points.select("node", "digest"), "node").select("digest", "cluster", "dense")
    return spread_join(rows, cut(each), ["digest"], "left").drop("digest")
