"""Graphs too large for one task: components and minimum spanning forests of edge tables.

Both contract the graph in rounds, each cut by a table in the shared folder; once what is left has `within` edges at most, one task ends it,
with the same result. Nodes that very many edges touch are no hot keys: what is counted is counted before it moves, and
joins copy their unique side to CELLS cells, unless the other side holds a key once too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from convoweave.session import new_path

CELLS, WITHIN = 16, 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """`df` as a written table in the shared folder.

    A checkpoint keeps what its plan knows of constraints and partitions, which multiply with each round; a table does not.
    """
    path = new_path(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which holds a key once; the rows of one key of `left` are dealt to CELLS cells."""
    hashed = [F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    cell = F.pmod(F.xxhash64(*hashed), F.lit(CELLS)).cast("int")
    copies = right.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    return left.withColumn("_cell", cell).join(copies, [*on, "_cell"], how).drop("_cell")


class Sets:
    """Disjoint sets of hashable things, for graphs that fit a task."""

    def __init__(self):
        self.above = {}

    def top(self, x):
        path = []
        while (up := self.above.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.above[p] = x
        return x

    def join(self, x, y) -> bool:
        """Puts the sets of x and y under their smaller top; whether they were two."""
        x, y = sorted((self.top(x), self.top(y)))
        self.above.setdefault(x, x)
        self.above[y] = x
        return x != y


def _both(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each edge from both its ends, as x and y."""
    ways = [edges.select(*keys, F.col(p).alias("x"), F.col(q).alias("y")) for p, q in (("a", "b"), ("b", "a"))]
    return ways[0].union(ways[1])


def components(edges: DataFrame, by: Sequence[str] = (), within: int = WITHIN) -> DataFrame:
    """`by`, node and root (the component's smallest node) for every node of `edges` (`by`, a, b), each `by` a graph of its own.

    Large and small stars in turn, until nothing moves: a logarithmic number of rounds, whatever the shape.
    """
    keys = list(by)
    nodes = _both(edges, keys).select(*keys, F.col("x").alias("node")).distinct()
    live = cut(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while (n := live.count()) > within:
        before = live
        for large in (True, False):
            ends = _both(live, keys) if large else live.select(*keys, F.col("a").alias("x"), F.col("b").alias("y"))
            least = ends.groupBy(*keys, "x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
            moved = spread_join(ends, least, [*keys, "x"])
            hung = moved.where("y > x" if large else "y > m").select(*keys, F.col("y").alias("a"), F.col("m").alias("b"))
            if not large:
                hung = hung.union(least.where("x > m").select(*keys, F.col("x").alias("a"), F.col("m").alias("b")))
            live = cut(hung.where("a > b").distinct())
        if live.count() == n and live.exceptAll(before).isEmpty():
            break
    else:
        live = _in_one_task(live, keys)
    rows = nodes.join(live.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")), [*keys, "node"], "left")
    return rows.select(*keys, "node", F.coalesce("root", "node").alias("root"))


def _in_one_task(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    def solved(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([start, *frames])
        graph = rows.groupby(keys, sort=False).ngroup().to_numpy() if keys else np.zeros(len(rows), "int64")
        names, place = np.unique(np.concatenate([rows["a"], rows["b"]]).astype("int64"), return_inverse=True)
        # by graph and node, so that the least number of a component is its smallest node
        codes, ends = np.unique(np.concatenate([graph, graph]) * len(names) + place, return_inverse=True)
        top = tops(len(codes), ends[: len(rows)], ends[len(rows) :])
        moved = np.flatnonzero(top != np.arange(len(codes)))
        some = np.zeros(len(codes), "int64")
        some[ends] = np.tile(np.arange(len(rows)), 2)  # an edge of each node, for its keys
        found = {c: rows[c].to_numpy()[some[moved]] for c in keys}
        yield pd.DataFrame(found | {"a": names[codes[moved] % max(1, len(names))], "b": names[codes[top[moved]] % max(1, len(names))]})

    start = pd.DataFrame({c: pd.Series(dtype="int64" if c in ("a", "b") else "object") for c in (*keys, "a", "b")})
    return edges.coalesce(1).mapInPandas(solved, edges.schema)


def tops(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, of nodes below `n` and edges `a`, `b`.

    All edges at once hang the higher top below the lower one, and paths are halved to the end, until no edge joins two tops.
    """
    top = np.arange(n)
    while len(a):
        a, b = top[a], top[b]
        two = a != b
        a, b = np.maximum(a, b)[two], np.minimum(a, b)[two]
        np.minimum.at(top, a, b)
        while not np.array_equal(above := top[top], top):
            top = above
    return top


def spanning_forest(edges: DataFrame, within: int = WITHIN) -> DataFrame:
    """a, b and w of the minimum spanning forest of `edges` (a, b, w double); ties go by (w, a, b) with a < b.

    Boruvka: every component takes its least edge outwards, components that these join become one, and of parallel edges the
    least stays.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a < b")
    live = ends.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("p"), F.col("b").alias("q"), F.struct("w", "a", "b").alias("e"))
    whole = edges.select("a", "b", "w").limit(0)
    while (n := (live := cut(live)).count()) > within:
        ways = [live.select(F.col(p).alias("x"), F.struct(F.col("e"), F.col(q).alias("y")).alias("m")) for p, q in (("p", "q"), ("q", "p"))]
        best = cut(ways[0].union(ways[1]).groupBy("x").agg(F.min("m").alias("m")))
        whole = whole.union(best.select("m.e.a", "m.e.b", "m.e.w").distinct())
        root = cut(components(best.select(F.col("x").alias("a"), F.col("m.y").alias("b")), within=within))
        for end in ("p", "q"):
            new = root.select(F.col("node").alias(end), F.col("root").alias("_new"))
            live = spread_join(live, new, [end]).withColumn(end, F.col("_new")).drop("_new")
        live = live.where("p <> q").groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min("e").alias("e"))
    if n:
        rest = live.select("p", "q", F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.col("e.w").alias("w"))
        whole = whole.union(rest.coalesce(1).sortWithinPartitions("w", "a", "b").mapInPandas(_kruskal, "a long, b long, w double"))
    return cut(whole)


def _kruskal(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = Sets()
    for frame in frames:
        kept = [sets.join(p, q) for p, q in zip(frame["p"].tolist(), frame["q"].tolist())]
        yield frame.loc[kept, ["a", "b", "w"]]


def merges_of_heavy(forest: DataFrame, sizes: DataFrame, least: int, within: int = WITHIN) -> DataFrame:
    """rank of each edge of `forest` (a, b, rank) that joins two parts of `least` nodes or more when edges are taken by rank.

    sizes: node, n. Halves of a graph are judged apart: the parts that the lower half of the edges makes are graphs of their own, and
    in the upper half each of them is one node of its size. Graphs of less than twice `least` hold no such edge and go; those of
    `within` edges at most are judged in one task each.
    """
    live = forest.select(F.lit("").alias("g"), "rank", "a", "b")
    for end in ("a", "b"):
        live = spread_join(live, sizes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}")), [end])
    found = forest.select("rank").limit(0)

    def judged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        size = dict(zip(group["a"], group["na"])) | dict(zip(group["b"], group["nb"]))
        sets, ranks = Sets(), []
        for rank, a, b in zip(group["rank"].tolist(), group["a"].tolist(), group["b"].tolist()):
            a, b = sets.top(a), sets.top(b)
            if size[a] >= least and size[b] >= least:
                ranks.append(rank)
            sets.join(a, b)
            size[min(a, b)] = size[a] + size[b]
        return pd.DataFrame({"rank": ranks}, dtype="int64")

    while not (live := cut(live.select("g", "rank", "a", "b", "na", "nb"))).isEmpty():
        middle = F.least(F.percentile_approx("rank", 0.5), F.max("rank") - 1)
        per = cut(live.groupBy("g").agg(F.count("*").alias("_edges"), middle.alias("_middle")))
        rows = cut(spread_join(live, per, ["g"]))
        found = found.union(rows.where(F.col("_edges") <= within).select(*live.columns).groupBy("g").applyInPandas(judged, "rank long"))
        big = rows.where(F.col("_edges") > within)
        low, high = big.where("rank <= _middle"), big.where("rank > _middle")
        root = cut(components(low, ["g"], within))
        ends = low.select("g", F.col("a").alias("node"), F.col("na").alias("n")).union(low.select("g", "b", "nb")).distinct()
        total = root.join(ends, ["g", "node"]).groupBy("g", "root").agg(F.sum("n").alias("total"))
        root = cut(spread_join(root, total, ["g", "root"]))
        new = lambda end: root.select("g", F.col("node").alias(end), F.col("root").alias("_root"), F.col("total").alias("_total"))
        parts = spread_join(low, new("a"), ["g", "a"]).where(F.col("_total") >= 2 * least)
        parts = parts.withColumn("g", F.concat_ws(".", "g", F.col("_root").cast("string")))
        for end in ("a", "b"):
            high = spread_join(high, new(end), ["g", end], "left")
            high = high.withColumn(f"n{end}", F.coalesce("_total", f"n{end}")).withColumn(end, F.coalesce("_root", end)).drop("_root", "_total")
        live = parts.select(*live.columns).union(high.withColumn("g", F.concat_ws(".", "g", F.lit("h"))).select(*live.columns))
    return cut(found)


