"""Density clusters against a plain single-task version, which makes the whole merge tree and condenses it."""

import math

import numpy as np
from pyspark.sql import functions as F

from convoweave.functions.vectors import normalised
from convoweave.operators import density, graphs


def plain_edges(v, n, k, samples=3):
    """Mutual reachability of the k nearest neighbours of each row of `v`, by all distances."""
    d = np.array([np.sqrt(((v - x) ** 2).sum(axis=1)) for x in v])
    np.fill_diagonal(d, np.inf)
    near = [sorted(range(len(v)), key=lambda j: (d[i, j], j))[: min(k, len(v) - 1)] for i in range(len(v))]
    core = []
    for i, js in enumerate(near):
        rows, reach = n[i], 0.0 if n[i] >= samples else math.inf
        for j in js:
            rows += n[j]
            if reach == math.inf and rows >= samples:
                reach = d[i, j]
        core.append(reach)
    return {(min(i, j), max(i, j)): max(core[i], core[j], d[i, j]) for i, js in enumerate(near) for j in js}


def plain_leaves(n, edges, least):
    """Sets of nodes: the leaves of the condensed tree, none if the tree has no split."""
    parent, tree = list(range(len(n))), {i: None for i in range(len(n))}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    size = list(n)
    for (a, b), _ in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        a, b = top(a), top(b)
        if a != b:
            parent.append(len(parent))
            size.append(size[a] + size[b])
            tree[len(parent) - 1] = (a, b)
            parent[a] = parent[b] = len(parent) - 1
    # trees that no edge joins meet above: heavy ones count as split from each other
    tops = [x for x in range(len(parent)) if parent[x] == x]
    heavy = [x for x in tops if size[x] >= least]

    def members(x):
        stack, out = [x], set()
        while stack:
            y = stack.pop()
            out.add(y) if tree[y] is None else stack.extend(tree[y])
        return out

    found = []

    def condense(born):
        node = born
        while tree[node] is not None:
            a, b = sorted(tree[node], key=lambda c: -size[c])
            if size[b] >= least:
                return [*condense(a), *condense(b)]
            if size[a] < least:
                break
            node = a
        return [members(born)]

    for x in heavy:
        found += condense(x)
    return found if len(found) > 1 else []


def heaps(seed, groups, each, dims=8, spread=0.2, noise=20):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, dims))
    rows = [m + spread * rng.standard_normal((each, dims)) for m in middle]
    return np.concatenate([*rows, rng.standard_normal((noise, dims))])


def compared(spark, v, least, within, k):
    """Whether both versions give the same leaves; how many."""
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    _, points = density.nodes(rows)
    edges = density.reachability(points, density.neighbours(points, k=k))
    got = density.leaves(points, edges, least, within).toPandas()
    table = points.orderBy("node").toPandas()
    place = {node: i for i, node in enumerate(table["node"])}
    expected = plain_leaves(table["n"].tolist(), plain_edges(np.stack(table["v"]), table["n"].tolist(), k), least)
    assert {frozenset(map(place.get, g)) for g in got.groupby("cluster")["node"].apply(list)} == {frozenset(x) for x in expected}
    return len(expected)


def test_leaves_equal_those_of_the_condensed_tree(spark):
    v = heaps(1, 5, 30)
    v = np.concatenate([v, np.repeat(v[:3], 12, axis=0)])  # rows that stand there again
    assert compared(spark, v, 10, graphs.WITHIN, 12) > 2
    assert compared(spark, heaps(2, 4, 30, spread=0.02), 10, graphs.WITHIN, 4) > 2  # parts that no edge joins


def test_leaves_by_rounds_equal_those_of_one_task(spark):
    assert compared(spark, heaps(3, 3, 25, noise=10), 8, 60, 6) > 1


def test_components_by_rounds(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(40, 30), (30, 35), (7, 7), (50, 50), (40, 30)]
    rows = spark.createDataFrame([(g, a, b) for g in "xy" for a, b in edges if g == "x" or b != 11], "g string, a long, b long")
    got = {(r["g"], r["node"]): r["root"] for r in graphs.components(rows, ["g"], within=2).collect()}
    assert {v for (g, n), v in got.items() if g == "x" and n <= 20} == {1}
    assert {n: got["y", n] for n in (5, 10, 11, 20, 35, 40, 50)} == {5: 1, 10: 1, 11: 11, 20: 11, 35: 30, 40: 30, 50: 50}


def test_clusters_of_odd_vectors(spark):
    v = heaps(4, 3, 40, spread=0.05, noise=0)
    odd = [None, [0.0] * 8, [1.0] * 3, [math.nan] * 8, [None] * 8, [math.inf] * 8]
    rows = spark.createDataFrame([(i, x, "e") for i, x in enumerate([*v.tolist(), *odd, v[0].tolist()])], "id long, embedding array<double>, digest string")
    got = density.clustered(rows).toPandas().set_index("id")
    assert got["cluster"].isna().sum() == len(odd) and len(got) == 127
    assert got["cluster"].iloc[:40].nunique() == 1 and got["cluster"].nunique() == 3
    assert got.loc[0, "cluster"] == got.loc[126, "cluster"]
    assert density.clustered(rows.limit(0)) is None and density.clustered(rows.where("id < 3")) is None


def test_neighbours_found_in_blocks(spark):
    v = heaps(5, 12, 50, noise=0)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    _, points = density.nodes(rows)
    lists = [dict(density.neighbours(points, block=b).select("a", F.col("near.b")).collect()) for b in (2048, 100)]
    assert np.mean([len(set(lists[0][a]) & set(lists[1][a])) / len(lists[0][a]) for a in lists[0]]) >= 0.9


def test_lengths_are_worked_out_once(spark):
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), (None,)], "v array<float>").select(normalised(F.col("v")).alias("v"))
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1  # not once for each component
    assert [r["v"] for r in vectors.collect()] == [[0.6, 0.8], [0.0, 0.0], [None, None], None]


def test_descent_moves_lists_and_equals_plain_descent(spark, monkeypatch):
    v = heaps(6, 4, 60, noise=10)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    _, points = density.nodes(rows)
    best, given, lists = density.best, [], []

    def kept(rows, *rest):
        given.append(rows.count())
        lists.append(best(rows, *rest))
        return lists[-1]

    monkeypatch.setattr(density, "best", kept)
    monkeypatch.setattr(density, "HUB", 12)  # so that some nodes are copied
    density.neighbours(points, k=5, tables=2, block=60, rounds=1)
    assert given[0] <= 2 * len(v) and given[-1] <= 7 * len(v)  # lists of nodes, not pairs
    before, after = ({r["a"]: [(x["d"], x["b"]) for x in r["near"]] for r in x.collect()} for x in (lists[0], lists[-1]))
    at = dict(points.select("node", "v").collect())
    found = {a: set(near) for a, near in before.items()}
    for owner, near in before.items():
        group = [owner, *(b for _, b in near)]
        for a in group:
            found[a] |= {(float(np.sqrt(((np.array(at[a]) - np.array(at[b])) ** 2).sum())), b) for b in group if b != a}
    assert after == {a: sorted(x)[:5] for a, x in found.items()} and after != before


def test_components_of_arrays():
    for seed in range(50):
        rng = np.random.default_rng(seed)
        n, m = int(rng.integers(1, 60)), int(rng.integers(0, 80))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        sets = graphs.Sets()
        for x, y in zip(a.tolist(), b.tolist()):
            sets.join(x, y)
        assert graphs.tops(n, a, b).tolist() == [sets.top(i) for i in range(n)]
