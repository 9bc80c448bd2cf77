"""Whitening against plain numpy, exact top-k search against all scores, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoweave.llm import vector_file, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n string, whitened string"


def plain_whitening(vectors, components=32):
    """By vec_id: deviation; and the eigenvalues and axes, from exact integers."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[k] for v in x.values()) for k in range(d)]
    deviation = {i: sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True)) for i, v in x.items()}
    exact = [[sum((n * v[j] - sums[j]) * (n * v[k] - sums[k]) for v in x.values()) / n**3 for k in range(d)] for j in range(d)]
    values, axes = np.linalg.eigh(np.array(exact))
    order = np.argsort(-values)[:components]
    return n, deviation, values[order], axes[:, order], np.trace(np.array(exact)), {i: (np.array(v) * float(n) - np.array(sums, float)) / n for i, v in x.items()}


def test_whitening_equals_plain_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    n, deviation, values, axes, trace, centred = plain_whitening(vectors)
    rows = whitening.op11_whitening(spark, SF).collect()
    assert len(rows) == 32 * n
    sign = {}
    for r in rows:
        k = r["component"] - 1
        want = float(centred[r["vec_id"]] @ axes[:, k]) / math.sqrt(values[k])
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(want) > 1e-3:
            assert sign.setdefault(k, r["whitened"] * want > 0) == (r["whitened"] * want > 0)
        assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-6)


def test_partitions_merge_to_the_same_fit(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding")
    one, many = (whitening.fit(df.repartition(k))[64] for k in (1, 37))
    assert one.n == many.n and one.sums == many.sums
    assert np.allclose(one.values, many.values, rtol=1e-12)


def test_whitening_of_odd_vectors(spark):
    good = [(k, [k % 3 / 2, k * 0.25, 1.5]) for k in range(12)]
    odd = [(20, None), (21, [1.0, None, 2.0]), (22, [1.0, float("nan"), 2.0]), (23, [float("inf"), 0.0, 0.0]), (24, []), (25, [1e300, 0.0, 0.0]), (None, [0.5, 0.5, 1.5]), (3, [1.0, 0.75, 1.5])]
    other = [(30, [1.0, 2.0]), (31, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in good + odd + other], SCHEMA)
    rows = whitening.whitened(df).collect()
    three = [r for r in rows if r["n"] == 14]
    assert len(three) == 14 * 3 and {r["vec_id"] for r in three} == {*range(12), None}
    assert {r["n"] for r in rows} == {14, 2} and len(rows) == 14 * 3 + 2 * 2
    assert all(r["whitened"] is None for r in three if r["component"] == 3)  # the third entry never varies
    assert all(abs(r["whitened"]) < 10 and r["identity_error"] < 1e-9 for r in three if r["component"] < 3)
    same = whitening.whitened(spark.createDataFrame([(1, [0.5, 2.0], "", ""), (1, [0.5, 2.0], "", "")], SCHEMA)).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(2, 0, None, None, None)} and len(same) == 4
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deviations_beyond_a_long_are_exact_or_null():
    x = np.array([[2**51], [-(2**51)], [0]])
    w = whitening.Whitener(3, [0], np.zeros(1), np.eye(1), np.ones(1), 1.0, 0)
    assert w.deviations(x) == [None, None, 0]
    near = np.array([[2**29], [-(2**29)]])
    assert whitening.Whitener(2, [0], np.zeros(1), np.eye(1), np.ones(1), 1.0, 0).deviations(near) == [2**60, 2**60]


def all_scores(vectors, top=5, every=50):
    """query_id, rank, vec_id, score by comparing each query with every vector, in Python integers."""
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    found = []
    for i, q in x:
        if i is not None and i % every == 0:
            scores = [(-min(max(sum(map(int.__mul__, q, c)), -(2**63)), 2**63 - 1), j is None, j or 0, j) for j, c in x if j != i and len(c) == len(q)]
            found += [(i, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(found, key=repr)


def found_scores(df, **how):
    return sorted((tuple(r) for r in vector_file.top_scores(df, F.col("vec_id") % 50 == 0, **how).collect()), key=repr)


def test_exact_search_equals_all_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = all_scores(vectors)
    assert sorted((tuple(r) for r in vector_file.op13_exact_search(spark, SF).select("query_id", "rank", "vec_id", "score").collect()), key=repr) == want
    assert found_scores(df.repartition(7), queries=3, cells=4, sample=50) == want


def test_search_skips_most_exact_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = np.floor(64 * (centres[rng.integers(0, 20, 4000)] + 0.1 * rng.standard_normal((4000, 16)))).astype(np.int64)
    rows = spark.createDataFrame([(k, True, 16, v.tobytes()) for k, v in enumerate(x)], "vec_id long, known boolean, dims int, vec binary")
    cells = vector_file.Cells(rows, 64, 1000)
    codes = cells.codes(x)
    middle, half = cells.corners(codes)
    assert (np.abs(x - middle) <= half).all()
    block = vector_file.Block(np.arange(50), np.arange(50), x[:50], 5)
    ids, known = np.arange(4000), np.ones(4000, bool)
    exact = x[:50] @ x.T
    exact[np.arange(50), np.arange(50)] = -(10**9)
    for _, _, lower, upper in vector_file.bounds(block, cells, ids, known, codes):
        inside = lower > -np.inf
        assert (lower[inside] <= exact[inside]).all() and (exact[inside] <= upper[inside]).all()
        floor = np.sort(lower, axis=1)[:, -5]
        assert (floor <= np.sort(exact, axis=1)[:, -5]).all()
        assert (upper >= floor[:, None]).mean() < 0.1


def test_search_of_ties_and_odd_vectors(spark):
    vectors = [(k, [float(k % 3), 1.0]) for k in range(40)] + [(50, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [-1.0, 0.5]), (None, [2.0, 1.0]), (None, None), (7, [])]
    vectors += [(150, [1.0]), (151, [0.5]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [2.0**53, 1.0]), (301, [-(2.0**45), 3.0]), (350, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in vectors], SCHEMA)
    want = all_scores(vectors)
    assert found_scores(df) == found_scores(df.repartition(5), queries=2, cells=2, sample=2) == want
    huge = [(k, [float(2**50) * (k - 3), 2.0**30 + k, -1.0]) for k in range(8)] + [(50, [2.0**53, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in huge], SCHEMA)
    assert found_scores(df) == all_scores(huge)
    assert found_scores(spark.createDataFrame([], SCHEMA)) == []


def test_search_agrees_with_sql(spark):
    from parity import assert_same

    assert assert_same(spark, vector_file.op13_exact_search, vector_file.ORACLE_SQL["op13_exact_search"])
