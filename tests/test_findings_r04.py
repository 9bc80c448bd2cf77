"""Odd rows and larger inputs that a review of the fourth round found."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from convoweave.operators import search


def best(vectors: list, asked: list, limit: int) -> dict:
    """query: key and score of the best, by Python, to 12 digits; NaN is above all scores, as in SQL."""
    out = {}
    for q, x in asked:
        scored = []
        for k, e in vectors:
            s = 0.0
            for a, b in zip(x, e, strict=True):
                s += a * b
            s = s if math.isinf(s * 1e12) else round(s * 1e12) / 1e12 if s == s else s
            scored.append((not math.isnan(s), -s if s == s else 0.0, k, s))
        out[q] = [(k, "nan" if s != s else s) for *_, k, s in sorted(scored)[:limit]]
    return out


def found(df) -> dict:
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["key"], "nan" if r["score"] != r["score"] else r["score"]))
    return out


def test_rows_to_rank_do_not_grow_with_slabs(spark, monkeypatch):
    """each slab gave its best for each query, all of which were sorted in memory; now a task gives them once, for all its slabs."""
    monkeypatch.setattr(search, "SLAB", 8)
    ranked = []
    plain = type(spark.range(1)).withColumn
    monkeypatch.setattr(type(spark.range(1)), "withColumn", lambda df, name, c: (ranked.append(df) if name == "rank" else None, plain(df, name, c))[1])
    rows = [(f"v{k}", [float(k % 17 - 8), float(k % 23 - 11)]) for k in range(800)]
    vectors = spark.createDataFrame(rows, "chunk_key string, embedding array<double>").repartition(4)
    asked = [(f"q{k}", rows[k][1]) for k in range(0, 800, 20)]
    queries = spark.createDataFrame(asked, "query string, embedding array<double>")
    for block in (1024, 16):  # one block that is broadcast; three that every share of the slabs meets
        monkeypatch.setattr(search, "BLOCK", block)
        assert found(search.nearest_each(vectors, queries, 5)) == best(rows, asked, 5)
        assert ranked[-1].count() <= 4 * len(asked) * 5  # of four partitions, although of 100 slabs


def test_copies_and_odd_numbers_keep_the_order_of_sql(spark, monkeypatch):
    """Ties go by key over all slabs, however many copies there are; NaN is above all, and was dropped where it filled a slab's places."""
    monkeypatch.setattr(search, "SLAB", 16)
    monkeypatch.setattr(search, "BLOCK", 8)
    nan, inf = math.nan, math.inf
    odd = [[nan, 0.0], [inf, 1.0], [-inf, 1.0], [1e300, 1.0], [-1e300, 1e-300], [1e200, 0.0], [0.0, -0.0], [-0.0, 1.0]]
    rows = [(f"c{k}", [1.0, 2.0]) for k in range(120)] + [(f"v{k}", [float(k % 7 - 3), float(k % 5 - 2)]) for k in range(120)] + [(f"o{k}", odd[k % 8]) for k in range(48)]
    vectors = spark.createDataFrame(rows, "chunk_key string, embedding array<double>").repartition(3)
    asked = [("a", [1.0, 2.0]), ("b", [0.0, 0.0]), ("c", [-1.0, 0.5]), ("d", [1.0, inf]), ("e", [nan, 1.0]), ("f", [1e200, 1.0]), ("g", [-2.0, -4.0])] + [(f"n{k}", [float(k), -1.0]) for k in range(9)]
    queries = spark.createDataFrame(asked, "query string, embedding array<double>")
    for limit in (3, 40, 500):
        assert found(search.nearest_each(vectors, queries, limit)) == best(rows, asked, limit)


def test_equal_vectors_tie_in_slabs_of_any_size():
    """A product of matrices may differ in its last digit by place; a score must not, since 12 digits of it decide ties."""
    rng = np.random.default_rng(4)
    some, q = rng.standard_normal((7, 64)), rng.standard_normal((3, 64))
    scores = []
    for n in (1, 2, 3, 7):
        b = search.Best(pa.array(["0", "1", "2"]), q, 7)
        b.meet(pa.array([f"k{k}" for k in range(n)]), some[:n])
        scores.append({(r["query"], r["key"]): r["score"] for x in b.rows() for r in x.to_pylist()})
    assert len(scores[-1]) == 21
    assert all(scores[-1][k] == s for x in scores for k, s in x.items())


def test_memory_of_a_task_is_that_of_its_block():
    """However many slabs pass, twice the places of a block's queries are held, also while every slab is better than all before."""
    rng = np.random.default_rng(5)
    b = search.Best(pa.array([str(k) for k in range(20)]), np.abs(rng.standard_normal((20, 4))), 10)
    held = []
    for k in range(50):
        b.meet(pa.array([f"{k}-{n}" for n in range(64)]), np.abs(rng.standard_normal((64, 4))) * (k + 1))
        held.append(b.held)
    assert max(held) <= 2 * 10 * 20
    assert sum(x.num_rows for x in b.rows()) == 200
