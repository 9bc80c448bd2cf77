"""The stored keyword index against a scan of all texts, after every kind of change."""

import random

import pytest
from pyspark.sql import functions as F

from convoweave.operators import keyword, keyword_index
from convoweave.operators.keyword_index import KeywordIndex
from parity import SF_DIR

WORDS = [f"w{k}" for k in range(60)]


def texts(rng, n, tag=""):
    return [(f"{tag}{k}", " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([1, 3, 10, 40, 160])))) for k in range(n)]


def check(index, spark, docs, queries=("w59", "w1 w1 w40 w7", "none w0 w2")):
    df = spark.createDataFrame(list(docs.items()), "id string, text string")
    for q in queries:
        want = [(r["id"], round(r["score"], 10)) for r in keyword.bm25(df, q, 1000).collect()]
        for limit in (3, 1000):
            assert [(r["id"], round(r["score"], 10)) for r in index.search(q, limit).collect()] == want[:limit], (q, limit)


def test_index_equals_a_scan_after_every_change(spark, tmp_path):
    rng = random.Random(2)
    index, docs = KeywordIndex(spark, str(tmp_path / "k"), block=16), {}
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    assert index.search("w1", 5).count() == 0
    first = texts(rng, 300)
    index.put(frame(first))
    docs |= dict(first)
    check(index, spark, docs)
    again = [(f"{k}", t) for k, (_, t) in zip(range(0, 300, 7), texts(rng, 43), strict=True)]
    index.put(frame([*again, ("empty", ""), ("null", None)]))
    docs |= dict(again) | {"empty": "", "null": None}
    check(index, spark, docs)
    index.remove(frame([(str(k), "") for k in range(0, 300, 5)] + [("unknown", "")]))
    docs = {i: t for i, t in docs.items() if not (i.isdigit() and int(i) % 5 == 0)}
    check(index, spark, docs)
    back = [("5", "w59 w3"), ("10", "w0")]
    index.put(frame(back))
    docs |= dict(back)
    index.compact()
    check(index, spark, docs)
    index.compact(whole=True)
    assert len(index._manifest()) == 1 and not index._manifest()[0]["dead"]
    check(index, spark, docs)
    assert {r["id"] for r in index.docs().collect()} == set(docs)


def test_many_small_changes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "SEGMENTS", 3)
    rng = random.Random(3)
    index, docs = KeywordIndex(spark, str(tmp_path / "k")), {}
    for k in range(6):
        rows = texts(rng, 12, f"{k % 4}-")
        index.put(spark.createDataFrame(rows, "id string, text string"))
        docs |= dict(rows)
    assert len(index._manifest()) <= 4
    check(index, spark, docs, ("w0 w3",))


def test_heal_and_ids(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "k"))
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    index.put(frame([("a", "one two"), ("b", "two")]))
    assert index.heal(frame([("b", "two"), ("c", "two three")])) == (1, 1)
    check(index, spark, {"b": "two", "c": "two three"}, ("two", "one", "three two"))
    assert index.heal(frame([("b", "two"), ("c", "two three")])) == (0, 0)
    for bad in ([("a", "x"), ("a", "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="identifiers"):
            index.put(frame(bad))
    check(index, spark, {"b": "two", "c": "two three"}, ("two",))


def test_a_search_reads_its_terms_blocks_alone(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    index = KeywordIndex(spark, str(tmp_path / "k"), block=8)
    index.put(docs)
    found = index.search("the apache", 5)
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "text:" not in plan and "bucket" in plan.split("PartitionFilters")[1].splitlines()[0] and "PushedFilters: [In(term" in plan
    want = [(r["id"], round(r["score"], 9)) for r in keyword.bm25(docs, "the apache", 5).collect()]
    assert [(r["id"], round(r["score"], 9)) for r in found.collect()] == want
    blocks = index._blocks(index._manifest(), ["the", "apache"])
    assert blocks.select("segment", "shard").distinct().count() > 20


def test_shards_that_cannot_reach_the_floor_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "PROBED", 2)
    docs = [(f"s{k}", f"rare x{k}") for k in range(20)] + [(f"l{k}", "rare " + "word " * (50 + 20 * k)) for k in range(200)]
    index = KeywordIndex(spark, str(tmp_path / "k"), block=16)
    index.put(spark.createDataFrame(docs, "id string, text string"))
    check(index, spark, dict(docs), ("rare", "rare x3"))
    plan = index.search("rare", 5)
    assert "LeftSemi" in plan._jdf.queryExecution().optimizedPlan().toString()
