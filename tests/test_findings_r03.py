"""Odd rows and larger inputs that a review of the third round found."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from convoweave.operators import chunking, search
from convoweave.operators.keyword import bm25
from convoweave.operators.keyword_index import KeywordIndex
from convoweave.plans import catalog
from convoweave.session import shared_dir


def test_session_examples_keep_line_ends_as_sql_does(spark, tmp_path):
    """A summary is cut at 20 characters, so that an example may end with a line end; SQL's trim takes spaces alone."""
    said = [(0, 1, "user", "nineteen letters ab\nmore"), (0, 2, "assistant", "yes"), (4, 1, "user", "  spaces "), (8, 1, "user", "q\t")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = dict(con.execute(catalog.ORACLE_SQL["session_examples"]).fetchall())
    assert want["c0"] == "about nineteen letters ab\n"
    got = {r["session_id"]: r["example"] for r in catalog.QUERIES["session_examples"](spark, str(tmp_path)).collect()}
    assert got == want


def test_blocks_are_written_where_they_are_made_and_rare_terms_share_rows(spark, tmp_path):
    """Each task writes its own file into each folder, so no block is shuffled; rows do not grow with rare terms."""
    words = [" ".join(f"w{k * j}" for j in range(1, 30)) for k in range(1, 400)]
    docs = spark.createDataFrame([(str(k), f"all {w}") for k, w in enumerate(words)], "id string, text string").repartition(3)
    index = KeywordIndex(spark, str(tmp_path / "k"))
    index.put(docs)
    rows = spark.read.parquet(f"{tmp_path}/k/segment=1/rows")
    assert rows.where("bucket = 0").select("_metadata.file_path").distinct().count() == 3
    terms = {t for w in words for t in w.split()}
    assert rows.where("bucket >= 0").count() < len(terms)
    index.remove(docs.where("id % 2 = 0"))
    index.compact(whole=True)
    left = docs.where("id % 2 = 1")
    for asked in ("w5", "all w60 w397", "w0"):
        found, want = ([(r["id"], round(r["score"], 10)) for r in x.collect()] for x in (index.search(asked, 400), bm25(left, asked, 400)))
        assert found == want


def test_large_shards_are_merged_without_a_shuffle(spark, tmp_path):
    """Shards over half a block stay shards of their own; only smaller ones are put together."""
    docs = spark.createDataFrame([(str(k), f"all w{k}") for k in range(100)], "id string, text string").coalesce(1)
    index = KeywordIndex(spark, str(tmp_path / "k"), block=16)
    index.put(docs)
    index.put(docs.where("id < 3"))
    index.compact(whole=True)
    rows = spark.read.parquet(f"{tmp_path}/k/segment=3/rows").where("bucket = -1")
    names = sorted(r["shard"][0] for r in rows.select("shard").collect())
    assert names == ["a"] * 6 + ["m"]
    found, want = ([(r["id"], round(r["score"], 10)) for r in x.collect()] for x in (index.search("all w2", 100), bm25(docs, "all w2", 100)))
    assert found == want


def test_pieces_of_a_long_text_are_cut_once(spark):
    """A text's pieces were cut anew for each piece, which took hours on this text."""
    text = "\n".join("a😀b \r" + "x" * 60 for _ in range(20_000)) + "end"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    got = [r[0] for r in rows.select(chunking.overlapping(chunking.hard_cut(F.col("text")))).collect()]
    want = [text[max(0, k - 120) : k + 900] for k in range(0, len(text), 900)]
    assert got == [want, [], []]


def test_pairs_come_a_few_at_a_time(spark, monkeypatch):
    """Every pair of a slab and a block repeats the slab, so their number in a batch must not grow with the blocks."""
    seen = []
    monkeypatch.setattr(search, "cut", lambda df: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df.checkpoint())
    vectors = spark.createDataFrame([(str(k), [float(k % 7), float(k % 11)]) for k in range(300)], "chunk_key string, embedding array<float>")
    asked = vectors.where("chunk_key < '13'").withColumnRenamed("chunk_key", "query")
    shared_dir(spark)
    got = {(r["query"], r["rank"]): (r["key"], r["score"]) for r in search.nearest_each(vectors, asked, 3).collect()}
    assert seen[-1] == str(search.PAIRS)
    for q in ("0", "12", "129"):
        best = sorted((-float(int(q) % 7 * (k % 7) + int(q) % 11 * (k % 11)), str(k)) for k in range(300))[:3]
        assert [got[q, n + 1] for n in range(3)] == [(k, -s) for s, k in best]
