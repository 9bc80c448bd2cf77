"""Cases that the driver tables do not hold: ties, cycles, tombstones, snapshots, replies, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoweave.functions import text, times, vectors
from convoweave.operators import chunking, enrich, folders as fo, keyword, merge, quality, search, semantic_map as sm, turns as tu
from convoweave.plans import listing
from convoweave.sources import archive_io
from convoweave.session import settings
from convoweave.streaming.turn_stream import keep_latest, stream_turns


def test_chunk_pieces():
    long = "para one. " * 60 + "\n\n" + "w" * 2000 + "\n\n" + "short"
    got = chunking.pieces(long, 900)
    assert max(map(len, got)) <= 900
    assert got[-1].endswith("short")
    assert chunking.pieces("abc", 900) == ["abc"]
    assert chunking.pieces("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]


def test_chunks_hold_whole_long_texts(spark):
    text = " ".join(f"w{k:04d}" for k in range(4000))
    rows = spark.createDataFrame([("a", text)], "id string, embed_text string")
    found = "\n".join(r["text"] for r in chunking.chunks(rows, limit=None).collect())
    assert all(word in found for word in text.split())
    assert sum(len(r["text"]) for r in chunking.chunks(rows, limit=1000).collect()) <= 1000 + chunking.OVERLAP


def test_query_chunks_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    last = {r["turn_id"]: r["text"] for r in listing.chunk_recursive(spark, sf).orderBy("idx").collect()}
    long = spark.read.parquet(f"{sf}/documents.parquet").where("char_length(text) > 12000").collect()
    assert long
    assert all(r["text"].rstrip().endswith(last[str(r["doc_id"])].rstrip()[-40:]) for r in long)


def test_chunks_of_turns(spark):
    rows = spark.createDataFrame([("a", "x" * 950), ("b", "  "), ("c", "y"), ("d", "z " * 10_000)], "id string, embed_text string")
    got = chunking.chunks(rows).groupBy("turn_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("m")).collect()
    assert {r["turn_id"]: r["n"] for r in got} == {"a": 2, "c": 1, "d": 14}
    assert max(r["m"] for r in got) <= 1020
    first = {r["chunk_key"]: r["text"] for r in chunking.chunks(rows.where("id = 'a'")).collect()}
    assert first == {"a#0": "x" * 900, "a#1": "x" * 170}


@pytest.mark.parametrize(("question", "answer", "keep"), [("OK", "short", False), ("ok", "a long enough answer", True), ("hm", "no", False), ("a longer question", "", True)])
def test_worth_embedding(spark, question, answer, keep):
    row = spark.createDataFrame([(question, answer, [])], "q string, a string, x array<struct<tool:string,detail:string>>")
    assert row.select(text.worth_embedding(F.col("q"), F.col("a"), F.col("x"))).first()[0] is keep


def test_calendar_days(spark):
    rows = spark.createDataFrame([("2026-07-21T15:30:00Z",), ("2026-07-22T14:30:00Z",), ("2026-07-22T15:30:00Z",), ("2026-07-21T14:30:00Z",), ("no time",), ("2026-07-22T01:00",)], "t string")
    kept = [r["t"] for r in rows.where(times.within(F.col("t"), "2026-07-22", "2026-07-22")).collect()]
    assert kept == ["2026-07-21T15:30:00Z", "2026-07-22T14:30:00Z", "no time", "2026-07-22T01:00"]


def test_strict_previous_question(spark):
    rows = spark.createDataFrame([("a", "s", "1", "q1"), ("b", "s", "2", ""), ("c", "s", "3", "q3"), ("d", "s", "3", "q4")], "id string, session_id string, timestamp string, question string")
    got = lambda strict: {r["id"]: r["previous_question"] for r in tu.with_previous_question(rows, strict).collect()}
    assert got(False) == {"a": None, "b": "q1", "c": "q1", "d": "q3"}
    assert got(True) == {"a": None, "b": "q1", "c": "q1", "d": "q1"}


def test_bm25_counts_repeated_terms_and_common_ones(spark):
    docs = spark.createDataFrame([("1", "alpha beta"), ("2", "alpha gamma gamma"), ("3", "delta")], "id string, text string")
    one = {r["id"]: r["score"] for r in keyword.bm25(docs, "gamma", 9).collect()}
    two = {r["id"]: r["score"] for r in keyword.bm25(docs, "gamma gamma", 9).collect()}
    assert two == {"2": pytest.approx(2 * one["2"])}
    assert 0 < keyword.bm25(docs, "alpha", 9).first()["score"] < 1e-5
    assert keyword.bm25(docs, "?!", 9).count() == 0
    assert keyword.query_terms("café 한글9", compat=True) == ["caf", "한글", "9"]


def test_fusion_order_and_modes(spark):
    turns = spark.createDataFrame([(str(k), f"s{k}", "p", f"q{k}", "2026-01-01T00:00:00Z", None, f"word{k} same") for k in range(6)], "id string, session_id string, project string, question string, timestamp string, source string, text string")
    vecs = spark.createDataFrame([(f"{k}#0", [float(k == j) for j in range(6)]) for k in range(6)], "chunk_key string, embedding array<float>")
    hits = search.search(turns, vecs, "word2", [0.0, 0.0, 1.0, 0.5, 0.0, 0.0], k=3).orderBy("place").collect()
    assert [h["id"] for h in hits] == ["2", "3", "0"]
    assert hits[0]["sources"] == "keyword,semantic"
    assert [h["id"] for h in search.search(turns, vecs, "word4", [1.0] + [0.0] * 5, k=3, mode="keyword").collect()] == ["4"]
    assert search.search(turns, vecs, "word4", [1.0] + [0.0] * 5, k=2, mode="semantic").count() == 2


def test_zero_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "z array<float>, v array<float>")
    got = row.select(vectors.normalised(F.col("z")), vectors.normalised(F.col("v")), vectors.int8(F.col("v"))).first()
    assert got[0] == [0.0, 0.0]
    assert got[1] == [0.6, 0.8]
    assert got[2] == [127, 127]


def test_folder_cycles_and_moves(spark):
    f = spark.createDataFrame([(1, "a", None, 0.0), (2, "b", 1, 0.0), (3, "c", 2, 0.0), (9, "lost", 77, None)], "id long, name string, parent_id long, position double")
    assert not fo.may_move(f, 1, 3)
    assert fo.may_move(f, 3, 1)
    assert [(r["id"], r["depth"]) for r in fo.flattened(f).orderBy("place").collect()] == [(1, 0), (2, 1), (3, 2), (9, 0)]
    ring = spark.createDataFrame([(1, "a", 2, 0.0), (2, "b", 1, 0.0)], f.schema)
    assert fo.paths(ring, ring.where("id = 1")).count() == 2
    items = spark.createDataFrame([(3, "turn", "t")], "folder_id long, kind string, ref string")
    left, kept, gone = fo.deleted(f, items, 2)
    assert (left.count(), kept.count(), gone.count()) == (2, 0, 2)


def test_merge_ties_and_clocks(spark):
    schema = "id string, session_id string, question string, answer string, actions string, source string, source_file string, queued boolean, parser_version int"
    old = spark.createDataFrame([("a", "s", "q", "xx", "[]", None, None, False, 1)], schema)
    same = spark.createDataFrame([("a", "z", "q", "yy", "[]", None, None, False, 1)], schema)
    newer = spark.createDataFrame([("a", "z", "q", "y", "[]", None, None, False, 2)], schema)
    assert tuple(merge.upsert(old, same).select("session_id", "answer", "outcome").first()) == ("s", "yy", "replaced")
    assert tuple(merge.upsert(old, same, strict=True).select("answer", "outcome").first()) == ("xx", "rejected")
    assert merge.upsert(old, newer, strict=True).first()["answer"] == "y"
    local = spark.createDataFrame([("k", "mine", 5.0)], "key string, value string, at double")
    peer = spark.createDataFrame([("k", "same age", 5.0), ("n", "far ahead", 1e9), ("m", "fine", 50.0)], local.schema)
    assert {r["key"]: r["value"] for r in merge.last_writer(local, peer, "key", 100.0).collect()} == {"k": "mine", "m": "fine"}
    folders = spark.createDataFrame([("a", None, 1.0), ("b", "a", 1.0), ("c", "zz", 9.0)], "uid string, parent_uid string, at double")
    tombs = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "uid string, removed_at double")
    assert {(r["uid"], r["parent_uid"]) for r in merge.removed_by_peer(folders, tombs).collect()} == {("b", None), ("c", None)}
    name = spark.createDataFrame([("x.sync-conflict-20260101-010203-ABC.jsonl",), ("x.jsonl",)], "n string")
    assert [r[0] for r in name.select(merge.base_of_conflict(F.col("n"))).collect()] == ["x.jsonl", ""]


def test_snapshot_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("a", "s", "u", None, "t", "p", 'q "x"\n', "a", "[]", "codex", None)], "id string, session_id string, uuid string, parent_uuid string, timestamp string, project string, question string, answer string, actions string, source string, source_file string")
    chunks = spark.createDataFrame([("a", 1, "two"), ("a", 0, 'o"ne')], "turn_id string, idx int, text string")
    archive_io.write_snapshot(turns, chunks, str(tmp_path / "snap"))
    lines = archive_io.read_snapshot(spark, str(tmp_path / "snap"))
    assert lines.first()["valid"]
    assert archive_io.snapshot_turns(lines).select(*turns.columns).first() == turns.first()
    assert [(r["idx"], r["text"]) for r in archive_io.snapshot_chunks(lines).collect()] == [(0, 'o"ne'), (1, "two")]
    odd = ['{"title":["s","x",5]}', '{"title":["s","x","no clock"]}', '{"fold":["a",1]}', "broken", '{"t":["a"],"c":[]}', '{"other":[]}', '{"folder_x":["u",3.5]}']
    (tmp_path / "odd").write_text("\n".join(odd))
    assert [r["valid"] for r in archive_io.read_snapshot(spark, str(tmp_path / "odd")).collect()] == [True, False, False, False, False, False, True]


def test_days_do_not_depend_on_the_session(spark):
    rows = spark.createDataFrame([("2026-03-01T15:30:00Z",), ("2026-03-01T15:30:00",), ("2026-03-02T14:59:59Z",), ("2026-03-02T15:00:00Z",), ("2026-03-02",), ("no time",)], "t string")
    want = [r[0] for r in rows.where(times.within(F.col("t"), "2026-03-02", "2026-03-02")).collect()]
    assert want == ["2026-03-01T15:30:00Z", "2026-03-01T15:30:00", "2026-03-02T14:59:59Z", "2026-03-02", "no time"]
    with settings(spark, spark__sql__session__timeZone="America/New_York"):
        assert [r[0] for r in rows.where(times.within(F.col("t"), "2026-03-02", "2026-03-02")).collect()] == want
        assert rows.select(times.iso(times.instant(F.col("t")))).first()[0] == "2026-03-01T15:30:00Z"


def test_names_try_one_further_tag_at_a_time():
    got = sm.names({0: 9, 1: 8, 2: 7, 3: 6, 4: 5}, {0: ["a"], 1: ["a", "b"], 2: ["a", "b", "c"], 4: []}, {3: ["x"]}, {4: "head"})
    assert got == {0: "a", 1: "a · b", 2: "a · c", 3: "x", 4: "head"}


def test_redaction_and_replies():
    deep = record = {}
    for _ in range(12):
        record["k"] = {"type": "short"}
        record = record["k"]
    assert quality.redacted(deep)["k"]["k"]["k"]["k"]["k"]["k"]["k"]["k"] == {"type": "short", "k": "<...>"}
    value = {"type": "user", "status": "has spaces", "text": "secret", "list": [1, 2, 3, 4, 5, 6], "deep": {"a": {"b": [True, None]}}}
    assert quality.redacted(value) == {"type": "user", "status": "<str:10>", "text": "<str:6>", "list": [1, 2, 3, 4, "<+2 more>"], "deep": {"a": {"b": [True, None]}}}
    assert enrich.parsed('Sure!\n```json\n[{"id": "a", "tags": 5}, {"no": 1}]\n```') == [{"id": "a", "tags": 5}]
    assert enrich.parsed("nothing") == enrich.parsed("[broken") == []


def test_enrichment_ignores_unknown_ids(spark):
    turns = spark.createDataFrame([("a", "s", "1", "question one. Two", "x", None, None), ("b", "s", "2", "q", "y", "", None)], "id string, session_id string, timestamp string, question string, answer string, summary string, tags array<string>")
    backend = lambda rows: json.dumps([{"id": r["id"], "summary": "S", "tags": "no list"} for r in rows] + [{"id": "zz"}])
    made = enrich.enriched(turns, backend)
    assert [(r["id"], r["summary"], r["tags"]) for r in made.collect()] == [("a", "S", [])]
    assert {r["id"]: r["summary"] for r in enrich.applied(turns, made).collect()} == {"a": "S", "b": ""}


def test_map_names_and_succession(spark):
    old = spark.createDataFrame([(5, k) for k in range(10)] + [(6, k) for k in range(10, 20)], "cluster int, key int")
    new = spark.createDataFrame([(0, k) for k in range(8, 20)] + [(1, k) for k in range(8)] + [(2, 99)], "cluster int, key int")
    assert sm.succession(new, old) == {0: 6, 1: 5, 2: 7}
    assert sm.names({0: 10, 1: 9, 2: 8, 3: 2}, {0: ["a"], 1: ["a", "b"], 2: ["a"]}, {}, {3: "head"}) == {0: "a", 1: "a · b", 2: "a (2)", 3: "head"}
    assert sm.stale(1000, 1050)
    assert not sm.stale(2000, 2060)
    few = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id int, embedding array<float>")
    assert {r["cluster"] for r in sm.clustered(few).collect()} == {0}


def test_projection_keeps_most_variance(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 8)) + 5
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(data)], "vec_id int, embedding array<float>")
    got = np.array([r["coords"] for r in sm.projected(rows, 2).collect()])
    assert got.var(axis=0).sum() == pytest.approx(data.var(axis=0).sum(), rel=1e-3)
    assert abs(got.mean()) < 1e-2


def test_turn_stream(spark, tmp_path):
    schema = "file string, offset long, session_id string, timestamp string, starts boolean, question string, answer string"
    part = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    part([("f", 0, "s", "t", True, " q0 ", None), ("f", 1, "s", "t", False, None, "a"), ("f", 2, "s", "t", False, None, "b"), ("f", 3, "s", "t", True, "q3", None)], "n=1")

    def run():
        stream = spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = keep_latest(stream_turns(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"), lambda old, new: old.join(new, "id", "left_anti").unionByName(new))
        query.awaitTermination(120)

    run()
    part([("f", 4, "s", "t", False, None, "late"), ("f", 5, "s", "t", True, "q5", None), ("g", 0, "s2", "t", False, None, "orphan")], "n=2")
    run()
    versions = sorted(int(p.name) for p in (tmp_path / "out").iterdir() if p.name.isdigit())
    rows = spark.read.parquet(str(tmp_path / "out" / str(versions[-1]))).collect()
    assert {(r["id"], r["question"], r["answer"]) for r in rows} >= {("s:0", "q0", "a\nb"), ("s:3", "q3", "late")}


def test_folder_items_come_and_go(spark):
    items = spark.createDataFrame([(1, "turn", "a", None, 4.0, 1.0)], "folder_id long, kind string, ref string, alias string, position double, at double")
    new = spark.createDataFrame([(1, "turn", "a", 0), (1, "turn", "c", 2), (1, "turn", "b", 1), (2, "session", "s", 0)], "folder_id long, kind string, ref string, place int")
    more = fo.added(items, new, 9.0)
    assert {(r["folder_id"], r["ref"]): r["position"] for r in more.collect()} == {(1, "a"): 4.0, (1, "b"): 5.0, (1, "c"): 6.0, (2, "s"): 0.0}
    left, tombs = fo.removed(more, new.where("ref = 'b'").drop("place"), 10.0)
    assert (left.count(), tombs.first()["removed_at"]) == (3, 10.0)
    names = spark.createDataFrame([(1, "turn", "a", "mine")], "folder_id long, kind string, ref string, new_alias string")
    assert {r["ref"]: r["alias"] for r in fo.aliased(left, names).collect()}["a"] == "mine"


def test_folding_clocks(spark):
    turns = spark.createDataFrame([("t1", "s", None), ("t2", "x", "/logs/s/subagents/agent-1.jsonl"), ("t3", "y", None)], "id string, session_id string, source_file string")
    hidden = merge.hide_scope(turns, "s", 5.0)
    assert {r["turn_id"] for r in hidden.collect()} == {"t1", "t2"}
    none = spark.createDataFrame([], "turn_id string, at double")
    left, back = merge.unhidden(hidden, none, turns, "s", 7.0)
    assert (left.count(), back.count()) == (0, 2)
    again = spark.createDataFrame([("t1", 8.0), ("t2", 6.0)], "turn_id string, hidden_at double")
    assert [r["turn_id"] for r in merge.folded_state(again, back).collect()] == ["t1"]


def test_mirror_grows_and_restores(spark):
    from convoweave.sources import mirror

    files = lambda *rows: spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")
    none = spark.createDataFrame([], "path string, mirrored long, generation int")
    one = mirror.new_parts(files(("a", b"12345"), ("a.sync-conflict-20260101-010101-X", b"1")), none)
    two = mirror.new_parts(files(("a", b"1234567")), mirror.cursors_of(one))
    assert [(r["start"], r["end"], bytes(r["bytes"])) for r in two.collect()] == [(5, 7, b"67")]
    both = one.union(two)
    assert [(r["path"], bytes(r["content"]), r["intact"]) for r in mirror.restored(both).collect()] == [("a", b"1234567", True)]
    assert not mirror.restored(two).first()["intact"]
    shrunk = mirror.new_parts(files(("a", b"xy")), mirror.cursors_of(both))
    assert bytes(mirror.restored(both.union(shrunk)).first()["content"]) == b"xy"
    assert mirror.restored(both, files(("a", b""))).count() == 0


def test_live_tails_and_unknown_files(spark):
    from convoweave.streaming import incremental as inc

    files = spark.createDataFrame([("a", 100, bytearray(b"x" * 100)), ("b", 50, bytearray(b"y" * 50))], "path string, length long, content binary")
    cursors = spark.createDataFrame([("a", 20, 10)], "path string, offset long, hold_offset long")
    assert {(r["path"], r["start"], r["skipped"]) for r in inc.live_tail(files, cursors, 40).collect()} == {("a", 60, 50), ("b", 10, 10)}
    assert [(r["path"], len(r["content"])) for r in inc.unindexed(files, cursors, 8).collect()] == [("b", 8)]


def test_quota_over_many_partitions(spark):
    files = spark.createDataFrame([(f"f{k:03}", k % 7 + 1, (k * 37) % 101) for k in range(100)], "path string, size long, modified long").repartition(7)
    rows = sorted(files.collect(), key=lambda r: (r["modified"], r["path"]), reverse=True)
    want, total = set(), 0
    for r in rows:
        total += r["size"]
        want |= {r["path"]} if total > 150 else set()
    assert {r["path"] for r in archive_io.quota_victims(files, 150).collect()} == want


def test_nearest_of_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"v{k}", [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(300)] + [("null", None), ("hole", [1.0, None, 0.0, 0.0]), ("short", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "chunk_key string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{k}", rows[k][1]) for k in range(0, 300, 20)] + [("two", [0.5, 1.0])], "query string, embedding array<float>")
    usable = [(k, e) for k, e in rows if e is not None and None not in e]
    want = {}
    for q, asked in queries.collect():
        scored = sorted((-sum(a * b for a, b in zip(asked, e, strict=True)), k) for k, e in usable if len(e) == len(asked))
        want[q] = [(k, -s) for s, k in scored[:7]]
    for limit in (search.BROADCAST_BYTES, 0):  # blocks that are broadcast, and blocks that are dealt
        monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
        got = {}
        for r in search.nearest_each(vectors, queries, 7).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["key"], r["score"]))
        assert got == want
    assert search.nearest_each(vectors.limit(0), queries, 7).count() == 0
    assert search.nearest_each(vectors, queries.limit(0), 7).count() == 0
