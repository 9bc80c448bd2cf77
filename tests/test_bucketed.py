"""Bucketed tables, and imports that rewrite what they touch."""

import json

from pyspark.sql import functions as F

from convoweave.archive import Archive
from convoweave.sources.bucketed import Bucketed
from test_transcripts import assistant, user, write


def test_a_change_rewrites_its_buckets_alone(spark, tmp_path):
    table = Bucketed(spark, str(tmp_path / "t"), "id string, n int", F.col("id"), 16)
    assert table.read().count() == 0
    rows = spark.createDataFrame([(f"s{k}:{j}", k) for k in range(40) for j in range(3)], "id string, n int")
    table.put(rows)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    before = table._listed()
    new = spark.createDataFrame([("s7:0", -1)], "id string, n int")
    touched = table.touched(new)
    assert len(touched) == 1
    table.put(table.read(touched).where("id <> 's7:0'").unionByName(new), touched)
    after = table._listed()
    assert {b for b in after if after[b] != before[b]} == set(touched)
    assert table.read().count() == 120 and table.read().where("n = -1").count() == 1
    table.put(table.read(touched).limit(0), touched)  # an emptied bucket
    assert touched[0] not in table._listed()
    assert table.read().join(rows, "id", "left_anti").count() == 0 and 0 < table.read().count() < 120


def test_an_import_touches_its_sessions_and_takes_chunks_and_summaries(spark, tmp_path):
    logs = tmp_path / "logs"
    for k in range(30):
        write(logs / f"s{k}.jsonl", [user(f"question number {k} about things", "u", sessionId=f"s{k}"), assistant({"type": "text", "text": f"a long enough answer {k}"}, sessionId=f"s{k}")])
    a, b = Archive(spark, str(tmp_path / "a")), Archive(spark, str(tmp_path / "b"))
    assert a.index(str(logs), "claude-code", now=2e9) == b.index(str(logs), "claude-code", now=2e9) == 30
    turn = lambda i, q, summary: [i, i.split(":")[0], "u", None, "2026-01-01T00:00:00Z", "/work", q, "an answer that is longer than what is there", "[]", "claude-code", None, None, 1, summary, None]
    snapshot = tmp_path / "snap"
    snapshot.mkdir()
    lines = [{"t": turn("s3:u", "question number 3 about things", "third"), "c": [[0, "a chunk of the peer"], [1, "and its second"]]}, {"t": [*turn("s5:u", "q", "fifth")[:7], "short", *turn("s5:u", "q", "fifth")[8:]], "c": [[0, "not taken"]]}]
    from convoweave.sources import archive_io

    order = archive_io.TURN_CELLS
    names = ["id", "session_id", "uuid", "parent_uuid", "timestamp", "project", "question", "answer", "actions", "source", "source_file", "queued", "parser_version", "summary", "tags"]
    for line in lines:
        line["t"] = [dict(zip(names, line["t"], strict=True)).get(c) for c in order]
    (snapshot / "part.txt").write_text("".join(json.dumps(x) + "\n" for x in lines))
    before = {n: t._listed() for n, t in b.buckets.items()}
    assert b.import_from(str(snapshot)) == 1
    for name, table in b.buckets.items():
        changed = {k for k in table._listed() if table._listed()[k] != before[name].get(k)}
        assert 1 <= len(changed) <= 2 < len(before[name]), name
    got = {r["id"]: r for r in b.table("turns").collect()}
    assert len(got) == 30 and got["s3:u"]["answer"].startswith("an answer that") and got["s3:u"]["summary"] == "third"
    assert got["s5:u"]["summary"] == "fifth" and got["s5:u"]["answer"] == "a long enough answer 5"  # its own answer ranks higher
    assert [r["text"] for r in b.table("chunks").where("turn_id = 's3:u'").orderBy("idx").collect()] == ["a chunk of the peer", "and its second"]
    assert b.table("vectors").where("chunk_key LIKE 's3:u#%'").count() == 2
    assert b.table("vectors").count() == 31
    assert b.import_from(str(snapshot)) == 0
    assert b.search("longer than what", mode="keyword").first()["id"] == "s3:u"
