"""Ranged reading against reading whole, and the stream over growing files: killed, restarted, rotated."""

import json
import random

import pytest
from pyspark.sql import functions as F

from convoweave.operators import turns as turn_ops
from convoweave.plans import ingest
from convoweave.session import settings
from convoweave.sources import ranged, transcripts as tr
from convoweave.streaming import log_source, turn_stream
from parity import assert_same


def junk(rng, n):
    pieces = [b"", b" ", b"\r", b"{}", b"x" * 40, "é한".encode(), b"\xff\xfe", b"y" * 300]
    return b"".join(b"".join(rng.choices(pieces, k=rng.randint(0, 3))) + b"\n" for _ in range(n)) + rng.choice([b"", b"open tail", b"t" * 500])


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_give_the_lines_of_the_whole_file(tmp_path, size, monkeypatch):
    monkeypatch.setattr(ranged, "READ", 32)
    for seed in range(6):
        data = junk(random.Random(seed), 30)
        path = tmp_path / "a b.jsonl"
        path.write_bytes(data)
        want, at = [], 0
        for raw in data.split(b"\n")[:-1]:
            if raw.strip():
                want.append((at, at + len(raw) + 1, raw.decode("utf-8", "replace")))
            at += len(raw) + 1
        start = data.index(b"\n") + 1 if seed % 2 else 0
        for uri in (str(path), path.as_uri()):
            got = [tuple(r.values())[1:] for k in range(start, len(data), size) for b in ranged.batches_of(uri, k, min(k + size, len(data)), k == start) for r in b.to_pylist()]
            assert got == [w for w in want if w[0] >= start]


def test_lines_equal_those_of_whole_files(spark, tmp_path):
    rng = random.Random(9)
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_bytes(junk(rng, 200))
    (tmp_path / "3.jsonl").write_bytes(b"")
    files = tr.files(spark, str(tmp_path))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ranged.lines(files, size=100)) == rows(tr.lines(files))
    cut = ranged.ranges(files, size=100)
    assert cut.count() > 20 and cut.agg(F.max(F.col("end") - F.col("begin"))).first()[0] == 100


def test_one_large_file_takes_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.jsonl", "wb") as f:
        for k in range(300):
            f.write(b"".join(b'{"k": %d, "pad": "%b"}\n' % (k * 1000 + j, b"p" * 80) for j in range(1000)))
    read = ranged.lines(tr.files(spark, str(tmp_path)).drop("content"), size=1 << 20)
    found = read.select(F.spark_partition_id().alias("p"), F.get_json_object("line", "$.k").cast("long").alias("k"))
    assert found.agg(F.count_distinct("k"), F.count("*")).first() == (300_000, 300_000)
    assert found.select("p").distinct().count() >= 4
    assert "content" not in read._jdf.queryExecution().executedPlan().toString()


def test_adapters_agree_with_sql(spark):
    assert assert_same(spark, ingest.ingest_logs, ingest.ORACLE_SQL["ingest_logs"])


def user(k, session):
    return json.dumps({"type": "user", "uuid": f"u{k}", "sessionId": session, "timestamp": f"{k:04}", "message": {"role": "user", "content": f"question {k}"}}) + "\n"


def answer(k, session):
    return json.dumps({"type": "assistant", "sessionId": session, "message": {"role": "assistant", "content": [{"type": "text", "text": f"answer {k}"}]}}) + "\n"


def test_a_killed_stream_gives_each_turn_once(spark, tmp_path):
    with settings(spark, spark__sql__streaming__noDataMicroBatches__enabled="false"):  # pending timeouts would make batches for ever
        killed_stream(spark, tmp_path)


def killed_stream(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    spark.dataSource.register(log_source.GrowingLogs)
    limit, fail = 2000, {"at": 2}

    def append(n, start):
        for s in range(3):
            with open(logs / f"s{s}.jsonl", "a") as f:
                for k in range(start, start + n):
                    f.write(user(k, f"s{s}") + answer(k, f"s{s}") + answer(k, f"s{s}"))

    def started():
        lines = spark.readStream.format("growing_logs").options(path=str(logs), progress=str(tmp_path / "notes"), maxBytesPerTrigger=limit, rangeBytes=300).load()
        turns = turn_stream.stream_turns(tr.chat_records(tr.sound(lines)), idle_ms=3_600_000)

        def write(batch, number):
            if number == fail["at"]:
                fail["at"] = -1
                raise RuntimeError("killed")
            batch.write.mode("overwrite").parquet(f"{out}/{number}")  # by number, so that a batch that runs again replaces itself

        return turns.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).start()

    append(30, 0)
    query = started()
    with pytest.raises(Exception, match="killed"):
        query.processAllAvailable()
    with open(logs / "s0.jsonl", "a") as f:
        f.write(user(99, "s0")[:20])  # a line that is still being written
    query = started()
    query.processAllAvailable()
    query.stop()
    with open(logs / "s0.jsonl", "a") as f:
        f.write(user(99, "s0")[20:])
    append(10, 30)
    query = started()
    query.processAllAvailable()
    sizes = [p["numInputRows"] for p in query.recentProgress]
    query.stop()
    found = spark.read.parquet(*(str(p) for p in out.iterdir())).where("closed")
    turns = [(r["session_id"], r["question"], r["answer"]) for r in found.collect()]
    files = tr.files(spark, str(logs))
    whole = turn_ops.with_resume_offsets(turn_ops.fold(tr.chat_records(tr.sound(tr.lines(files))))).where("resume_offset IS NOT NULL")
    want = [(r["session_id"], r["question"], r["answer"]) for r in whole.collect()]
    assert len(want) == 118 and sorted(turns) == sorted(want)
    assert len(list(out.iterdir())) > 5 and max(sizes) < 40  # batches stay bounded


def test_offsets_of_rotated_files_and_long_lines(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"x" * 500 + b"\nab\ncd")
    options = {"path": str(tmp_path), "progress": str(tmp_path / "n"), "maxBytesPerTrigger": "100", "rangeBytes": "64"}
    reader = log_source.LogReader(options)
    lines = lambda a, z: [r["line"] for p in reader.partitions(a, z) for b in reader.read(p) for r in b.to_pylist()]
    one = reader.latestOffset()
    assert one == {str(path): 501} and lines({}, one) == ["x" * 500]
    two = log_source.LogReader(options).latestOffset()  # a new reader goes on from what was planned
    assert two == {str(path): 504} and lines(one, two) == ["ab"]
    reader = log_source.LogReader(options)
    assert reader.latestOffset() == two and lines(two, two) == []
    path.write_bytes(b"new\n")
    assert reader.latestOffset() == {str(path): 4} and lines(two, {str(path): 4}) == ["new"]
