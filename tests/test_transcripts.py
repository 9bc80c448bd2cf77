"""The three adapters on small files with the odd cases: corrupt and unfinished lines, plumbing, queued prompts, both generations."""

import json

from pyspark.sql import functions as F

from convoweave.operators import quality
from convoweave.sources import transcripts as tr
from convoweave.streaming import incremental as inc


def user(text, uuid, **more):
    return {"type": "user", "uuid": uuid, "sessionId": "s1", "cwd": "/work", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": text}, **more}


def assistant(*blocks, **more):
    return {"type": "assistant", "sessionId": "s1", "message": {"role": "assistant", "content": list(blocks)}, **more}


CHAT = [
    {"type": "mode", "sessionId": "s1"},
    assistant({"type": "text", "text": "an orphan"}),
    user("first\r question ", "u1"),
    assistant({"type": "thinking", "thinking": " plan "}, {"type": "text", "text": "answer one"}, {"type": "tool_use", "name": "Edit", "input": {"x": 1, "file_path": "/a/b\nc"}}),
    user([{"type": "tool_result", "content": "ok"}], "r1"),
    user("<command-name>/x", "p1"),
    user("\u00a0\u2003<command-name>/y", "p2"),
    assistant({"type": "text", "text": "answer two"}, {"type": "tool_use", "name": "Odd", "input": {"k": 1, "l": 2}}),
    {"type": "attachment", "uuid": "q1", "sessionId": "s1", "timestamp": "2026-01-01T00:01:00Z", "attachment": {"type": "queued_command", "prompt": "[{'type': 'text', 'text': 'queued'}]", "origin": {"kind": "human"}}},
    assistant({"type": "text", "text": "to the queued"}),
    {"type": "attachment", "uuid": "q2", "sessionId": "s1", "attachment": {"type": "queued_command", "prompt": "no person", "origin": {"kind": "task"}}},
    user("by a script", "a1", promptSource="sdk"),
    user("meta", "m1", isMeta=True),
    user([{"type": "text", "text": "two"}, {"type": "text", "text": "blocks"}], "u2"),
    assistant({"type": "text", "text": "side"}, isSidechain=True),
]


def write(path, records, tail=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(json.dumps(r, ensure_ascii=False).encode() + b"\n" if not isinstance(r, bytes) else r for r in records) + tail)


def found(turns):
    return [(r["id"], r["question"], r["answer"], [tuple(a) for a in r["actions"]]) for r in turns.orderBy("offset").collect()]


def test_lines_are_complete_and_know_their_bytes(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"k": "é"}, b"\n", b"{broken\n", b'{"bad":"\xff"}\n'], tail=b'{"k": "unfinished"}')
    write(tmp_path / ".x-archive" / "b.jsonl", [{"k": 1}])
    write(tmp_path / "of" / "-home-me-photo-archive" / "b.jsonl", [{"k": 1}])
    files = tr.files(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 2)[-2] for r in files.where("path LIKE '%b.jsonl'").collect()) == ["-home-me-photo-archive"]
    read = tr.lines(files.where("path LIKE '%a.jsonl'"))
    rows = [(r["offset"], r["end_offset"], r["line"]) for r in read.orderBy("offset").collect()]
    assert rows == [(0, 12, '{"k": "é"}'), (13, 21, "{broken"), (21, 33, '{"bad":"�"}')]
    assert [(r["bad_lines"], r["first_offset"]) for r in quality.corrupt(read).collect()] == [(1, 21)]
    assert tr.sound(read).count() == 2


def test_chat_turns(spark, tmp_path):
    write(tmp_path / "s1.jsonl", CHAT)
    read = tr.sound(tr.lines(tr.files(spark, str(tmp_path))))
    got = found(tr.turns(tr.chat_records(read), "claude-code"))
    assert got == [
        ("s1:u1", "first\r question", "plan\nanswer one\nanswer two", [("Edit", "/a/b c"), ("Odd", "k, l")]),
        ("s1:q1", "queued", "to the queued", []),
        ("s1:u2", "two\nblocks", "", []),
    ]
    assert [x[0] for x in found(tr.turns(tr.chat_records(read, skip_automation=False), "claude-code"))] == ["s1:u1", "s1:q1", "s1:a1", "s1:u2"]
    assert tuple(tr.automation(read).first()) == (1, 1)


def test_sub_streams(spark, tmp_path):
    side = lambda text, uuid, **more: user(text, uuid, isSidechain=True, agentId="ag", **more)
    write(tmp_path / "p/subagents/agent-1.jsonl", [side("task", "u1"), assistant({"type": "text", "text": "done"}, isSidechain=True, agentId="ag"), side("<teammate-message id='x'>go on</teammate-message>", "u2", isMeta=True), side("more", "u3", isMeta=True)])
    write(tmp_path / "p/subagents/agent-2.jsonl", [side("task", "v1"), side("once", "v2", isMeta=True)])
    read = tr.with_follow_ups(tr.sound(tr.lines(tr.files(spark, str(tmp_path)))))
    assert found(tr.turns(tr.chat_records(read, sub_stream=True), "claude-code")) == [("ag:u1", "task", "done", []), ("ag:u2", "go on", "", []), ("ag:u3", "more", "", [])]


def event(kind, **payload):
    return {"timestamp": "2026-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": kind, **payload}}


def item(of, **more):
    return event("item_completed", item={"type": of, **more})


def test_rollouts_of_both_generations(spark, tmp_path):
    meta = {"type": "session_meta", "payload": {"id": "r1", "cwd": "/w"}}
    old = [meta, event("user_message", message=" ask "), {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": '{"command": "ls"}'}}, event("agent_message", message="said"),
           {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "patch", "input": "a\nb"}}, {"type": "response_item", "payload": {"type": "message"}}]
    new = [item("UserMessage", id="i1", content=[{"type": "text", "text": "new ask"}]), item("AgentMessage", content=[{"type": "Text", "text": "new said"}]), item("CommandExecution", parsed_cmd=[{"cmd": "pwd"}]),
           item("CommandExecution", command=["a", "b"]), item("Extension", kind="web", query="q"), event("agent_message", message="double"), item("Reasoning")]
    write(tmp_path / "rollout-1.jsonl", old + new)
    write(tmp_path / "rollout-x-0199aaaa-bbbb-cccc-dddd-eeeeffff0000.jsonl", [event("user_message", message="no meta")])
    write(tmp_path / "rollout-exec.jsonl", [{"type": "session_meta", "payload": {"id": "auto", "originator": "codex_exec"}}, event("user_message", message="auto")])
    read = tr.sound(tr.lines(tr.files(spark, str(tmp_path), "rollout-*.jsonl")))
    turns = tr.turns(tr.rollout_records(read), "codex")
    got = {x[1]: x for x in found(turns)}
    assert got["ask"][2:] == ("said", [("shell", "ls"), ("patch", "a b")])
    assert got["ask"][0].startswith("r1:@")
    assert got["new ask"] == ("r1:i1", "new ask", "new said", [("exec", "pwd"), ("exec", "a b"), ("web", "q")])
    assert got["no meta"][0].startswith("0199aaaa-bbbb-cccc-dddd-eeeeffff0000:@")
    assert "auto" not in got
    assert tr.turns(tr.rollout_records(read, skip_automation=False), "codex").count() == 4


def test_cursors_hold_the_open_turn(spark, tmp_path):
    write(tmp_path / "s1.jsonl", CHAT[2:4] + CHAT[8:10])
    none = spark.createDataFrame([], "path string, offset long, hold_offset long")
    listed = lambda age: tr.files(spark, str(tmp_path)).withColumn("age_seconds", F.lit(age))
    read = inc.read_new(spark, str(tmp_path), none)
    turns = tr.turns(tr.chat_records(tr.sound(read)), "claude-code")
    done, cursors = inc.advanced(listed(10), read, turns)
    assert [r["id"] for r in done.collect()] == ["s1:u1"]
    kept = spark.createDataFrame(cursors.collect(), cursors.schema)
    again = inc.read_new(spark, str(tmp_path), kept)
    assert [x[0] for x in found(tr.turns(tr.chat_records(tr.sound(again)), "claude-code"))] == ["s1:q1"]
    done, idle = inc.advanced(listed(500), read, turns)
    assert done.count() == 2
    idle = spark.createDataFrame(idle.collect(), idle.schema)
    assert not inc.has_new(tr.files(spark, str(tmp_path)), idle)
    with open(tmp_path / "s1.jsonl", "ab") as f:
        f.write(json.dumps(assistant({"type": "text", "text": "late"})).encode() + b"\n")
    late = inc.read_new(spark, str(tmp_path), idle)
    assert found(tr.turns(tr.chat_records(tr.sound(late)), "claude-code"))[0][2] == "to the queued\nlate"
    rotated = spark.createDataFrame([(idle.first()["path"], 10**9, None)], idle.schema)
    assert inc.read_new(spark, str(tmp_path), rotated).count() == 5
