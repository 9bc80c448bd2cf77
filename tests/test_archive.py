"""An archive from its logs to its answers, and between two devices."""

import json

from pyspark.sql import functions as F
from test_transcripts import CHAT, assistant, user, write

from convoweave.__main__ import main
from convoweave.archive import Archive
from convoweave.sources import transcripts as tr


def test_life_of_an_archive(spark, tmp_path, capsys):
    logs = tmp_path / "logs"
    write(logs / "s1.jsonl", CHAT)
    write(logs / "s2.jsonl", [user("how do I bake sourdough bread", "b1", sessionId="s2"), assistant({"type": "text", "text": "flour, water, salt and a starter"}, sessionId="s2")])
    a = Archive(spark, str(tmp_path / "a"))
    assert a.index(str(logs), "claude-code", now=2e9) == 4
    assert a.index(str(logs), "claude-code", now=2e9) == 0
    assert tuple(a.stats().first()) == (4, 2, 0, 3, 3)  # one turn is too short for a vector
    assert {r["id"] for r in a.table("turns").where("queued").collect()} == {"s1:q1"}
    hits = a.search("sourdough starter").collect()
    assert hits[0]["id"] == "s2:b1"
    assert hits[0]["found_by"] == "keyword,semantic"
    assert hits[0]["thread"] == ["s2:b1"]
    assert a.search("sourdough", session="s1", mode="keyword").count() == 0
    assert all(r["id"] != "s2:b1" for r in a.related("s2:b1").collect())
    assert [r["session_id"] for r in a.recent().collect()] == ["s1", "s2"]

    with open(logs / "s2.jsonl", "ab") as f:
        f.write(json.dumps(assistant({"type": "text", "text": "and patience"}, sessionId="s2")).encode() + b"\n")
    assert a.index(str(logs), "claude-code", now=2e9) == 1
    assert a.session("s2").first()["answer"] == "flour, water, salt and a starter and patience"

    a.hide("s2", 5.0)
    assert all(r["id"] != "s2:b1" for r in a.search("sourdough starter").collect())
    a.unhide("s2", 5.5)
    assert a.search("sourdough starter").first()["id"] == "s2:b1"
    assert [tuple(r) for r in a.table("unfolded").collect()] == [("s2:b1", 5.5)]
    a.hide("s2", 6.0)
    a.title("s1", "First", 6.0)
    assert {r["session_id"]: (r["headline"], r["hidden_count"]) for r in a.sessions().collect()} == {"s1": ("First", 0), "s2": ("how do I bake sourdough bread", 1)}
    assert a.markdown().count() == 1

    a.export(str(tmp_path / "snap"))
    b = Archive(spark, str(tmp_path / "b"))
    assert b.import_from(str(tmp_path / "snap")) == 4
    assert b.import_from(str(tmp_path / "snap")) == 0
    with open(logs / "s1.jsonl", "ab") as f:  # the peer's longer answer, of the same version, is taken
        f.write(json.dumps(assistant({"type": "text", "text": "and much more to say"}, sessionId="s1")).encode() + b"\n")
    if a.index(str(logs), "claude-code", now=3e9):
        a.export(str(tmp_path / "later"))
        assert b.import_from(str(tmp_path / "later")) == 1
    b.delete(["s2:b1"])
    assert b.search("sourdough", mode="keyword").count() == 0
    assert b.reconcile() == 0
    main([str(tmp_path / "a"), "stats"])
    assert "turns" in capsys.readouterr().out


def test_settings_between_devices(spark, tmp_path):
    a, b = (Archive(spark, str(tmp_path / name)) for name in "ab")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    from convoweave.archive import TABLES

    a.save("titles", frame([("s1", "mine", 5.0), ("s2", "far", 1e9)], TABLES["titles"]))
    a.save("hidden", frame([("t1", 5.0), ("t2", 5.0)], TABLES["hidden"]))
    a.save("unfolded", frame([("t3", 9.0)], TABLES["unfolded"]))
    a.save("folders", frame([(1, "top", None, 0.0, "u1", 5.0), (2, "sub", 1, None, "u2", 5.0), (3, "gone there", 1, None, "u3", 5.0), (4, "own", None, None, None, None)], TABLES["folders"]))
    a.save("items", frame([(2, "turn", "t1", "alias", 0.0, 5.0), (2, "turn", "t2", None, 1.0, 5.0), (4, "turn", "t9", None, 0.0, 5.0)], TABLES["items"]))
    b.save("titles", frame([("s1", "theirs", 7.0)], TABLES["titles"]))
    b.save("hidden", frame([("t3", 3.0), ("t4", 1.0)], TABLES["hidden"]))
    b.save("folders", frame([(1, "other", None, 0.0, "u9", 1.0), (7, "older", None, 0.0, "u1", 2.0)], TABLES["folders"]))
    b.save("folders_gone", frame([("u3", 6.0)], TABLES["folders_gone"]))
    b.save("items_gone", frame([("u2", "turn", "t2", 6.0)], TABLES["items_gone"]))
    a.export(str(tmp_path / "snap"))
    assert b.import_from(str(tmp_path / "snap"), now=10.0) == 0
    assert {(r["session_id"], r["title"]) for r in b.table("titles").collect()} == {("s1", "theirs")}  # the clock of s2 is ahead
    assert {(r["turn_id"], r["hidden_at"]) for r in b.table("hidden").collect()} == {("t1", 5.0), ("t2", 5.0), ("t4", 1.0)}
    assert [tuple(r) for r in b.table("unfolded").collect()] == [("t3", 9.0)]
    folders = {r["uid"]: r for r in b.table("folders").collect()}
    assert {u: (r["name"], r["parent_id"]) for u, r in folders.items()} == {"u9": ("other", None), "u1": ("top", None), "u2": ("sub", 7)}
    assert (folders["u1"]["id"], folders["u2"]["id"]) == (7, 8)
    assert [(r["folder_id"], r["ref"], r["alias"]) for r in b.table("items").collect()] == [(8, "t1", "alias")]
    before = {n: sorted(map(tuple, b.table(n).collect()), key=repr) for n in ("titles", "hidden", "folders", "items")}
    b.import_from(str(tmp_path / "snap"), now=10.0)
    assert before == {n: sorted(map(tuple, b.table(n).collect()), key=repr) for n in before}


def test_a_broken_file_stops_nothing_and_is_tried_when_it_changes(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    for k in range(3):
        write(logs / f"s{k}.jsonl", [user(f"question number {k} about things", "u", sessionId=f"s{k}"), assistant({"type": "text", "text": f"a long enough answer {k}"}, sessionId=f"s{k}")])
    (logs / "s1.jsonl").chmod(0o644)
    target = logs / "s1.jsonl"
    data = target.read_bytes()
    a = Archive(spark, str(tmp_path / "a"))
    real = tr.files

    def listed(session, root, pattern="*.jsonl"):  # a file that is gone when the tasks come to it
        found = real(session, root, pattern)
        return found.withColumn("path", F.when(F.col("path").endswith("s1.jsonl"), F.concat("path", F.lit(".gone"))).otherwise(F.col("path")))

    monkeypatch.setattr(tr, "files", listed)
    assert a.index(str(logs), "claude-code", now=2e9) == 2
    row = a.table("quarantine").first()
    assert row["path"].endswith("s1.jsonl.gone") and row["tries"] == 1 and "FileNotFoundError" in row["cause"]
    assert a.index(str(logs), "claude-code", now=2e9) == 0  # unchanged: not tried again
    assert a.table("quarantine").first()["tries"] == 1
    target.write_bytes(data + data[:0] + b"{}\n")
    assert a.index(str(logs), "claude-code", now=2e9) == 0
    assert a.table("quarantine").first()["tries"] == 2
    (logs / "s1.jsonl.gone").write_bytes(data)  # it can be read now
    target.write_bytes(data + b"{}\n{}\n")
    assert a.index(str(logs), "claude-code", now=2e9) == 1
    assert a.table("quarantine").count() == 0 and a.table("turns").count() == 3


def test_folders_are_made_and_moved(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    one, two = a.create_folder("one", at=1.0), a.create_folder("two", at=1.0)
    sub, other = a.create_folder("sub", one, at=1.0), a.create_folder("other", two, at=1.0)
    assert not a.move_folder(one, sub) and not a.move_folder(one, one)
    assert a.move_folder(sub, two, before=other, at=2.0)
    rows = {r["name"]: r for r in a.table("folders").collect()}
    assert (rows["sub"]["parent_id"], rows["sub"]["position"], rows["other"]["position"], rows["other"]["at"]) == (two, 1.0, 2.0, 2.0)
    assert rows["one"]["at"] == 1.0 and len({r["uid"] for r in rows.values()}) == 4
    assert a.move_folder(other, None, at=3.0)
    assert {r["name"]: r["position"] for r in a.table("folders").where("parent_id IS NULL").collect()} == {"one": 1.0, "two": 2.0, "other": 3.0}


def test_related_to_the_example_of_a_session(spark, tmp_path):
    logs = tmp_path / "logs"
    for k, topic in enumerate(("sourdough bread with a starter", "sourdough bread and rye", "spark joins and shuffles")):
        write(logs / f"s{k}.jsonl", [user(f"tell me about {topic}", "u", sessionId=f"s{k}"), assistant({"type": "text", "text": f"{topic}, explained"}, sessionId=f"s{k}")])
    a = Archive(spark, str(tmp_path / "a"))
    a.index(str(logs), "claude-code", now=2e9)
    found = [r["id"] for r in a.related("s0").collect()]
    assert found[0] == "s1:u" and "s0:u" not in found
    assert a.related("nothing").count() == 0


def test_the_map_leaves_hidden_turns_out_and_keeps_its_clusters(spark, tmp_path):
    logs = tmp_path / "logs"
    for k in range(24):
        topic = ("sourdough bread starter flour", "spark shuffle join partition", "garden tomato seeds water")[k % 3]
        write(logs / f"s{k}.jsonl", [user(f"{topic} question {k}", "u", sessionId=f"s{k}"), assistant({"type": "text", "text": f"{topic} answer"}, sessionId=f"s{k}")])
    a = Archive(spark, str(tmp_path / "a"))
    a.index(str(logs), "claude-code", now=2e9)
    a.hide("s0", 1.0)
    assert a.build_map() and not a.build_map()
    points = a.table("points").collect()
    assert len(points) == 23 and "s0:u" not in {r["turn_id"] for r in points} and all(len(r["coords"]) == 2 for r in points)
    clusters = {r["cluster"]: r for r in a.table("clusters").collect()}
    assert sum(r["points"] for r in clusters.values()) == 23 and len({r["name"] for r in clusters.values()}) == len(clusters) == 3
    before = {r["chunk_key"]: r["cluster"] for r in points}
    assert a.build_map(marked=True)
    assert {r["chunk_key"]: r["cluster"] for r in a.table("points").collect()} == before
    mine = a.in_cluster("sourdough starter", before["s3:u#0"]).collect()
    assert mine and {before[f"{r['id']}#0"] for r in mine} == {before["s3:u#0"]}
    empty = Archive(spark, str(tmp_path / "b"))
    assert empty.build_map() and empty.table("points").count() == empty.table("clusters").count() == 0
