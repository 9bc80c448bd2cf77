"""An archive of conversations: versioned Parquet tables below one folder, and what a user asks of them.

Each change writes the next version of a table, which readers see once Spark has committed it. Turns, chunks and vectors lie in
buckets by session, of which a change rewrites those that it touches. Indexing reads only what is new in the logs, and
embeds only chunks whose input has changed. A change writes chunks, vectors and the keyword index before its turns, so one that
fails on the way is made again, from the same logs or snapshot.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoweave.functions.embedding import Embedder, embedded, hashed, query_vector
from convoweave.functions.ordering import running_sum
from convoweave.functions.text import embed_text, filled, keyword_text, source_or_default, worth_embedding
from convoweave.operators import chunking, folders, merge, search as finding, semantic_map, sessions, turns as turn_ops
from convoweave.operators.keyword_index import KeywordIndex
from convoweave.operators.turns import ACTIONS
from convoweave.session import cut, last_version
from convoweave.sources import archive_io, ranged, transcripts as tr
from convoweave.sources.bucketed import Bucketed
from convoweave.streaming import incremental

#: The tables and their columns; actions are JSON, as snapshots carry them.
TABLES = {
    "turns": "id string, session_id string, uuid string, parent_uuid string, timestamp string, project string, question string, answer string, actions string, source string, source_file string, queued boolean, parser_version int, summary string, tags array<string>",
    "chunks": "chunk_key string, turn_id string, idx int, text string",
    "vectors": "chunk_key string, embed_hash string, embedding array<float>",
    "points": "chunk_key string, turn_id string, coords array<double>, cluster int",
    "clusters": "cluster int, name string, points long, turns long, centroid array<double>",
    "quarantine": "path string, length long, modified timestamp, cause string, tries int",
    "cursors": "path string, offset long, hold_offset long",
    "hidden": "turn_id string, hidden_at double",
    "titles": "session_id string, title string, at double",
    "folders": "id long, name string, parent_id long, position double, uid string, at double",
    "unfolded": "turn_id string, at double",
    "folders_gone": "uid string, removed_at double",
    "items_gone": "folder_uid string, kind string, ref string, removed_at double",
    "items": "folder_id long, kind string, ref string, alias string, position double, at double",
}
#: Adapters: file pattern, the source that is stored, and how records are read.
ADAPTERS = {
    "claude-code": ("*.jsonl", "claude-code", tr.chat_records),
    "codex": ("rollout-*.jsonl", "codex", tr.rollout_records),
    "subagent": ("agent-*.jsonl", "claude-code", lambda read, **k: tr.chat_records(tr.with_follow_ups(read), sub_stream=True, **k)),
}
PARSER_VERSION = 1
SUBAGENTS = r"/subagents/[^/]*$"


class Archive:
    """The archive in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder = hashed):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder
        owners = {"turns": F.col("id"), "chunks": F.col("turn_id"), "vectors": F.regexp_replace("chunk_key", "#[^#]*$", "")}
        self.buckets = {name: Bucketed(spark, f"{self.path}/{name}", TABLES[name], key) for name, key in owners.items()}
        self.keyword = KeywordIndex(spark, f"{self.path}/keyword")

    def _version(self, name: str) -> int:
        return last_version(self.spark, f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        if name in self.buckets:
            return self.buckets[name].read()
        n = self._version(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/version={n}") if n else self.spark.createDataFrame([], TABLES[name])

    def save(self, name: str, rows: DataFrame) -> None:
        if name in self.buckets:
            self.buckets[name].put(rows)
            return
        columns = [f.split()[0] for f in TABLES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/version={self._version(name) + 1}")

    # Indexing

    def index(self, root: str, adapter: str, now: float | None = None, idle: int = incremental.IDLE, skip_automation: bool = True) -> int:
        """Reads what is new below `root`; the number of turns that came in."""
        pattern, source, read_records = ADAPTERS[adapter]
        now = time.time() if now is None else now
        files = tr.files(self.spark, root, pattern).withColumn("age_seconds", F.lit(now) - F.col("modified").cast("double"))
        sub = F.col("path").rlike(SUBAGENTS)
        files = files.where(sub if adapter == "subagent" else ~sub)
        cursors = self.table("cursors")
        quarantine = self.table("quarantine")
        new = incremental.changed(files, cursors).join(quarantine.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
        if ranged.readable(root):
            read = cut(ranged.lines(new, F.col("start"), failures=True))
            read = self.isolated(new, read, quarantine)
        else:
            read = cut(tr.lines(new, F.col("start")))
        found = cut(tr.turns(read_records(tr.sound(read), skip_automation=skip_automation), source))
        done, moved = incremental.advanced(new, read, found, idle)
        done = done.withColumn("actions", F.to_json("actions")).withColumn("parser_version", F.lit(PARSER_VERSION)).withColumn("arrival", F.col("offset"))
        fresh = merge.latest(done.select("id", "session_id", "uuid", "parent_uuid", "timestamp", "project", "question", "answer", "actions", "source", "source_file", "queued", "parser_version", "arrival"))
        fresh = cut(fresh.withColumn("summary", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("array<string>")))
        n = self.take_in(fresh)
        moved = cut(moved)
        self.save("cursors", cursors.join(moved, "path", "left_anti").unionByName(moved))
        return n

    def isolated(self, files: DataFrame, read: DataFrame, quarantine: DataFrame) -> DataFrame:
        """`read` without the files that could not be read whole. These go into quarantine, with the cause, until they change; their
        cursors stay, so nothing of them is lost. A file that has been read leaves it."""
        broken = cut(read.where("error IS NOT NULL").groupBy(F.col("file").alias("path")).agg(F.min("error").alias("cause")))
        n, before = broken.count(), quarantine.count()
        if n or before:
            now = files.select("path", "length", "modified").join(broken, "path").join(quarantine.select("path", "tries"), "path", "left")
            now = now.select("path", "length", "modified", "cause", (F.coalesce("tries", F.lit(0)) + 1).cast("int").alias("tries"))
            self.save("quarantine", cut(quarantine.join(files.select("path"), "path", "left_anti").select(*now.columns).unionByName(now)))
        return read.drop("error").join(broken.select(F.col("path").alias("file")), "file", "left_anti") if n else read.drop("error")

    def take_in(self, fresh: DataFrame, strict: bool = False, given: DataFrame | None = None) -> int:
        """Upserts turns, and makes their chunks and vectors; the number of turns that came in.

        given: chunks (turn_id, idx, text) that come with the turns; turns without any are cut here. Turns that stay take the
        summary and tags of a fresh one where they have no summary.
        """
        tables = self.buckets
        touched = tables["turns"].touched(fresh)
        merged = merge.upsert(tables["turns"].read(touched), fresh, strict)
        about = fresh.select(F.col("id"), filled(F.col("summary")).alias("_summary"), F.col("tags").alias("_tags"))
        told = F.col("_summary").isNotNull() & filled(F.col("summary")).isNull()
        merged = merged.join(about, "id", "left").withColumn("told", F.coalesce(told, F.lit(False)))
        merged = merged.withColumn("tags", F.when(F.col("told"), F.col("_tags")).otherwise(F.col("tags"))).withColumn("summary", F.when(F.col("told"), F.col("_summary")).otherwise(F.col("summary")))
        merged = cut(merged.drop("_summary", "_tags"))
        changed = merged.where("outcome IN ('inserted', 'replaced')")
        touched = tables["turns"].touched(merged.where("told OR outcome IN ('inserted', 'replaced')"))
        if not touched:
            return 0
        n, turns = changed.count(), merged.drop("outcome", "told").where(tables["turns"].bucket.isin(*touched))
        if n:
            acts = F.from_json("actions", ACTIONS)
            worth = changed.where(worth_embedding(F.col("question"), F.col("answer"), acts))
            old = tables["chunks"].read(touched)
            fresh_chunks = [chunking.chunks(worth.select("id", embed_text(F.col("question"), F.col("answer"), acts).alias("embed_text")), limit=None)]
            if given is not None:
                mine = given.join(changed.select(F.col("id").alias("turn_id")), "turn_id", "left_semi")
                fresh_chunks = [fresh_chunks[0].join(mine.select("turn_id").distinct(), "turn_id", "left_anti"), mine.withColumn("chunk_key", F.concat("turn_id", F.lit("#"), "idx"))]
            chunks = merge.stale_chunks(old, changed).select(*old.columns)
            for rows in fresh_chunks:
                chunks = chunks.unionByName(rows.select(*old.columns))
            chunks = cut(chunks)
            tables["chunks"].put(chunks, touched)
            self.embed(turns, chunks, touched)
            self.keyword.put(changed.select("id", keyword_text(F.col("question"), F.col("answer"), acts).alias("text")))
        tables["turns"].put(turns, touched)
        return n

    def embed(self, turns: DataFrame, chunks: DataFrame, touched: Sequence[int]) -> None:
        """Vectors for the chunks of some buckets whose input has changed; those of chunks that are gone go."""
        old = self.buckets["vectors"].read(touched)
        stored = old.select("chunk_key", F.col("embed_hash").alias("old_hash"), F.lit(None).cast("string").alias("old_input"), F.lit(True).alias("has_vector"))
        todo = cut(turn_ops.to_embed(turn_ops.embed_inputs(chunks, turns), stored))
        made = todo.where("again").select("chunk_key", "embed_hash", embedded(F.col("input"), self.embedder).alias("embedding"))
        kept = old.join(todo.where("NOT again").select("chunk_key"), "chunk_key", "left_semi")
        self.buckets["vectors"].put(cut(kept.unionByName(made)), touched)

    # Questions

    def _searchable(self) -> DataFrame:
        acts = F.from_json("actions", ACTIONS)
        return self.table("turns").withColumn("text", keyword_text(F.col("question"), F.col("answer"), acts))

    def search(self, query: str, k: int = 5, mode: str = "hybrid", session: str | None = None, since: str | None = None, until: str | None = None, sources: Sequence[str] = (), folder: int | None = None, window: int = 2) -> DataFrame:
        """The k best turns (at most 20), with score, sources and the ids around them."""
        turns = self._searchable()
        allowed = None if folder is None else folders.turns_in(self.table("folders"), self.table("items"), turns, folder)
        hidden = self.table("hidden").select(F.col("turn_id").alias("id"))
        hits = finding.search(
            turns, self.table("vectors"), query, query_vector(query, self.embedder), max(1, min(20, k)), mode, index=self.keyword, hidden=hidden, allowed=allowed, sources=sources, session=session, since=since,
            until=until,
        )
        around = turn_ops.with_thread(turns.join(F.broadcast(hits.join(turns.select("id", "session_id"), "id").select("session_id").distinct()), "session_id", "left_semi"), window)
        told = around.select("id", "session_id", "timestamp", "project", "question", "answer", source_or_default(F.col("source")).alias("source"), "summary", "tags", "thread")
        return F.broadcast(hits.withColumnRenamed("sources", "found_by")).join(told, "id").orderBy("place")

    def related(self, target: str, k: int = 5) -> DataFrame:
        """Turns of other sessions that are like a turn, or like the first turns of the session whose id begins with `target`."""
        turns = self._searchable()
        row = turns.where(F.col("id") == target).select("session_id", F.concat_ws("\n", "question", "answer").alias("q")).first()
        if row is None:
            some = turns.where(F.startswith("session_id", F.lit(target)))
            row = finding.example_texts(some).orderBy("session_id").withColumnRenamed("example", "q").first()
        if row is None or not row["q"]:
            return turns.select("id").limit(0)
        hits = finding.search(turns, self.table("vectors"), row["q"], query_vector(row["q"], self.embedder), 4 * k, index=self.keyword)
        return finding.related(hits, turns, row["session_id"], k)

    # The map

    def build_map(self, marked: bool = False) -> bool:
        """Makes the map of all vectors of turns that are not hidden: points with two coordinates and a cluster, and clusters with a
        name; whether that was due (marked, or the vectors have changed enough). Clusters keep the ids of those they succeed."""
        old = self.table("points")
        vectors = cut(semantic_map.visible(self.table("vectors"), self.table("hidden")).select("chunk_key", "turn_id", "embedding"))
        now, then = vectors.count(), old.count()
        if not semantic_map.stale(then, now, marked or not then):
            return False
        if now > 1:
            coords = semantic_map.projected(vectors).select("chunk_key", "coords")
        else:
            coords = vectors.select("chunk_key", F.array(F.lit(0.0), F.lit(0.0)).alias("coords"))
        points = cut(semantic_map.clustered(vectors).select("chunk_key", "turn_id", "cluster").join(coords, "chunk_key"))
        key = F.col("chunk_key").alias("key")
        ids = semantic_map.succession(points.select("cluster", key), old.select("cluster", key))
        if ids:
            renamed = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
            points = cut(points.withColumn("cluster", renamed[F.col("cluster")].cast("int")))
        self.save("points", points)
        self.save("clusters", cut(self._named(points)))
        return True

    def _named(self, points: DataFrame) -> DataFrame:
        """The clusters of `points`, tens of them, with names from their turns' tags, else from the turn in their middle."""
        turns = self.table("turns").select(F.col("id").alias("turn_id"), "question", "tags")
        told = cut(points.withColumnRenamed("chunk_key", "key").join(turns, "turn_id").withColumn("headline", F.col("question")))
        summary = cut(semantic_map.summary(points))
        counts = cut(semantic_map.tag_counts(told.select("cluster", F.col("key").alias("point"), F.explode_outer("tags").alias("tag"))))
        sizes = {r["cluster"]: r["points"] for r in summary.collect()}
        lists = []
        for tags in (semantic_map.distinctive_tags(counts, len(sizes)), semantic_map.common_tags(counts)):
            found: dict[int, list[str]] = {}
            for r in tags.orderBy("cluster", "place").collect():
                found.setdefault(r["cluster"], []).append(r["tag"])
            lists.append(found)
        headlines = dict(semantic_map.medoids(told, summary).collect())
        names = semantic_map.names(sizes, *lists, headlines)
        named = self.spark.createDataFrame(list(names.items()), "cluster int, name string")
        return summary.join(F.broadcast(named), "cluster")

    def in_cluster(self, query: str, cluster: int, k: int = 5) -> DataFrame:
        """The hits of a search that lie in a cluster of the map."""
        return finding.in_cluster(self.search(query, k), self.table("points"), cluster)

    def session(self, session_id: str, limit: int = 50) -> DataFrame:
        return sessions.by_prefix(self.table("turns"), session_id, limit)

    def recent(self, limit: int = 20) -> DataFrame:
        return sessions.recent(self.table("turns"), limit)

    def sessions(self, limit: int | None = None) -> DataFrame:
        return sessions.session_list(self.table("turns"), self.table("hidden"), self.table("titles"), limit)

    def stats(self) -> DataFrame:
        return sessions.stats(self.table("turns"), self.table("chunks"), self.table("vectors"))

    # Changes

    def hide(self, session_id: str, at: float) -> None:
        old = self.table("hidden")
        new = merge.hide_scope(self.table("turns"), session_id, at)
        self.save("hidden", cut(old.unionByName(new.join(old, "turn_id", "left_anti"))))

    def unhide(self, session_id: str, at: float) -> None:
        hidden, back = merge.unhidden(self.table("hidden"), self.table("unfolded"), self.table("turns"), session_id, at)
        hidden, back = cut(hidden), cut(back)
        self.save("hidden", hidden)
        self.save("unfolded", back)

    def title(self, session_id: str, title: str, at: float) -> None:
        old = self.table("titles")
        new = self.spark.createDataFrame([(session_id, title, at)], TABLES["titles"])
        merged = merge.last_writer(old.withColumnRenamed("title", "value"), new.withColumnRenamed("title", "value"), "session_id", at)
        self.save("titles", cut(merged.withColumnRenamed("value", "title")))

    def create_folder(self, name: str, parent_id: int | None = None, at: float | None = None) -> int:
        """A new folder; its id."""
        made = cut(folders.created(self.table("folders"), name, parent_id, uuid.uuid4().hex[:16], time.time() if at is None else at))
        self.save("folders", made)
        return made.agg(F.max("id")).first()[0]

    def move_folder(self, folder_id: int, into: int | None, before: int | None = None, at: float | None = None) -> bool:
        """Whether the folder may lie there; if so, it does, right before a sibling or behind all."""
        moved = folders.moved(self.table("folders"), folder_id, into, before, time.time() if at is None else at)
        if moved is not None:
            self.save("folders", cut(moved))
        return moved is not None

    def delete(self, turn_ids: Sequence[str]) -> None:
        gone = self.spark.createDataFrame([(t,) for t in turn_ids], "id string")
        touched = self.buckets["turns"].touched(gone)
        turns, chunks = (cut(x) for x in merge.delete_turns(self.buckets["turns"].read(touched), self.buckets["chunks"].read(touched), gone))
        vectors = cut(self.buckets["vectors"].read(touched).join(chunks.select("chunk_key"), "chunk_key", "left_semi"))
        for name, rows in (("vectors", vectors), ("chunks", chunks), ("turns", turns)):
            self.buckets[name].put(rows, touched)
        self.keyword.remove(gone)

    def reconcile(self) -> int:
        """Drops vectors whose turn is gone, how many they were; and makes the keyword index hold the turns that are there."""
        self.keyword.heal(self._searchable().select("id", "text"))
        vectors = self.table("vectors")
        gone = cut(merge.orphans(vectors, self.table("turns")))
        if n := gone.count():
            touched = self.buckets["vectors"].touched(gone)
            self.buckets["vectors"].put(cut(self.buckets["vectors"].read(touched).join(gone, "chunk_key", "left_anti")), touched)
        return n

    # Devices

    def _shared_settings(self) -> dict[str, DataFrame]:
        """Titles, folds, folders, items and tombstones as snapshots carry them: folders by uid, not by this device's ids."""
        folders = self.table("folders").where("uid IS NOT NULL")
        above = folders.select(F.col("id").alias("parent_id"), F.col("uid").alias("parent_uid"))
        owner = folders.select(F.col("id").alias("folder_id"), F.col("uid").alias("folder_uid"))
        folds = self.table("hidden").select("turn_id", F.lit(1).alias("folded"), F.col("hidden_at").alias("at"))
        return {
            "title": self.table("titles"),
            "fold": merge.newest(folds, self.table("unfolded").select("turn_id", F.lit(0).alias("folded"), "at"), ["turn_id"], float("inf")),
            "folder": folders.join(above, "parent_id", "left").withColumn("at", F.coalesce("at", F.lit(0.0))).select(*archive_io.SETTINGS["folder"]),
            "fitem": self.table("items").join(owner, "folder_id").withColumn("at", F.coalesce("at", F.lit(0.0))).select(*archive_io.SETTINGS["fitem"]),
            "folder_x": self.table("folders_gone").withColumnRenamed("removed_at", "at"),
            "fitem_x": self.table("items_gone").withColumnRenamed("removed_at", "at"),
        }

    def export(self, path: str) -> None:
        archive_io.write_snapshot(self.table("turns"), self.table("chunks"), path, self._shared_settings())

    def import_from(self, path: str, now: float | None = None) -> int:
        """Takes in the turns of another device's snapshot that rank higher, with their chunks, its summaries of turns that have none, and
        its later settings; the number of turns that came in."""
        lines = cut(archive_io.read_snapshot(self.spark, path))
        turns = archive_io.snapshot_turns(lines)
        turns = turns.withColumn("actions", F.coalesce("actions", F.lit("[]")))
        chunks = archive_io.snapshot_chunks(lines).where("idx IS NOT NULL AND text <> ''").dropDuplicates(["turn_id", "idx"])
        n = self.take_in(cut(turns.where(filled(F.col("id")).isNotNull()).dropDuplicates(["id"])), strict=True, given=chunks)
        self._take_settings(lines, time.time() if now is None else now)
        return n

    def _take_settings(self, lines: DataFrame, now: float) -> None:
        """Merges a snapshot's settings: the later change wins, removals stand against what is not newer.

        Folders keep this device's ids; new ones get the next. One whose parent is not there lies at the root; items of
        folders that are not there wait for a later snapshot.
        """
        mine = self._shared_settings()
        keys = {"title": ["session_id"], "fold": ["turn_id"], "folder": ["uid"], "fitem": ["folder_uid", "kind", "ref"], "folder_x": ["uid"], "fitem_x": ["folder_uid", "kind", "ref"]}
        both = {kind: cut(merge.newest(mine[kind], archive_io.settings_of(lines, kind), key, now)) for kind, key in keys.items()}
        gone, items_gone = (both[k].withColumnRenamed("at", "removed_at") for k in ("folder_x", "fitem_x"))

        old = self.table("folders")
        shared = merge.removed_by_peer(both["folder"], gone)
        known = shared.join(old.select("uid", "id"), "uid", "left")
        last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = running_sum(known.where("id IS NULL").select("uid", F.lit(1).alias("one")), [F.col("uid")], "one")
        ids = cut(known.where("id IS NOT NULL").select("uid", "id").unionByName(fresh.select("uid", (F.col("total") + last).cast("long").alias("id"))))
        above = ids.select(F.col("uid").alias("parent_uid"), F.col("id").alias("parent_id"))
        folders = shared.join(ids, "uid").join(above, "parent_uid", "left")
        columns = ["id", "name", "parent_id", "position", "uid", "at"]
        folders = cut(folders.select(*columns).unionByName(old.where("uid IS NULL").select(*columns)))

        there = ids.select(F.col("uid").alias("folder_uid"), F.col("id").alias("folder_id"))
        kept = merge.with_tombstones(both["fitem"], items_gone, keys["fitem"]).join(there, "folder_uid")
        local = self.table("items")
        unshared = local.join(old.where("uid IS NULL").select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
        items = cut(kept.select(*local.columns).unionByName(unshared))

        self.save("titles", both["title"])
        self.save("hidden", both["fold"].where("folded = 1").select("turn_id", F.col("at").alias("hidden_at")))
        self.save("unfolded", both["fold"].where("folded = 0"))
        self.save("folders", folders)
        self.save("items", items)
        self.save("folders_gone", gone)
        self.save("items_gone", items_gone)

    def markdown(self) -> DataFrame:
        return archive_io.markdown(self.table("turns"), self.table("hidden"))
