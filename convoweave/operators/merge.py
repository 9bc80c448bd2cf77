"""Upserts and merges between devices: the more complete turn wins, the newer setting wins, tombstones stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY = 86_400
REPLACED = ("question", "answer", "actions", "source", "source_file", "queued", "parser_version")


def rank(prefix: str = "") -> Column:
    """A turn's completeness: parser version, then the characters of question, answer and actions as JSON."""
    c = lambda name: F.coalesce(F.col(f"{prefix}{name}"), F.lit(""))
    return F.struct(F.coalesce(F.col(f"{prefix}parser_version"), F.lit(0)).alias("v"), (F.char_length(c("question")) + F.char_length(c("answer")) + F.char_length(c("actions"))).alias("n"))


def upsert(stored: DataFrame, fresh: DataFrame, strict: bool = False) -> DataFrame:
    """Stored turns after `fresh` ones (at most one for each id) came in; outcome: kept, inserted, replaced or rejected.

    A fresh turn is rejected if it ranks lower (strict: also if it ranks equal). What replaces a stored turn changes
    REPLACED alone; identity, session, time and project stay.
    """
    s, f = stored.alias("s"), fresh.alias("f")
    both = s.join(f, F.col("s.id") == F.col("f.id"), "full")
    better = rank("f.") > rank("s.") if strict else rank("f.") >= rank("s.")
    new = F.col("s.id").isNull()
    wins = F.col("f.id").isNotNull() & (new | better)
    outcome = F.when(F.col("f.id").isNull(), "kept").when(new, "inserted").when(better, "replaced").otherwise("rejected")
    columns = [F.when(wins if c in REPLACED else new, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in stored.columns]
    return both.select(*columns, outcome.alias("outcome"))


def latest(versions: DataFrame) -> DataFrame:
    """One of several versions (arrival: their order) of each turn: the best rank, the last to arrive among equals."""
    key = F.struct(rank(), F.col("arrival"))
    columns = F.struct(*(c for c in versions.columns if c != "id"))
    return versions.groupBy("id").agg(F.max_by(columns, key).alias("v")).select("id", "v.*")


def stale_chunks(chunks: DataFrame, replaced: DataFrame) -> DataFrame:
    """Chunks that stay when the turns in `replaced` (id) get new ones."""
    return chunks.join(replaced.select(F.col("id").alias("turn_id")), "turn_id", "left_anti")


def last_writer(local: DataFrame, peer: DataFrame, key: str, now: float) -> DataFrame:
    """key, value and at: the newer of both sides (the local one among equals); clocks over a day ahead are refused."""
    sane = peer.where(F.col("at") <= now + DAY)
    rows = local.select(key, "value", "at", F.lit(1).alias("mine")).union(sane.select(key, "value", "at", F.lit(0).alias("mine")))
    return rows.groupBy(key).agg(F.max_by(F.struct("value", "at"), F.struct("at", "mine")).alias("w")).select(key, "w.value", "w.at")


def newest(local: DataFrame, peer: DataFrame, key: list[str], now: float) -> DataFrame:
    """Rows of both sides, of each key the one with the latest `at` (the local one among equals); as `last_writer`, for several columns."""
    rows = local.withColumn("_mine", F.lit(1)).unionByName(peer.where(F.col("at") <= now + DAY).withColumn("_mine", F.lit(0)))
    values = F.struct(*(c for c in local.columns if c not in key))
    return rows.groupBy(*key).agg(F.max_by(values, F.struct("at", "_mine")).alias("_w")).select(*key, "_w.*").select(*local.columns)


def with_tombstones(live: DataFrame, tombs: DataFrame, key: str | list[str] = "uid") -> DataFrame:
    """Live rows (key, at and others) that no tombstone (key, removed_at) of the same age or newer removes."""
    joined = live.join(tombs.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max("removed_at").alias("removed_at")), key, "left")
    return joined.where("removed_at IS NULL OR removed_at < at").drop("removed_at")


def attached(folders: DataFrame) -> DataFrame:
    """Folders (uid, parent_uid) with parent: null, and parked at the root, while the parent has not arrived."""
    there = folders.select(F.col("uid").alias("parent_uid"), F.col("uid").alias("parent"))
    return folders.join(there, "parent_uid", "left").select(*folders.columns, "parent", (F.col("parent_uid").isNotNull() & F.col("parent").isNull()).alias("parked"))


def removed_by_peer(folders: DataFrame, tombs: DataFrame) -> DataFrame:
    """Folders after a peer's removals: children of a removed folder move to the root."""
    kept = with_tombstones(folders, tombs)
    there = kept.select(F.col("uid").alias("parent_uid"), F.lit(True).alias("_there"))
    joined = kept.join(there, "parent_uid", "left")
    return joined.select(*(F.when(F.col("_there"), F.col("parent_uid")).alias(c) if c == "parent_uid" else F.col(c) for c in folders.columns))


def orphans(vectors: DataFrame, turns: DataFrame) -> DataFrame:
    """chunk_key of vectors whose turn is gone."""
    owned = vectors.select("chunk_key", F.regexp_replace("chunk_key", r"#[^#]*$", "").alias("id"))
    return owned.join(turns.select("id"), "id", "left_anti").select("chunk_key")


def delete_turns(turns: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns and chunks without those of `gone` (id)."""
    return turns.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "turn_id"), "turn_id", "left_anti")


def hide_scope(turns: DataFrame, session_id: str, at: float) -> DataFrame:
    """turn_id, hidden_at for a session and its sub-sessions, which the path of their file tells."""
    inside = (F.col("session_id") == session_id) | F.coalesce("source_file", F.lit("")).contains(f"/{session_id}/subagents/")
    return turns.where(inside).select(F.col("id").alias("turn_id"), F.lit(at).alias("hidden_at"))


def classify(base: Column, conflict: Column) -> Column:
    """identical, conflict_wins (it goes on where base ends), base_wins or fork, for two arrays of lines."""
    starts = lambda a, b: (F.size(a) < F.size(b)) & (F.slice(b, 1, F.greatest(F.size(a), F.lit(0))) == a)
    return F.when(base == conflict, "identical").when(starts(base, conflict), "conflict_wins").when(starts(conflict, base), "base_wins").otherwise("fork")


def base_of_conflict(name: Column) -> Column:
    """The file that a synchronisation conflict's copy is of; empty for other names."""
    return F.concat(F.regexp_extract(name, r"^(.*)\.sync-conflict-\d{8}-\d{6}-[A-Z0-9]+(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*)\.sync-conflict-\d{8}-\d{6}-[A-Z0-9]+(\.[^.]*)?$", 2))


def active(age_seconds: Column, limit: int = 300) -> Column:
    return age_seconds < limit


def roll_up(shares: DataFrame) -> DataFrame:
    """device and percent: the least completion of its folders, between 0 and 100."""
    return shares.groupBy("device").agg(F.least(F.greatest(F.min("percent"), F.lit(0.0)), F.lit(100.0)).alias("percent"))


def unhidden(hidden: DataFrame, unfolded: DataFrame, turns: DataFrame, session_id: str, at: float) -> tuple[DataFrame, DataFrame]:
    """hidden without a session's turns and its sub-sessions', and unfolded with the time at which they came back."""
    back = hide_scope(turns, session_id, at).select("turn_id", F.lit(at).alias("at"))
    return hidden.join(back, "turn_id", "left_anti"), unfolded.join(back, "turn_id", "left_anti").unionByName(back.join(hidden, "turn_id", "left_semi"))


def folded_state(hidden: DataFrame, unfolded: DataFrame) -> DataFrame:
    """turn_id and hidden_at of turns whose last change was to hide them. unfolded: turn_id, at."""
    rows = hidden.join(unfolded.withColumnRenamed("at", "_back"), "turn_id", "left")
    return rows.where("_back IS NULL OR _back < hidden_at").drop("_back")
