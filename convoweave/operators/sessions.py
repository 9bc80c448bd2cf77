"""Sessions and listings: one row per session, with its headline turn, folding state and counts.

Headlines are minima of structs, so a session is never sorted or gathered: partial aggregates meet in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoweave.functions.text import filled, source_or_default, squeeze


def headline() -> Column:
    return F.coalesce(filled(F.col("summary")), filled(F.col("question")), F.lit(""))


def with_hidden(turns: DataFrame, hidden: DataFrame) -> DataFrame:
    """`turns` with hidden_at; null for turns that are not hidden. hidden: turn_id, hidden_at."""
    return turns.join(hidden.select(F.col("turn_id").alias("id"), "hidden_at"), "id", "left")


def session_list(turns: DataFrame, hidden: DataFrame, titles: DataFrame, limit: int | None = None) -> DataFrame:
    """session_id, count, hidden_count, started, ended, headline, custom_title, source; the latest first.

    The headline is the user's title, else that of the first turn that is not hidden, else of the first turn.
    """
    hide = F.col("hidden_at").isNotNull()
    first = F.min_by(F.struct(headline().alias("h"), "source", "source_file"), F.struct(hide, F.col("timestamp"), F.col("id")))
    rows = with_hidden(turns, hidden).groupBy("session_id").agg(
        F.count("*").alias("count"), F.count(F.when(hide, 1)).alias("hidden_count"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), first.alias("f")
    )
    if limit:
        rows = rows.orderBy(F.desc("ended"), "session_id").limit(limit)
    named = titles.where("title <> ''").select("session_id", F.col("title").alias("custom_title"))
    rows = rows.join(named, "session_id", "left")
    return rows.select(
        "session_id", "count", "hidden_count", "started", "ended", F.coalesce("custom_title", "f.h").alias("headline"), "custom_title", source_or_default(F.col("f.source")).alias("source"),
        is_sub(F.col("f.source_file")).alias("subagent"), parent_of(F.col("f.source_file")).alias("parent"),
    )


def parent_of(source_file: Column) -> Column:
    """The parent session of a sub-stream's file (.../<parent>/subagents/...); null for others."""
    return filled(F.regexp_extract(F.coalesce(source_file, F.lit("")), r"([^/\\]+)[/\\]subagents[/\\]", 1))


def is_sub(source_file: Column) -> Column:
    return F.coalesce(source_file, F.lit("")).rlike(r"[/\\]subagents[/\\]")


def recent(turns: DataFrame, limit: int) -> DataFrame:
    """session_id, count, ended and the first turn's headline of the latest sessions; hidden turns count."""
    rows = turns.groupBy("session_id").agg(F.count("*").alias("count"), F.max("timestamp").alias("ended"), F.min_by(headline(), F.struct("timestamp", "id")).alias("headline"))
    return rows.orderBy(F.desc("ended"), "session_id").limit(limit)


def detail(turns: DataFrame, hidden: DataFrame, session_id: str) -> DataFrame:
    """The turns of one session in order, with their hidden flag."""
    rows = with_hidden(turns.where(F.col("session_id") == session_id), hidden)
    return rows.select("id", "timestamp", "question", "answer", F.col("hidden_at").isNotNull().alias("hidden")).orderBy("timestamp", "id")


def by_prefix(turns: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Turns of sessions whose id starts with `prefix` (taken literally), texts squeezed to 200 and 400 characters."""
    rows = turns.where(F.col("session_id").startswith(prefix))
    return rows.select("id", "session_id", "timestamp", squeeze(F.col("question"), 200).alias("question"), squeeze(F.col("answer"), 400).alias("answer")).orderBy("timestamp", "id").limit(max(1, min(500, limit)))


def folded_groups(turns: DataFrame, hidden: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions with hidden turns: folded, total, whole (all are hidden), started, ended, last_hidden, headline, last_turn_id."""
    hide = F.col("hidden_at").isNotNull()
    order = F.struct("timestamp", "id")
    rows = with_hidden(turns, hidden).groupBy("session_id").agg(
        F.count(F.when(hide, 1)).alias("folded"), F.count("*").alias("total"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"),
        F.max("hidden_at").alias("last_hidden"), F.min_by(headline(), order).alias("h"), F.max_by("id", order).alias("last_turn_id"),
    ).where("folded > 0")
    named = titles.where("title <> ''").select("session_id", "title")
    return rows.join(named, "session_id", "left").select(
        "session_id", "folded", "total", (F.col("folded") >= F.col("total")).alias("whole"), "started", "ended", "last_hidden", F.coalesce("title", "h").alias("headline"), "last_turn_id"
    )


def folded_count(groups: DataFrame) -> DataFrame:
    """Whole folded sessions plus the hidden turns of the others."""
    return groups.agg(F.coalesce(F.sum(F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.col("folded"))), F.lit(0)).alias("count"))


def sources(turns: DataFrame) -> DataFrame:
    """Turns by source, a missing one counting as the default; most first."""
    return turns.groupBy(F.coalesce("source", F.lit("claude-code")).alias("source")).agg(F.count("*").alias("turns")).orderBy(F.desc("turns"), "source")


def source_of_session(turns: DataFrame) -> DataFrame:
    """Each session's source and source_file: the first turn with a file, else the first turn."""
    order = F.struct(F.col("source_file").isNull(), F.col("timestamp"), F.col("id"))
    return turns.groupBy("session_id").agg(F.min_by(F.struct(source_or_default(F.col("source")).alias("source"), "source_file"), order).alias("s")).select("session_id", "s.source", "s.source_file")


def stats(turns: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: turns, sessions, enriched (a summary, even an empty one), chunks, vectors."""
    counts = turns.agg(F.count("*").alias("turns"), F.countDistinct("session_id").alias("sessions"), F.count("summary").alias("enriched"))
    return counts.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(vectors.agg(F.count("*").alias("vectors")))  # three single rows


def progress(files: DataFrame) -> DataFrame:
    """files, done and percent (at most 100) of files (size, offset)."""
    done = F.count(F.when(F.col("offset") >= F.col("size"), 1))
    return files.agg(F.count("*").alias("files"), done.alias("done"), F.least(F.lit(100.0), F.round(100.0 * done / F.greatest(F.count("*"), F.lit(1)), 1)).alias("percent"))


def pending(files: DataFrame, idle: int = 120) -> DataFrame:
    """new_sessions, updated_sessions and files that can be read now.

    files: size, offset (null: none yet), age_seconds, open_turn_only (all that is left is a turn still open).
    """
    start = F.coalesce("offset", F.lit(0))
    left = (F.col("size") > start) & ~((F.col("age_seconds") <= idle) & F.col("open_turn_only"))
    new, updated = F.count(F.when(left & (start == 0), 1)), F.count(F.when(left & (start > 0), 1))
    return files.agg(new.alias("new_sessions"), updated.alias("updated_sessions"), (new + updated).alias("files"))


def with_live(archived: DataFrame, live: DataFrame) -> DataFrame:
    """Archived turns with those of a live tail: a live one replaces its archived form; live marks those not archived yet."""
    a, b = archived.alias("a"), live.alias("b")
    columns = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in archived.columns]
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(*columns, F.col("a.id").isNull().alias("live"))


def nested(rows: DataFrame) -> DataFrame:
    """Session rows (session_id, parent) with top: sub-sessions whose parent is listed are not at the top level."""
    parents = rows.select(F.col("session_id").alias("parent"), F.lit(True).alias("_there"))
    return rows.join(parents, "parent", "left").select(*rows.columns, F.col("_there").isNull().alias("top"))


def visible(rows: DataFrame) -> DataFrame:
    """Session rows without those whose turns are all hidden and without children of such."""
    gone = rows.where("hidden_count >= count").select("session_id")
    kept = rows.join(gone, "session_id", "left_anti")
    return kept.join(gone.withColumnRenamed("session_id", "parent"), "parent", "left_anti").select(*rows.columns)


def list_filter(rows: DataFrame, term: str) -> DataFrame:
    """Session rows whose headline or id contains `term` (any case), and parents of such rows."""
    hit = F.lower("headline").contains(term.lower()) | F.lower("session_id").contains(term.lower())
    own = rows.where(hit)
    parents = own.select(F.col("parent").alias("session_id")).where("session_id IS NOT NULL").distinct()
    return own.union(rows.where(~hit).join(parents, "session_id", "left_semi").select(*rows.columns))


def file_counts(files: DataFrame) -> DataFrame:
    """Files by source; files of sub-streams count for their parent source. files: source, parent_source."""
    return files.groupBy(F.coalesce("parent_source", "source").alias("source")).agg(F.count("*").alias("files"))


def reindex_minutes(chunks: DataFrame, chunks_per_second: float) -> DataFrame:
    """Minutes that embedding all chunks again takes."""
    return chunks.agg(F.round(F.count("*") / chunks_per_second / 60, 4).alias("minutes"))


def batches(turns: DataFrame, size: int = 20) -> DataFrame:
    """Turns without summary in batches of `size` for each session, in order."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "id"))
    rows = turns.where("summary IS NULL")
    return rows.select("id", "session_id", "timestamp", F.floor((place - 1) / size).cast("long").alias("batch"), ((place - 1) % size).cast("long").alias("place"))
