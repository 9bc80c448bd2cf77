"""Cursors over growing files: what is new, what has to wait, what still lacks vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from convoweave.functions.text import contextual
from convoweave.operators.turns import with_previous_question
from convoweave.sources import transcripts

IDLE = 120


def start_offset() -> Column:
    """Where a file is read from: the held turn, else the cursor; the beginning if the file has shrunk (rotation)."""
    at = F.coalesce("hold_offset", "offset", F.lit(0))
    return F.when(F.coalesce("offset", F.lit(0)) > F.col("length"), F.lit(0)).otherwise(at)


def changed(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """`files` (path, length and others) that have bytes beyond their cursor (path, offset, hold_offset), with start."""
    rows = files.join(cursors, "path", "left")
    return rows.where(F.col("length") != F.coalesce("offset", F.lit(0))).withColumn("start", start_offset())


def has_new(files: DataFrame, cursors: DataFrame) -> bool:
    return not changed(files.drop("content"), cursors).isEmpty()


def read_new(spark: SparkSession, root: str, cursors: DataFrame, pattern: str = "*.jsonl") -> DataFrame:
    """Complete new lines (file, offset, end_offset, line) of the changed files below `root`."""
    return transcripts.lines(changed(transcripts.files(spark, root, pattern), cursors), F.col("start"))


def advanced(files: DataFrame, read: DataFrame, turns: DataFrame, idle: int = IDLE) -> tuple[DataFrame, DataFrame]:
    """The turns that are complete, and the cursors (path, offset, hold_offset) after them.

    The last turn of a file waits while the file is active (age_seconds at most `idle`), and the cursor stays at its
    start; in an idle file it counts, and hold_offset remembers where it starts, so that later bytes read it again.
    """
    ends = read.groupBy(F.col("file").alias("path")).agg(F.max("end_offset").alias("end"))
    last = turns.groupBy(F.col("file").alias("path")).agg(F.max("offset").alias("last_start"))
    rows = files.select("path", "age_seconds").join(ends, "path").join(last, "path", "left")
    waits = (F.col("age_seconds") <= idle) & F.col("last_start").isNotNull()
    cursors = rows.select("path", F.when(waits, F.col("last_start")).otherwise(F.col("end")).alias("offset"), F.when(~waits, F.col("last_start")).alias("hold_offset"))
    held = rows.where(waits).select(F.col("path").alias("file"), F.col("last_start").alias("offset"))
    return turns.join(held, ["file", "offset"], "left_anti"), cursors


def missing_vectors(turns: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunk_key and input of chunks without a vector, in the context of the question before."""
    lacking = chunks.join(vectors.select("chunk_key"), "chunk_key", "left_anti")
    about = with_previous_question(turns).select(F.col("id").alias("turn_id"), "project", "previous_question")
    return lacking.join(about, "turn_id").select("chunk_key", contextual(F.col("project"), F.col("previous_question"), F.col("text")).alias("input"))


def activity(events: DataFrame, key: str, at: str, idle: int = IDLE) -> DataFrame:
    """key, started, ended and n of runs of events without a gap of `idle` seconds or more. Also for streams with a watermark."""
    window = F.session_window(F.col(at), f"{idle} seconds")
    return events.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("ended")).select(key, F.col("w.start").alias("started"), "ended", "n")


def slices(turns: DataFrame, most_bytes: int) -> DataFrame:
    """`turns` (file, offset) with slice: bounded reads that are cut where a turn starts."""
    first = F.min("offset").over(Window.partitionBy("file"))
    return turns.withColumn("slice", F.floor((F.col("offset") - first) / most_bytes).cast("long"))


LIVE, HEAD = 5 << 20, 1 << 20


def live_tail(files: DataFrame, cursors: DataFrame, most: int = LIVE) -> DataFrame:
    """`changed` files with start moved on so that at most `most` bytes are read, and the bytes that this skips."""
    rows = changed(files, cursors)
    start = F.greatest(F.col("start"), F.col("length") - most)
    return rows.withColumn("skipped", start - F.col("start")).withColumn("start", start)


def unindexed(files: DataFrame, cursors: DataFrame, head: int = HEAD) -> DataFrame:
    """Files that no cursor knows, cut to their first bytes: enough for a provisional row in the list of sessions."""
    return files.join(cursors.select("path"), "path", "left_anti").withColumn("content", F.substring("content", 1, head))


def adopted(found: DataFrame) -> DataFrame:
    """session_id, count, started, ended and headline of provisional turns."""
    order = F.struct("timestamp", "id")
    return found.groupBy("session_id").agg(F.count("*").alias("count"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), F.min_by("question", order).alias("headline"))
