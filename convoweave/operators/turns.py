"""Turns: records folded into questions with their answers and actions.

A record has session_id, file, offset (its order in the file), uuid, parent_uuid, timestamp, project, starts (whether a
turn starts here), question, answer (text that joins the open turn, else null) and actions. Files are folded apart,
so a shuffle by file is all there is; records of a file before its first question belong to no turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from convoweave.functions.text import contextual, strip

ACTIONS = "array<struct<tool:string,detail:string>>"


def fold(records: DataFrame) -> DataFrame:
    """One row for each turn: id, session_id, uuid, parent_uuid, timestamp, project, question, answer, actions, offset, queued.

    queued: whether the question was asked while an answer was still under way; false for records that do not tell.
    """
    if "queued" not in records.columns:
        records = records.withColumn("queued", F.lit(False))
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = records.withColumn("_turn", F.sum(F.col("starts").cast("int")).over(order)).where("_turn > 0")
    part = F.struct("offset", "starts", "session_id", "uuid", "parent_uuid", "timestamp", "project", "question", "answer", "actions", "queued")
    folded = numbered.groupBy("file", "_turn").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first = F.col("parts")[0]
    answers = F.filter(F.transform("parts", lambda p: p["answer"]), lambda a: a != "")
    return folded.select(
        F.concat(first["session_id"], F.lit(":"), first["uuid"]).alias("id"), first["session_id"].alias("session_id"), first["uuid"].alias("uuid"),
        first["parent_uuid"].alias("parent_uuid"), first["timestamp"].alias("timestamp"), first["project"].alias("project"),
        strip(first["question"]).alias("question"), strip(F.array_join(answers, "\n")).alias("answer"),
        F.flatten(F.filter(F.transform("parts", lambda p: p["actions"]), lambda a: a.isNotNull())).alias("actions"), "file", first["offset"].alias("offset"),
        F.coalesce(first["queued"], F.lit(False)).alias("queued"),
    )


def with_resume_offsets(turns: DataFrame) -> DataFrame:
    """Each turn with the offset at which the file's next turn starts; null for the last, which may still grow."""
    return turns.withColumn("resume_offset", F.lead("offset").over(Window.partitionBy("file").orderBy("offset")))


def held_back(turns: DataFrame, age_seconds, idle: int = 120) -> DataFrame:
    """`turns` with held: the last turn of a file that has not been idle for over `idle` seconds."""
    last = F.lead("offset").over(Window.partitionBy("file").orderBy("offset")).isNull()
    return turns.withColumn("held", last & (age_seconds <= idle))


def with_previous_question(turns: DataFrame, strict: bool = False) -> DataFrame:
    """Each turn with the last question before it that is not empty, in (timestamp, id) order.

    strict: only questions with an earlier timestamp count, so that turns at the same instant share theirs.
    """
    asked = F.when(F.col("question") != "", F.col("question"))
    order = Window.partitionBy("session_id").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(asked, ignorenulls=True).over(order)
    if not strict:
        return turns.withColumn("previous_question", before)
    instant = Window.partitionBy("session_id", "timestamp").orderBy("id")
    return turns.withColumn("_before", before).withColumn("previous_question", F.first("_before").over(instant)).drop("_before")


def embed_inputs(chunks: DataFrame, turns: DataFrame) -> DataFrame:
    """What a chunk's vector is made of, and its SHA-1: chunk_key, turn_id, input, embed_hash."""
    about = with_previous_question(turns).select(F.col("id").alias("turn_id"), "project", "previous_question")
    joined = chunks.join(about, "turn_id")
    text = contextual(F.col("project"), F.col("previous_question"), F.col("text"))
    return joined.select("chunk_key", "turn_id", text.alias("input")).withColumn("embed_hash", F.sha1("input"))


def to_embed(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """`inputs` with again: no vector yet, or another hash, or (hash unknown) another text.

    stored: chunk_key, old_hash, old_input, has_vector; an unknown hash (null) with an equal text is only stamped.
    """
    joined = inputs.join(stored, "chunk_key", "left")
    same = F.when(F.col("old_hash").isNotNull(), F.col("old_hash") == F.col("embed_hash")).otherwise(F.col("old_input") == F.col("input"))
    fresh = F.coalesce(F.col("has_vector") & same, F.lit(False))
    return joined.withColumn("again", ~fresh).withColumn("stamp", fresh & F.col("old_hash").isNull())


def with_thread(turns: DataFrame, window: int = 2) -> DataFrame:
    """Each turn with the ids of the turns of its session around it, hidden ones too, in (timestamp, id) order."""
    order = Window.partitionBy("session_id").orderBy("timestamp", "id").rowsBetween(-window, window)
    return turns.withColumn("thread", F.collect_list("id").over(order))
