"""Transcripts: JSON lines of three adapters, read as columns and folded into turns.

Files are read whole by Spark (they may lie in any store it reads), one row a file, and split into lines in tasks with
their end offsets in bytes. A line without a line end at the end of a file is held back. Everything after that is
JSON paths on the line column, inside the JVM.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from convoweave.functions.text import session_of_path, strip
from convoweave.operators import turns as turn_ops
from convoweave.operators.turns import ACTIONS

#: Record types that are no conversation, beginnings of texts that no person typed, and the keys of a
#: tool's input that say most. Callers add the beginnings of their own prompts.
NOISE_TYPES = ("system", "mode", "permission-mode", "file-history-snapshot", "attachment", "last-prompt", "ai-title")
PLUMBING = (
    "<local-command", "<command-name>", "<command-message>", "<command-args>", "<command-stdout>", "<task-notification", "[SYSTEM NOTIFICATION",
    "This session is being continued from a previous conversation", "<bash-input", "<bash-stdout", "<bash-stderr", "[Request interrupted", "[Image: source:",
)
ACTION_KEYS = ("file_path", "notebook_path", "path", "command", "pattern", "url", "query")
SKIPPED_DIRS = r"/\.(stversions|[^/]+-archive)/"  # hidden folders of tools, not projects that end alike
LEAST_FOLLOW_UPS = 2
BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,input:string>>"


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, length, modified and content of the files below `root`, but for skipped folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), "content").where(~F.col("path").rlike(SKIPPED_DIRS))


def lines(found: DataFrame, start: Column | None = None) -> DataFrame:
    """file, offset (start of the line), end_offset and line, for complete lines that are not blank.

    start: the offset from which a file is read, on its columns; bytes that are no UTF-8 become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out, at = [], begin or 0
                for raw in content[at:].split(b"\n")[:-1]:
                    if raw.strip():
                        out.append((at, at + len(raw) + 1, raw.decode("utf-8", "replace")))
                    at += len(raw) + 1
                for k in range(0, len(out), 4096):
                    o, e, t = zip(*out[k : k + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(o)), pa.array(o, pa.int64()), pa.array(e, pa.int64()), pa.array(t)], ["file", "offset", "end_offset", "line"])

    rows = found.select("path", "content", (F.lit(0) if start is None else start).cast("long").alias("start"))
    return rows.mapInArrow(run, "file string, offset long, end_offset long, line string")


def sound(read: DataFrame) -> DataFrame:
    return read.where(F.try_parse_json("line").isNotNull())


def field(path: str) -> Column:
    return F.get_json_object("line", path)


def flag(path: str) -> Column:
    return F.coalesce(field(path) == "true", F.lit(False))


def texts(content: Column) -> Column:
    """The text of a message's content: itself if it is a text, else its text blocks on lines; null if it has none."""
    blocks = F.from_json(content, BLOCKS)
    some = F.filter(blocks, lambda b: b["type"] == "text")
    return F.when(F.substring(content, 1, 1) != "[", content).when(F.size(some) > 0, F.array_join(F.transform(some, lambda b: F.coalesce(b["text"], F.lit(""))), "\n"))


def plumbing(text: Column, beginnings: Sequence[str] = PLUMBING) -> Column:
    start = strip(text)
    out = F.lit(False)
    for b in beginnings:
        out = out | start.startswith(b)
    return out


def detail(given: Column, keys: Sequence[str] = ACTION_KEYS) -> Column:
    """What an action's input (JSON) says most: the first of `keys` that it has, else its keys; one line, 120 characters."""
    first = F.coalesce(*(F.get_json_object(given, f"$.{k}") for k in keys))
    listed = F.array_join(F.json_object_keys(given), ", ")
    text = F.coalesce(F.nullif(first, F.lit("")), listed, F.lit(""))
    return F.substring(F.trim(F.regexp_replace(text, "\n", " ")), 1, 120)


@pandas_udf(T.StringType())
def unrolled(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Prompts that hold the printed form of a list of blocks, as their text; others as they are."""

    def one(text):
        if not isinstance(text, str) or not (text.strip().startswith("[{") and "'type'" in text.strip()[:40]):
            return text
        try:
            found = [b.get("text", "") for b in ast.literal_eval(text.strip()) if isinstance(b, dict) and b.get("type") == "text"]
            return "\n".join(found) if found else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return text

    for batch in prompts:
        yield batch.map(one)


def chat_records(read: DataFrame, skip_automation: bool = True, sub_stream: bool = False, beginnings: Sequence[str] = PLUMBING) -> DataFrame:
    """Records of adapter A (chat logs), or C (sub_stream), from sound lines: what `operators.turns.fold` takes, and queued.

    C: the agent is the session, meta prompts are questions too, and the wrapper of forwarded messages goes.
    """
    kind = field("$.type")
    noise = kind.isin(*NOISE_TYPES) | flag("$.isCompactSummary") | flag("$.isVisibleInTranscriptOnly")
    if not sub_stream:
        noise = noise | flag("$.isMeta") | flag("$.isSidechain")
    content = field("$.message.content")
    typed = texts(content)
    if sub_stream:
        typed = F.regexp_replace(typed, r"(?s)^\s*<([a-z-]*message)[^>]*>\s*(.*?)\s*</\1>\s*$", "$2")
    user = (kind == "user") & (field("$.message.role") == "user") & typed.isNotNull() & ~plumbing(typed, beginnings)
    if skip_automation:
        user = user & ~F.coalesce(field("$.promptSource") == "sdk", F.lit(False))
    human = (kind == "attachment") & (field("$.attachment.type") == "queued_command") & (field("$.attachment.origin.kind") == "human")
    rows = read.withColumn("_human", F.coalesce(human, F.lit(False)))
    prompt = F.when(F.col("_human"), field("$.attachment.prompt"))
    printed = F.coalesce(prompt.rlike(r"^\s*\[\{'type'"), F.lit(False))
    asked = F.when(printed, unrolled(prompt)).otherwise(F.when(F.substring(prompt, 1, 2) == '[{', texts(prompt)).otherwise(F.nullif(F.trim(prompt), F.lit(""))))
    rows = rows.withColumn("_queued", asked)
    queued = F.col("_queued").isNotNull() & ~plumbing(F.col("_queued"), beginnings)
    starts = F.coalesce(queued | (~F.coalesce(noise, F.lit(False)) & user), F.lit(False))
    blocks = F.from_json(content, BLOCKS)
    assistant = F.coalesce((kind == "assistant") & ~noise, F.lit(False))
    said = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "thinking")), lambda b: F.when(b["type"] == "text", b["text"]).otherwise(F.trim(b["thinking"])))
    answer = F.when(F.substring(content, 1, 1) != "[", content).otherwise(F.array_join(F.filter(said, lambda x: x != ""), "\n"))
    used = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(F.coalesce(b["name"], F.lit("tool")).alias("tool"), F.coalesce(detail(b["input"]), F.lit("")).alias("detail")))
    session = F.coalesce(field("$.agentId"), field("$.sessionId"), F.lit("")) if sub_stream else F.coalesce(field("$.sessionId"), F.lit(""))
    return rows.select(
        "file", "offset", starts.alias("starts"), session.alias("session_id"), F.coalesce(field("$.uuid"), F.lit("")).alias("uuid"), field("$.parentUuid").alias("parent_uuid"),
        F.coalesce(field("$.timestamp"), F.lit("")).alias("timestamp"), F.coalesce(field("$.cwd"), F.lit("")).alias("project"),
        F.when(queued, F.col("_queued")).otherwise(typed).alias("question"), F.when(assistant, answer).alias("answer"), F.when(assistant, used).cast(ACTIONS).alias("actions"),
        F.coalesce(queued, F.lit(False)).alias("queued"),
    )


def automation(read: DataFrame, beginnings: Sequence[str] = PLUMBING) -> DataFrame:
    """sessions (files) and turns that automated prompts make up."""
    typed = texts(field("$.message.content"))
    mine = (field("$.promptSource") == "sdk") & (field("$.type") == "user") & (field("$.message.role") == "user") & typed.isNotNull() & ~plumbing(typed, beginnings)
    return read.where(mine).agg(F.countDistinct("file").alias("sessions"), F.count("*").alias("turns"))


def with_follow_ups(read: DataFrame, least: int = LEAST_FOLLOW_UPS) -> DataFrame:
    """Lines of the sub-stream files in which a person followed up at least `least` times."""
    typed = texts(field("$.message.content"))
    follow = flag("$.isMeta") & (field("$.type") == "user") & (field("$.message.role") == "user") & typed.isNotNull() & ~plumbing(typed)
    kept = read.where(follow).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("file")
    return read.join(kept, "file", "left_semi")


def rollout_contexts(read: DataFrame) -> DataFrame:
    """file, session_id, project and automated, from the first line of adapter B's files; else the id in the file's name."""
    first = read.groupBy("file").agg(F.min_by("line", "offset").alias("line"))
    meta = field("$.type") == "session_meta"
    found = F.when(meta, F.coalesce(field("$.payload.id"), field("$.payload.session_id")))
    auto = meta & ((field("$.payload.originator") == "codex_exec") | (field("$.payload.source") == "exec"))
    return first.select("file", F.coalesce(F.nullif(found, F.lit("")), session_of_path(F.col("file"))).alias("session_id"), F.coalesce(F.when(meta, field("$.payload.cwd")), F.lit("")).alias("project"), F.coalesce(auto, F.lit(False)).alias("automated"))


def rollout_records(read: DataFrame, skip_automation: bool = True) -> DataFrame:
    """Records of adapter B from sound lines. A turn keeps the generation (old or new) of the record that starts it."""
    contexts = rollout_contexts(read)
    rows = read.join(contexts.where(~F.col("automated")) if skip_automation else contexts, "file")
    kind, payload, item = field("$.type"), field("$.payload.type"), field("$.payload.item.type")
    old_question = F.when((kind == "event_msg") & (payload == "user_message"), field("$.payload.message"))
    blocks = F.from_json(field("$.payload.item.content"), BLOCKS)
    block_text = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"] != ""), lambda b: b["text"]), "\n")
    done = F.coalesce((kind == "event_msg") & (payload == "item_completed"), F.lit(False))
    question = F.nullif(strip(F.coalesce(old_question, F.when(done & (item == "UserMessage"), block_text))), F.lit(""))
    rows = rows.withColumn("question", question).withColumn("_mode", F.when(F.col("question").isNotNull(), F.when(done, "new").otherwise("old")))
    mode = F.last("_mode", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_in", mode)
    old, new = F.col("_in") == "old", F.col("_in") == "new"
    answer = F.when(old & (kind == "event_msg") & (payload == "agent_message"), field("$.payload.message")).when(new & done & (item == "AgentMessage"), block_text)
    answer = F.when(F.trim(answer) != "", answer)
    call = old & (kind == "response_item") & payload.isin("function_call", "custom_tool_call")
    arguments = field("$.payload.arguments")
    raw = F.coalesce(F.nullif(field("$.payload.input"), F.lit("")), arguments, F.lit(""))
    called = F.coalesce(F.nullif(F.when(F.trim(arguments).startswith("{"), detail(arguments, ("command", *ACTION_KEYS, "cmd", "input"))), F.lit("")), F.substring(F.trim(F.regexp_replace(raw, "\n", " ")), 1, 120))
    command = F.array_join(F.from_json(field("$.payload.item.command"), "array<string>"), " ")
    run = F.coalesce(F.nullif(field("$.payload.item.parsed_cmd[0].cmd"), F.lit("")), F.nullif(field("$.payload.item.parsed_cmd[0].name"), F.lit("")), command, field("$.payload.item.command"), F.lit(""))
    line_of = lambda t: F.substring(F.trim(F.regexp_replace(t, "\n", " ")), 1, 120)
    action = (
        F.when(call, F.struct(F.coalesce(field("$.payload.name"), F.lit("tool")).alias("tool"), called.alias("detail")))
        .when(new & done & (item == "CommandExecution"), F.struct(F.lit("exec").alias("tool"), line_of(run).alias("detail")))
        .when(new & done & (item == "Extension"), F.struct(F.coalesce(field("$.payload.item.kind"), F.lit("extension")).alias("tool"), line_of(F.coalesce(field("$.payload.item.query"), F.lit(""))).alias("detail")))
    )
    uuid = F.coalesce(F.when(done, F.nullif(field("$.payload.item.id"), F.lit(""))), F.concat(F.lit("@"), F.col("end_offset").cast("string")))
    return rows.select(
        "file", "offset", F.col("question").isNotNull().alias("starts"), "session_id", uuid.alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.coalesce(field("$.timestamp"), F.lit("")).alias("timestamp"),
        "project", "question", answer.alias("answer"), F.when(action.isNotNull(), F.array(action)).cast(ACTIONS).alias("actions"),
    )


def turns(records: DataFrame, source: str) -> DataFrame:
    """Turns of records, with source and source_file."""
    return turn_ops.fold(records).withColumn("source", F.lit(source)).withColumn("source_file", F.col("file"))
