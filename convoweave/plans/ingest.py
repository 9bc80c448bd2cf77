"""Queries that run the adapters: `conversations` written as the log lines of each kind, read back by ranges and folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from convoweave.functions import text
from convoweave.operators import turns as turn_ops
from convoweave.plans.model import TURNS, sql, stamp
from convoweave.session import new_path, table
from convoweave.sources import ranged, transcripts as tr

QUERIES, ORACLE_SQL = {}, {}
LEAST_FILES, LINES_A_FILE = 8, 20_000
COLUMNS = ["kind", "session_id", "uuid", "question", "answer", "acts"]


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """`conversations` from each one's first question on, dealt over files by conv_id and in their order."""
    rows = table(spark, sf, "conversations")
    files = max(LEAST_FILES, rows.count() // LINES_A_FILE)
    dealt = rows.withColumn("file_no", F.pmod("conv_id", F.lit(files))).repartition(files, "file_no")
    order = Window.partitionBy("file_no", "conv_id").orderBy("turn")
    asked = F.sum((F.col("role") == "user").cast("int")).over(order)
    rows = dealt.withColumn("asked", asked).withColumn("text", F.coalesce("text", F.lit("")))
    acts = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    return rows.where("asked > 0").withColumn("acts", acts).withColumn("detail", F.concat(F.lit("f"), F.col("turn"))).withColumn("at", stamp(F.col("conv_id"), F.col("turn")))


def chat_lines(rows: DataFrame, sub_stream: bool) -> DataFrame:
    """file_no and value: log lines of adapter A, or C."""
    session = F.concat(F.lit("a" if sub_stream else "c"), F.col("conv_id"))
    field = F.lit("agentId" if sub_stream else "sessionId")
    meta = F.when(F.lit(sub_stream) & (F.col("asked") > 1), F.lit(True))
    side = F.when(F.lit(sub_stream), F.lit(True))
    user = F.struct(
        F.lit("user").alias("type"), F.col("turn").cast("string").alias("uuid"), session.alias("session"), F.lit("/w").alias("cwd"), F.col("at").alias("timestamp"), meta.alias("isMeta"), side.alias("isSidechain"),
        F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message"),
    )
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string>").alias("input"))
    used = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Read").alias("name"), F.struct(F.col("detail").alias("file_path")).alias("input"))
    blocks = F.when(F.col("acts"), F.array(said, used)).otherwise(F.array(said))
    other = F.struct(F.col("role").alias("type"), session.alias("session"), side.alias("isSidechain"), F.struct(F.col("role").alias("role"), blocks.alias("content")).alias("message"))
    named = lambda c: F.replace(F.to_json(c), F.lit('"session":"'), F.concat(F.lit('"'), field, F.lit('":"')))
    return rows.select("file_no", F.when(F.col("role") == "user", named(user)).otherwise(named(other)).alias("value"))


def rollout_lines(rows: DataFrame) -> DataFrame:
    """file_no and value: log lines of adapter B, each file behind the line that names its session."""

    def done(item: Column) -> Column:
        return F.to_json(F.struct(F.col("at").alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("item_completed").alias("type"), item.alias("item")).alias("payload")))

    def message(of: str, kind: str) -> Column:
        key = F.concat_ws(":", "conv_id", "turn")
        return done(F.struct(F.lit(of).alias("type"), key.alias("id"), F.array(F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"))).alias("content")))

    run = done(F.struct(F.lit("CommandExecution").alias("type"), F.array(F.struct(F.col("detail").alias("cmd"))).alias("parsed_cmd")))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("r"), F.col("file_no")).alias("id"), F.lit("/w").alias("cwd")).alias("payload")))
    first = F.row_number().over(Window.partitionBy("file_no").orderBy("conv_id", "turn")) == 1
    body = F.when(F.col("role") == "user", F.array(message("UserMessage", "text"))).when(F.col("role") == "assistant", F.array(message("AgentMessage", "Text")))
    body = F.concat(F.coalesce(body, F.array().cast("array<string>")), F.when(F.col("acts"), F.array(run)).otherwise(F.array().cast("array<string>")))
    lines = F.concat(F.when(F.col("first"), F.array(head)).otherwise(F.array().cast("array<string>")), body)
    return rows.withColumn("first", first).select("file_no", F.explode(lines).alias("value"))


def written(spark: SparkSession, lines: DataFrame, name: str) -> DataFrame:
    """The files of `lines`, written below the shared folder, as `tr.files` lists them."""
    path = new_path(spark, name)
    lines.write.partitionBy("file_no").text(path)
    return tr.files(spark, path, "*.txt")


def told(kind: str, turns: DataFrame) -> DataFrame:
    return turns.select(F.lit(kind).alias("kind"), "session_id", "uuid", "question", "answer", F.array_join(text.rendered(F.col("actions")), "; ").alias("acts"))


def ingest_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of all `conversations` through the files and adapters of the three kinds."""
    rows = conversations(spark, sf)
    chat, sub, rollout = (written(spark, lines, name) for lines, name in ((chat_lines(rows, False), "chat"), (chat_lines(rows, True), "agent"), (rollout_lines(rows), "rollout")))
    found = told("chat", turn_ops.fold(tr.chat_records(tr.sound(ranged.lines(chat)))))
    found = found.union(told("sub", turn_ops.fold(tr.chat_records(tr.with_follow_ups(tr.sound(ranged.lines(sub))), sub_stream=True))))
    return found.union(told("rollout", turn_ops.fold(tr.rollout_records(tr.sound(ranged.lines(rollout))))))


QUERIES["ingest_logs"] = ingest_logs
#: A sub-stream file counts if persons followed up in it twice; a rollout's session is its file.
ORACLE_SQL["ingest_logs"] = sql(
    TURNS,
    f"n AS (SELECT greatest({LEAST_FILES}, (SELECT count(*) FROM conversations) // {LINES_A_FILE}) AS files)",
    "t AS (SELECT turns.*, conv_id % files AS file_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM turns, n)",
    "live AS (SELECT file_no FROM t WHERE asked > 1 GROUP BY file_no HAVING count(*) >= 2)",
    """SELECT 'chat' AS kind, 'c' || conv_id AS session_id, turn::VARCHAR AS uuid, question, answer, acts FROM t
UNION ALL SELECT 'sub', 'a' || conv_id, turn::VARCHAR, question, answer, acts FROM t WHERE file_no IN (SELECT file_no FROM live)
UNION ALL SELECT 'rollout', 'r' || file_no, conv_id || ':' || turn, question, answer, replace(acts, 'Read(', 'exec(') FROM t""",
)
