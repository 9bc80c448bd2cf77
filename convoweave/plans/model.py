"""The driver tables as archive tables, in Spark and, with the same values, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoweave.operators import turns as turn_ops
from convoweave.operators.turns import ACTIONS
from convoweave.session import table

START = "2026-01-01 00:00:00"


def stamp(hours: Column, minutes: Column) -> Column:
    at = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(hours=hours.cast("int"), mins=minutes.cast("int"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """`conversations` as records: users start turns, assistants answer, system lines are noise."""
    rows = table(spark, sf, "conversations").where("role IN ('user', 'assistant')")
    sid = F.concat(F.lit("c"), F.col("conv_id"))
    user = F.col("role") == "user"
    action = F.array(F.struct(F.lit("Read").alias("tool"), F.concat(F.lit("f"), F.col("turn")).alias("detail")))
    return rows.select(
        sid.alias("file"), F.col("turn").alias("offset"), user.alias("starts"), sid.alias("session_id"), F.col("turn").cast("string").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"),
        stamp(F.col("conv_id"), F.col("turn")).alias("timestamp"), F.concat(F.lit("p"), F.col("conv_id") % 5).alias("project"),
        F.when(user, F.col("text")).alias("question"), F.when(~user, F.col("text")).alias("answer"),
        F.when(~user & ((F.col("conv_id") + F.col("turn")) % 3 == 0), action).cast(ACTIONS).alias("actions"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    folded = turn_ops.fold(records(spark, sf))
    number = F.substring("session_id", 2, 20).cast("long")
    return folded.select(
        "id", "session_id", "uuid", "parent_uuid", "timestamp", "project", "question", "answer", "actions", F.when(number % 2 == 0, "claude-code").otherwise("codex").alias("source"),
        F.when(number % 3 > 0, F.concat(F.lit("/logs/"), F.col("session_id"), F.lit(".jsonl"))).alias("source_file"), F.when(number % 4 == 0, F.concat(F.lit("about "), F.substring("question", 1, 20))).alias("summary"),
        (number % 2).cast("int").alias("parser_version"), "file", "offset",
    )


#: The same turns in SQL.
TURNS = r"""
rec AS (SELECT conv_id, turn, role, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g
        FROM conversations WHERE role IN ('user', 'assistant')),
base AS (SELECT conv_id, min(turn) AS turn, 'c' || conv_id AS session_id, 'c' || conv_id || ':' || min(turn) AS id,
         strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(conv_id) + to_minutes(min(turn)), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'p' || (conv_id % 5) AS project,
         regexp_replace(max(text) FILTER (role = 'user'), '^\s+|\s+$', '', 'g') AS question,
         regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND text <> ''), ''), '^\s+|\s+$', '', 'g') AS answer,
         coalesce(string_agg('Read(f' || turn || ')', '; ' ORDER BY turn) FILTER (role = 'assistant' AND (conv_id + turn) % 3 = 0), '') AS acts
         FROM rec WHERE g > 0 GROUP BY conv_id, g),
turns AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'claude-code' ELSE 'codex' END AS source,
          CASE WHEN conv_id % 3 > 0 THEN '/logs/' || session_id || '.jsonl' END AS source_file,
          CASE WHEN conv_id % 4 = 0 THEN 'about ' || substr(question, 1, 20) END AS summary, conv_id % 2 AS parser_version FROM base)"""


def hidden(all_turns: DataFrame) -> DataFrame:
    """turn_id, hidden_at: every seventh turn, and all of every ninth session."""
    number = F.substring("session_id", 2, 20).cast("long")
    some = ((number * 31 + F.col("uuid").cast("long")) % 7 == 0) | (number % 9 == 0)
    return all_turns.where(some).select(F.col("id").alias("turn_id"), (number * 1000 + F.col("uuid").cast("long")).cast("double").alias("hidden_at"))


HIDDEN = "hidden AS (SELECT id AS turn_id, (conv_id * 1000 + turn)::DOUBLE AS hidden_at FROM turns WHERE (conv_id * 31 + turn) % 7 = 0 OR conv_id % 9 = 0)"


def titles(all_turns: DataFrame) -> DataFrame:
    number = F.substring("session_id", 2, 20).cast("long")
    rows = all_turns.select("session_id").distinct()
    return rows.where(number % 5 == 0).select("session_id", F.when(number % 10 == 0, "").otherwise(F.concat(F.lit("named "), F.col("session_id"))).alias("title"))


TITLES = "titles AS (SELECT DISTINCT session_id, CASE WHEN conv_id % 10 = 0 THEN '' ELSE 'named ' || session_id END AS title FROM turns WHERE conv_id % 5 = 0)"


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """Regions are top folders, nations lie in them; some have no position."""
    top = table(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("double").alias("position"))
    below = table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 101).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"),
        F.when(F.col("n_nationkey") % 2 == 0, (F.lit(50) - F.col("n_nationkey")).cast("double")).alias("position"),
    )
    return top.union(below)


FOLDERS = """folders AS (SELECT (r_regionkey + 1)::BIGINT AS id, r_name AS name, NULL::BIGINT AS parent_id, NULL::DOUBLE AS position FROM region
  UNION ALL SELECT (n_nationkey + 101)::BIGINT, n_name, (n_regionkey + 1)::BIGINT, CASE WHEN n_nationkey % 2 = 0 THEN (50 - n_nationkey)::DOUBLE END FROM nation)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Customers put sessions, or single turns, into their nation's folder."""
    key = F.col("c_custkey")
    turn = key % 3 == 0
    ref = F.concat(F.lit("c"), (key % 97).cast("string"), F.when(turn, ":1").otherwise(""))
    rows = table(spark, sf, "customer").select((F.col("c_nationkey") + 101).cast("long").alias("folder_id"), F.when(turn, "turn").otherwise("session").alias("kind"), ref.alias("ref"))
    return rows.distinct().withColumn("alias", F.when(F.col("ref").endswith("5"), F.concat(F.lit("my "), F.col("ref"))))


ITEMS = """items AS (SELECT DISTINCT (c_nationkey + 101)::BIGINT AS folder_id, CASE WHEN c_custkey % 3 = 0 THEN 'turn' ELSE 'session' END AS kind,
  'c' || (c_custkey % 97) || CASE WHEN c_custkey % 3 = 0 THEN ':1' ELSE '' END AS ref FROM customer),
item AS (SELECT *, CASE WHEN ends_with(ref, '5') THEN 'my ' || ref END AS alias FROM items)"""


def sql(*parts: str, recursive: bool = False) -> str:
    """WITH and a query; the last part is the query."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts[:-1])}\n{parts[-1]}"
