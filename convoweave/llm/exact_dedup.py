"""Exact deduplication by a content sort, with DataFrame operations alone.

Splitters sampled by Spark range-partition the normalised texts, each partition is sorted externally by the whole text,
and the window over equal texts compares neighbouring rows in full and keeps the smallest identifier. The splitters are
the first PREFIX characters of the text, then its SHA-256, so that the sample the driver takes stays small however long
the texts are, and texts that begin alike spread over ranges; the sort and the comparison go over the whole text.

A text with many copies would fill one range. Such texts are counted first (partial sums, so a group reaches the shuffle
as one row per task), and their copies are dealt over pieces of about PIECE rows. The pieces of one text
are put together by a comparison of their whole texts: the least and the greatest must be equal. The table of such texts
is broadcast if its counted rows are few, else joined by salted keys.

Defined results: null counts as empty; of repeated rows with the kept identifier one is kept; null identifiers
come last in a group; an empty table gives an empty result; extra columns are ignored, whatever their names. Two different
texts of one SHA-256 and over PIECE copies would stop the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from convoweave.llm.rows import kept_rows, salted_join
from convoweave.session import cut, settings, table

PREFIX = 128  # characters of the text that the splitters see
BUFFERED = "128"
PIECE = 1000  # a text with more copies is dealt over pieces of about so many


def normalised(text: str = "text"):
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("_text")).withColumn("text_sha256", F.sha2("_text", 256))
    rows = rows.withColumn("_deal", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    hot = rows.groupBy("text_sha256").agg(F.count("*").alias("_n")).where(F.col("_n") > piece)
    hot = cut(hot.select(F.col("text_sha256").alias("_hot"), F.ceil(F.col("_n") / piece).alias("_pieces")))
    dealt = salted_join(rows, hot, F.col("text_sha256") == F.col("_hot"), F.col("_deal"), hot.count(), 128)
    dealt = dealt.withColumn("_piece", F.coalesce(F.pmod("_deal", "_pieces"), F.lit(0)))
    key = [F.substring("_text", 1, PREFIX), F.col("text_sha256"), F.col("_piece")]
    same = Window.partitionBy("_text", *key).orderBy(F.col("doc_id").asc_nulls_last())
    whole_run = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(same)
    found = dealt.repartitionByRange(*key).select(
        "doc_id", "text_sha256", "_piece", F.min("doc_id").over(whole_run).alias("_keep"), F.count("*").over(whole_run).alias("_size"), place.alias("_place"),
        F.when(F.col("_hot").isNotNull() & (place == 1), F.col("_text")).alias("_head"),
    )
    # Beyond some rows, a group's texts go from plain buffers to memory that Spark manages and spills.
    with settings(docs.sparkSession, spark__sql__windowExec__buffer__in__memory__threshold=BUFFERED):
        found = cut(found)
    whole = found.where("_head IS NOT NULL").groupBy(F.col("text_sha256").alias("_hot")).agg(
        F.min(F.struct(F.col("_keep").isNull().alias("none"), "_keep", "_piece")).alias("_first"), F.sum("_size").alias("_all_size"), (F.min("_head") == F.max("_head")).alias("_alike")
    )
    whole = whole.withColumn("_all_size", F.when(F.col("_alike"), F.col("_all_size")).otherwise(F.raise_error(F.lit("two texts of one SHA-256")).cast("long"))).drop("_alike")
    put = salted_join(found.drop("_head"), cut(whole), F.col("text_sha256") == F.col("_hot"), F.xxhash64("doc_id", "_place"), hot.count(), 128)
    keep = F.coalesce("_first._keep", "_keep")
    return put.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_all_size", "_size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("_place") == 1) & (F.col("_piece") == F.coalesce("_first._piece", "_piece"))).alias("kept"), "text_sha256",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and others) with one row of each group of equal texts, the one with the smallest doc_id."""
    told = exact_groups(docs).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return kept_rows(docs, F.sha2(normalised(), 256), told)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all of `documents`."""
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""
}
