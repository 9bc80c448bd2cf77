"""Chunks of turns: pieces of at most 900 characters, cut where paragraphs, lines, sentences or words end."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

#: Where to cut, the best place first; then sizes in characters.
SEPARATORS = ("\n\n", "\n", ". ", "。", "! ", "? ", " ")
CHUNK, OVERLAP, WHOLE = 900, 120, 12_000


def packed(text: str, separator: str, most: int) -> Iterator[str]:
    """The parts of a text between separators, as many in a row as fit into `most` characters; a longer part stands alone."""
    parts = text.split(separator)
    ends = [end - len(separator) for end in accumulate(len(p) + len(separator) for p in parts)]
    at = 0
    while at < len(parts):
        if parts[at]:
            start = ends[at] - len(parts[at])
            after = max(at + 1, bisect_right(ends, start + most, at))
            yield text[start : ends[after - 1]]
            at = after
        else:
            at += 1


def pieces(text: str, most: int = CHUNK) -> list[str]:
    """Pieces of at most `most` characters: one pass for each separator packs what is still too long, what remains is cut."""
    found = [text]
    for separator in SEPARATORS:
        found = [p for whole in found for p in (packed(whole, separator, most) if len(whole) > most else (whole,))]
    return [p[i : i + most] for p in found for i in range(0, len(p) or 1, most)]


def split(text: Column, most: int = CHUNK) -> Column:
    """The pieces of a text column, as an array."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: pieces(t, most) if isinstance(t, str) else [])

    return run(text)


def overlapping(parts: Column, overlap: int = OVERLAP) -> Column:
    """Each piece behind the last characters of the piece before it.

    The outer transform binds the pieces, so that they are made once and not once for each piece.
    """
    tail = lambda x: F.when(F.char_length(x) > overlap, F.substr(x, F.char_length(x) - overlap + 1)).otherwise(x)
    behind = lambda whole: F.transform(whole, lambda p, i: F.when(i == 0, p).otherwise(F.concat(tail(F.get(whole, i - 1)), p)))
    return F.get(F.transform(F.array(parts), behind), F.lit(0))


def hard_cut(text: Column, most: int = CHUNK) -> Column:
    """Pieces of exactly `most` characters, the last one shorter, without leaving the JVM, in one pass over the text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{most}}})"), 1), F.array().cast("array<string>"))


def chunks(turns: DataFrame, text: str = "embed_text", turn_id: str = "id", limit: int | None = WHOLE) -> DataFrame:
    """chunk_key, turn_id, idx and text of the first `limit` characters of texts, or of whole texts without a limit; only texts that are too long for one chunk pass through Python."""
    whole = F.col(text) if limit is None else F.substring(text, 1, limit)
    rows = turns.select(F.col(turn_id).alias("turn_id"), whole.alias("_text")).where(F.trim("_text") != "")
    long = F.char_length("_text") > CHUNK
    short = rows.where(~long).select("turn_id", F.lit(0).alias("idx"), F.col("_text").alias("text"))
    cut = rows.where(long).withColumn("_parts", split(F.col("_text")))
    cut = cut.select("turn_id", F.posexplode(overlapping(F.col("_parts"))).alias("idx", "text"))
    return short.union(cut).select(F.concat("turn_id", F.lit("#"), F.col("idx").cast("string")).alias("chunk_key"), "turn_id", "idx", "text")


def trimmed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """`stored` chunks without those beyond what `fresh` has for the same turn."""
    kept = fresh.groupBy("turn_id").agg(F.max("idx").alias("_last"))
    return stored.join(kept, "turn_id", "left").where("_last IS NULL OR idx <= _last").drop("_last")
