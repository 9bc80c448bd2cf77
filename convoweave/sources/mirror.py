"""A mirror of raw logs: the bytes that each look at a file found new, as rows that put together give the file again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CONFLICT = r"\.sync-conflict-\d{8}-\d{6}-"


def new_parts(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """path, start, end, generation and bytes that are not mirrored yet; a file that has shrunk starts a new generation.

    cursors: path, mirrored, generation. Copies that a synchronisation conflict made are left out.
    """
    rows = files.where(~F.col("path").rlike(CONFLICT)).join(cursors, "path", "left")
    shrunk = F.coalesce(F.col("mirrored") > F.col("length"), F.lit(False))
    start = F.when(shrunk, F.lit(0)).otherwise(F.coalesce("mirrored", F.lit(0))).cast("long")
    generation = F.coalesce("generation", F.lit(0)) + shrunk.cast("int")
    parts = rows.select("path", start.alias("start"), F.col("length").alias("end"), generation.alias("generation"), F.substr("content", (start + 1).cast("int")).alias("bytes"))
    return parts.where(F.col("end") > F.col("start"))


def cursors_of(parts: DataFrame) -> DataFrame:
    """path, mirrored and generation after `parts`."""
    return parts.groupBy("path").agg(F.max(F.struct("generation", "end")).alias("m")).select("path", F.col("m.end").alias("mirrored"), F.col("m.generation").alias("generation"))


def restored(parts: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """path, content and intact of each file's last generation; files that are `present` (path) are left alone.

    intact: the parts follow each other without a gap. A file's parts meet in one row, as the file itself did.
    """
    last = parts.groupBy("path").agg(F.max("generation").alias("generation"))
    rows = parts.join(last, ["path", "generation"], "left_semi")
    if present is not None:
        rows = rows.join(present.select("path"), "path", "left_anti")
    each = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "bytes"))).alias("p"))
    follows = F.aggregate("p", F.lit(0).cast("long"), lambda at, x: F.when(x["start"] == at, x["end"]).otherwise(F.lit(-1)))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
    return each.select("path", whole.alias("content"), (follows >= 0).alias("intact"))
