"""Log files read by byte ranges, so that a file of any size is read by many tasks in bounded memory.

A file is cut into ranges of RANGE bytes. A line belongs to the range in which it begins: a range that does not begin at a
line's start leaves its first, partial line to the range before, and reads its last line to its end. Offsets are those of the
file. A line without a line end at the end of a file is held back. A task holds READ bytes and the line that it is in.

Paths are opened in the tasks: local and mounted ones, and those of the stores that pyarrow knows (`readable`). Files of other
stores are read whole, by `transcripts.lines`.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, functions as F

from convoweave.session import cut

RANGE, READ, ROWS = 16 << 20, 1 << 20, 4096
TASKS = 100_000  # at most; beyond, a task reads several ranges
SCHEMES = ("", "file", "s3", "s3a", "gs", "abfs", "abfss", "hdfs")
LINES = "file string, offset long, end_offset long, line string"


def readable(root: str) -> bool:
    """Whether tasks can open the files below `root` themselves."""
    return urlsplit(root).scheme in SCHEMES


def opened(path: str) -> pa.NativeFile:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pa.OSFile(unquote(parts.path) if parts.scheme else path)
    files, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return files.open_input_file(inner)


def raw_lines(path: str, begin: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """Start and bytes (without the line end) of the complete lines that begin in a range; first: it begins at a line's start."""
    with opened(path) as f:
        at = begin if first else begin - 1
        f.seek(at)
        skip, parts, start = not first, [], at
        while data := f.read(READ):
            *whole, rest = data.split(b"\n")
            for piece in whole:
                at += len(piece) + 1
                if not skip:
                    yield start, b"".join([*parts, piece])
                skip, parts, start = False, [], at
                if start >= end:
                    return
            at += len(rest)
            if not skip:
                parts.append(rest)
            elif at >= end:  # no line begins in this range
                return


def batches_of(path: str, begin: int, end: int, first: bool) -> Iterator[pa.RecordBatch]:
    """The lines of a range that are not blank, as LINES; bytes that are no UTF-8 become U+FFFD."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        starts, ends, texts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts)], ["file", "offset", "end_offset", "line"])

    for start, raw in raw_lines(path, begin, end, first):
        if raw.strip():
            held.append((start, start + len(raw) + 1, raw.decode("utf-8", "replace")))
            size += len(raw)
        if len(held) == ROWS or size > READ:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def ranges(found: DataFrame, start: Column | None = None, size: int = RANGE) -> DataFrame:
    """path, begin, end and first: the ranges of files (path, length) from `start`, which is a line's start."""
    at = (F.lit(0) if start is None else start).cast("long")
    rows = found.select("path", F.col("length").cast("long").alias("length"), at.alias("start")).where("start < length")
    each = rows.select("path", "length", "start", F.explode(F.sequence(F.col("start"), F.col("length") - 1, F.lit(size).cast("long"))).alias("begin"))
    return each.select("path", "begin", F.least(F.col("begin") + size, F.col("length")).alias("end"), (F.col("begin") == F.col("start")).alias("first"))


def lines(found: DataFrame, start: Column | None = None, size: int = RANGE, failures: bool = False) -> DataFrame:
    """file, offset, end_offset and line, for the complete lines of `found` (path, length) that are not blank.

    failures: with error, null but for a row without a line for each range that cannot be read; without, such a range fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    for read in batches_of(r["path"], r["begin"], r["end"], r["first"]):
                        yield read.append_column("error", pa.nulls(read.num_rows, pa.string())) if failures else read
                except OSError as e:
                    if not failures:
                        raise
                    row = {"file": r["path"], "offset": r["begin"], "end_offset": None, "line": None, "error": f"{type(e).__name__}: {e}"[:500]}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("offset", pa.int64()), ("end_offset", pa.int64()), ("line", pa.string()), ("error", pa.string())]))

    # Ranges are dealt one by one, however few files they come from; a number keeps adaptive execution from joining them again. They are
    # checkpointed, so that lines are taken to be as large as their files and not, after a shuffle, as their ranges: those would be broadcast.
    asked = ranges(found, start, size)
    dealt = cut(asked.repartition(max(1, min(asked.count(), TASKS))))
    return dealt.mapInArrow(run, f"{LINES}, error string" if failures else LINES)
