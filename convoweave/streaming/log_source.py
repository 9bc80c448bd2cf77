"""A stream over growing log files: every file's offset is kept, appended lines come once, and a batch is bounded.

Spark's own file source takes a file once; what is appended later never comes. This source's offset is a map from file to
the byte after its last complete line. A batch takes `maxBytesPerTrigger` at most over all files (a longer line is
taken whole), oldest files first, and is read by ranges in tasks. A file that is shorter than its offset has
been replaced and is read from its beginning.

What is planned is noted below `progress` before Spark logs it, so that after a restart batches stay bounded; the offsets that
count are those of the query's checkpoint. Records go through `turn_stream.stream_turns`, whose state holds each file's
open turn, so a batch may end anywhere between two lines.

    spark.dataSource.register(GrowingLogs)
    lines = spark.readStream.format("growing_logs").option("path", root).option("progress", folder).load()
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from convoweave.sources.ranged import LINES, RANGE, READ, batches_of, opened

LIMIT = 256 << 20


class Piece(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: bool):
        self.path, self.begin, self.end, self.first = path, begin, end, first


def last_line_end(path: str, begin: int, end: int) -> int:
    """The byte after the last line end from `begin` to before `end`; `begin` if there is none. Reads backwards, block by block."""
    with opened(path) as f:
        while end > begin:
            at = max(begin, end - READ)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return begin


def first_line_end(path: str, begin: int, size: int) -> int:
    """The byte after the first line end from `begin` on; `begin` if there is none."""
    with opened(path) as f:
        f.seek(begin)
        at = begin
        while at < size and (data := f.read(READ)):
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
    return begin


class GrowingLogs(DataSource):
    """Options: path, pattern (of file names), maxBytesPerTrigger, rangeBytes, progress (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


class LogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.limit, self.size = int(options.get("maxBytesPerTrigger", LIMIT)), int(options.get("rangeBytes", RANGE))
        self.note = Path(options["progress"]) / "planned.json"
        self.at: dict[str, int] = json.loads(self.note.read_text()) if self.note.exists() else {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        planned, left = dict(self.at), self.limit
        for path, size in self._files():
            begin = planned.get(path, 0)
            begin = 0 if begin > size else begin
            if left <= 0 or begin == size:
                continue
            end = last_line_end(path, begin, min(size, begin + left))
            if end == begin and size > begin + left and left == self.limit:
                end = first_line_end(path, begin, size)  # a line beyond the limit
            if end != planned.get(path, 0):
                planned[path] = end
                left -= end - begin
        self.note.parent.mkdir(parents=True, exist_ok=True)
        spare = self.note.with_suffix(".new")
        spare.write_text(json.dumps(planned))
        os.replace(spare, self.note)
        self.at = planned
        return planned

    def _files(self) -> list[tuple[str, int]]:
        """Paths and sizes, the least lately changed first."""
        found = []
        for folder, _, names in os.walk(self.root):
            for name in fnmatch.filter(names, self.pattern):
                told = os.stat(os.path.join(folder, name))
                found.append((told.st_mtime, os.path.join(folder, name), told.st_size))
        return [(path, size) for _, path, size in sorted(found)]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = {**self.at, **end}
        pieces = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = 0 if begin > stop else begin
            pieces += [Piece(path, k, min(k + self.size, stop), k == begin) for k in range(begin, stop, self.size)]
        return pieces or [Piece("", 0, 0, True)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from batches_of(partition.path, partition.begin, partition.end, partition.first)
