"""Turns from a stream of records: the open turn of a file is state until the next one starts or the file is idle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "id string, session_id string, file string, offset long, timestamp string, question string, answer string, closed boolean"
STATE = "session_id string, offset long, timestamp string, question string, answer string"
IDLE_MS = 120_000


def stream_turns(records: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Turns of a stream of records (file, offset, session_id, timestamp, starts, question, answer).

    A turn comes out closed when the file's next turn starts, and open when the file has been idle; later records of
    an open turn bring it out again, whole, so a sink replaces by id. A micro-batch sorts each file's records by offset.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file, done = key[0], []
        current = list(state.get) if state.exists else None

        def put(closed: bool) -> None:
            session, offset, at, question, answer = current
            done.append((f"{session}:{offset}", session, file, offset, at, question, answer.strip(), closed))

        if state.hasTimedOut:
            put(False)
        else:
            rows = pd.concat(list(batches)).sort_values("offset")
            for r in rows.itertuples(index=False):
                if r.starts:
                    if current:
                        put(True)
                    current = [r.session_id, int(r.offset), r.timestamp, (r.question or "").strip(), ""]
                elif current and isinstance(r.answer, str) and r.answer:
                    current[4] = f"{current[4]}\n{r.answer}" if current[4] else r.answer
            if current:
                state.update(tuple(current))
                state.setTimeoutDuration(idle_ms)
        if done:
            yield pd.DataFrame(done, columns=["id", "session_id", "file", "offset", "timestamp", "question", "answer", "closed"])

    light = records.select("file", "offset", "session_id", "timestamp", "starts", "question", "answer")
    return light.groupBy("file").applyInPandasWithState(step, TURN, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def keep_latest(turns: DataFrame, path: str, checkpoint: str, upsert: Callable[[DataFrame, DataFrame], DataFrame], every: str | None = None) -> StreamingQuery:
    """Writes a stream of turns into versioned tables below `path`: each batch makes the next version by `upsert`.

    every: a trigger interval, at which idle turns come out too; without it the stream reads what is there and ends
    (then batches without data are off, since pending timeouts would go on for ever).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}") if number else batch.limit(0)
        upsert(before, batch).write.mode("overwrite").parquet(f"{path}/{number}")

    writer = turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    turns.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return writer.trigger(availableNow=True).start()
