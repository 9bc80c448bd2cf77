"""Enrichment: summaries and tags that an injected function writes for batches of turns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from convoweave.functions.text import rendered, squeeze
from convoweave.operators.sessions import batches

Backend = Callable[[Sequence[dict]], str]
REPLY = "id string, summary string, tags array<string>"


def prompt_line(place: Column) -> Column:
    """A turn as a line of a prompt: number, question and answer (400 characters each), actions (150)."""
    return F.concat_ws(
        "\n", F.concat(F.lit("["), place.cast("string"), F.lit("] Q: "), squeeze(F.col("question"), 400)), F.concat(F.lit("A: "), squeeze(F.col("answer"), 400)),
        F.when(F.size("actions") > 0, F.concat(F.lit("actions: "), squeeze(F.array_join(rendered(F.col("actions")), "; "), 150))),
    )


def extractive(rows: Sequence[dict]) -> str:
    """A backend without a model: the first sentence of the question, and its longest words as tags."""
    out = []
    for r in rows:
        first = re.split(r"(?<=[.!?])\s", " ".join((r["question"] or "").split()))[0][:80]
        words = sorted({w.lower() for w in re.findall(r"\w{4,}", r["question"] or "")}, key=lambda w: (-len(w), w))
        out.append({"id": r["id"], "summary": first, "tags": words[:3]})
    return json.dumps(out, ensure_ascii=False)


def parsed(reply: str) -> list[dict]:
    """The entries of a reply that may have prose or fences around its JSON list."""
    found = re.search(r"\[.*\]", reply or "", re.S)
    try:
        entries = json.loads(found[0]) if found else []
    except ValueError:
        return []
    return [e for e in entries if isinstance(e, dict) and e.get("id")]


def enriched(turns: DataFrame, backend: Backend = extractive, size: int = 20) -> DataFrame:
    """id, summary and tags for turns without summary; each batch of a session is one call, made in a task."""
    rows = batches(turns, size).select("id", "session_id", "batch").join(turns.select("id", "timestamp", "question", "answer"), "id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = group.sort_values(["timestamp", "id"]).to_dict("records")
        known = {r["id"] for r in asked}
        made = [e for e in parsed(backend(asked)) if e["id"] in known]
        tags = [[str(t) for t in e["tags"]] if isinstance(e.get("tags"), list) else [] for e in made]
        return pd.DataFrame({"id": [e["id"] for e in made], "summary": [str(e.get("summary") or "") for e in made], "tags": tags})

    return rows.groupBy("session_id", "batch").applyInPandas(run, REPLY)


def applied(turns: DataFrame, made: DataFrame) -> DataFrame:
    """`turns` with summary and tags of those in `made`; ids that are not there are ignored."""
    new = made.select("id", F.col("summary").alias("_s"), F.col("tags").alias("_t"))
    return turns.join(new, "id", "left").withColumn("summary", F.coalesce("_s", "summary")).withColumn("tags", F.coalesce("_t", "tags")).drop("_s", "_t")
