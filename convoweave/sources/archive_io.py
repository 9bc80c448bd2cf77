"""Snapshots between devices, exports, and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from convoweave.functions.ordering import running_sum

#: The cells of the lines that carry settings, the time of change last.
SETTINGS = {
    "title": {"session_id": "string", "title": "string", "at": "double"},
    "fold": {"turn_id": "string", "folded": "int", "at": "double"},
    "folder": {"uid": "string", "name": "string", "parent_uid": "string", "position": "double", "at": "double"},
    "fitem": {"folder_uid": "string", "kind": "string", "ref": "string", "alias": "string", "position": "double", "at": "double"},
    "folder_x": {"uid": "string", "at": "double"},
    "fitem_x": {"folder_uid": "string", "kind": "string", "ref": "string", "at": "double"},
}
KINDS = ("t", *SETTINGS)
CELLS = {kind: len(cells) for kind, cells in SETTINGS.items()}


#: The cells of a turn's line, in their order; those that are no texts; how many the oldest lines have.
TURN_CELLS = ("id", "session_id", "uuid", "parent_uuid", "timestamp", "project", "question", "answer", "actions", "summary", "tags", "source", "source_file", "queued", "parser_version")
NUMBERS = {"queued": "int", "parser_version": "int"}
OLDEST_CELLS = 11


def json_text(text: Column) -> Column:
    """A text as a JSON string; null as null."""
    array = F.to_json(F.array(text.cast("string")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_extract(array, r"(?s)^\[(.*)\]$", 1))


def snapshot_lines(turns: DataFrame, chunks: DataFrame) -> DataFrame:
    """value: a line for each turn (its cells, and its chunks in order) of a device snapshot; cells that `turns` lacks are null."""
    pair = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit(","), json_text(F.col("text")), F.lit("]"))
    mine = chunks.groupBy(F.col("turn_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("idx", pair.alias("pair")))).alias("_c"))
    kinds = {f.name: f.dataType for f in turns.schema}
    cells = []
    for c in TURN_CELLS:
        if c in NUMBERS:
            value = F.coalesce(F.col(c).cast("int").cast("string"), F.lit("0" if c == "parser_version" else "null")) if c in kinds else F.lit("0" if c == "parser_version" else "null")
        elif c not in kinds:
            value = F.lit("null")
        else:
            value = json_text(F.to_json(c) if isinstance(kinds[c], (T.ArrayType, T.StructType)) else F.col(c))
        cells.append(value)
    pairs = F.transform(F.coalesce("_c", F.array().cast("array<struct<idx:int,pair:string>>")), lambda c: c["pair"])
    line = F.concat(F.lit('{"t":['), F.concat_ws(",", *cells), F.lit('],"c":['), F.array_join(pairs, ","), F.lit("]}"))
    return turns.join(mine, F.col("id") == F.col("_id"), "left").select(line.alias("value"))


def setting_lines(kind: str, rows: DataFrame) -> DataFrame:
    """value: a line for each row of a kind of SETTINGS; cells that are null are null."""
    cells = [json_text(F.col(c)) if t == "string" else F.coalesce(F.col(c).cast(t).cast("string"), F.lit("null")) for c, t in SETTINGS[kind].items()]
    return rows.select(F.concat(F.lit(f'{{"{kind}":['), F.concat_ws(",", *cells), F.lit("]}")).alias("value"))


def settings_of(lines: DataFrame, kind: str) -> DataFrame:
    """The rows of a kind of SETTINGS in valid snapshot lines."""
    given = F.from_json(F.get_json_object("line", f"$.{kind}"), "array<string>")
    cells = [F.get(given, k).try_cast(t).alias(c) for k, (c, t) in enumerate(SETTINGS[kind].items())]
    return lines.where(F.col("valid") & (F.col("kind") == kind)).select(*cells)


def write_snapshot(turns: DataFrame, chunks: DataFrame, path: str, settings: dict[str, DataFrame] | None = None) -> None:
    """Writes a snapshot folder, with the lines of `settings` (by kind); Spark's committer makes it visible as a whole."""
    lines = snapshot_lines(turns, chunks)
    for kind, rows in (settings or {}).items():
        lines = lines.union(setting_lines(kind, rows))
    lines.write.mode("overwrite").text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """line, kind and valid: of each line of a snapshot; invalid ones are for quarantine."""
    return parsed(spark.read.text(path))


def parsed(lines: DataFrame) -> DataFrame:
    """line, kind and valid, from the lines (value) of a snapshot."""
    rows = lines.withColumnRenamed("value", "line")
    key = F.json_object_keys("line")[0]
    kind = F.when(key.isin(*KINDS), key)
    count = F.json_array_length(F.get_json_object("line", "$.t"))
    n = lambda k: F.json_array_length(F.get_json_object("line", f"$.{k}"))
    clock = lambda k: F.get_json_object("line", f"$.{k}[{CELLS[k] - 1}]").try_cast("double").isNotNull()
    valid = F.when(kind == "t", count.between(OLDEST_CELLS, len(TURN_CELLS)) & (F.get_json_object("line", "$.t[0]") != "") & (n("c") >= 0))
    for k in CELLS:
        valid = valid.when(kind == k, (n(k) == CELLS[k]) & clock(k))
    return rows.withColumn("kind", kind).withColumn("valid", F.coalesce(valid, F.lit(False)) & F.try_parse_json("line").isNotNull())


def snapshot_turns(lines: DataFrame) -> DataFrame:
    """The turns of valid snapshot lines; cells that older lines lack are null."""
    given = F.from_json(F.get_json_object("line", "$.t"), "array<string>")
    cells = [F.get(given, k) for k in range(len(TURN_CELLS))]
    flag = lambda c: F.when(F.lower(c).isin("1", "true"), True).when(F.lower(c).isin("0", "false"), False)
    read = {"queued": flag, "parser_version": lambda c: c.try_cast("int"), "tags": lambda c: F.from_json(c, "array<string>")}
    return lines.where("valid AND kind = 't'").select(*(read.get(c, lambda x: x)(v).alias(c) for c, v in zip(TURN_CELLS, cells, strict=True)))


def snapshot_chunks(lines: DataFrame) -> DataFrame:
    """turn_id, idx and text of the chunks in valid snapshot lines."""
    rows = lines.where("valid AND kind = 't'").select(F.get_json_object("line", "$.t[0]").alias("turn_id"), F.explode(F.from_json(F.get_json_object("line", "$.c"), "array<string>")).alias("pair"))
    return rows.select("turn_id", F.get_json_object("pair", "$[0]").cast("int").alias("idx"), F.get_json_object("pair", "$[1]").alias("text"))


def markdown(turns: DataFrame, hidden: DataFrame, title: Column | None = None) -> DataFrame:
    """session_id and document: each session as Markdown, without hidden turns."""
    kept = turns.join(hidden.select(F.col("turn_id").alias("id")), "id", "left_anti")
    part = F.concat(F.lit("## "), F.col("timestamp"), F.lit("\n\n**Q:** "), F.col("question"), F.lit("\n\n**A:** "), F.col("answer"))
    rows = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", part.alias("text")))).alias("p"))
    head = title if title is not None else F.col("session_id")
    return rows.select("session_id", F.concat(F.lit("# "), head, F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("document"))


def quota_victims(files: DataFrame, most: int) -> DataFrame:
    """Files (path, size, modified) to delete, oldest first, so that the newest fit in `most` bytes."""
    kept = running_sum(files, [F.desc("modified"), F.desc("path")], "size")
    return kept.where(F.col("total") > most).select("path", "size", "modified")
