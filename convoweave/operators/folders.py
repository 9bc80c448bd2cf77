"""Folders: a tree of names with turns and sessions in it.

folders: id, name, parent_id, position. items: folder_id, kind (turn or session), ref, added_at, alias, position.
Paths are made level by level with joins that end when no folder is left; a cycle ends where a path meets itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from convoweave.functions.ordering import running_sum
from convoweave.functions.text import filled
from convoweave.operators.sessions import headline
from convoweave.session import cut


def sibling_order(prefix: str = "") -> list:
    return [F.col(f"{prefix}position").asc_nulls_last(), F.col(f"{prefix}name"), F.col(f"{prefix}id")]


def paths(folders: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root, id, path (ids from the root down) and depth, for every folder below `roots` (id; default: those without parent)."""
    known = folders.select(F.col("id").alias("_known"))
    if roots is None:
        top = folders.join(known, F.col("parent_id") == F.col("_known"), "left").where("_known IS NULL").select("id")
    else:
        top = roots.select("id")
    level = cut(top.select(F.col("id").alias("root"), "id", F.array("id").alias("path"), F.lit(0).alias("depth")))
    children = folders.select(F.col("id").alias("child"), F.col("parent_id").alias("id"))
    found = level
    while True:
        level = level.join(children, "id").where(~F.array_contains("path", F.col("child")))
        level = cut(level.select("root", F.col("child").alias("id"), F.concat("path", F.array("child")).alias("path"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            return found
        found = found.union(level)


def listed(folders: DataFrame, items: DataFrame) -> DataFrame:
    """Folders with their number of items and place among all, by position (missing last), name, id."""
    counts = items.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n_items"))
    rows = folders.join(counts, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return rows.select("id", "name", "parent_id", "position", "n_items")


def turns_in(folders: DataFrame, items: DataFrame, turns: DataFrame, folder_id: int) -> DataFrame:
    """id of the turns in a folder and below: those that items name, even if they are gone, and those of named sessions."""
    inside = paths(folders, folders.where(F.col("id") == folder_id)).select(F.col("id").alias("folder_id"))
    mine = items.join(inside, "folder_id", "left_semi")
    direct = mine.where("kind = 'turn'").select(F.col("ref").alias("id"))
    sessions = mine.where("kind = 'session'").select(F.col("ref").alias("session_id")).distinct()
    return direct.union(turns.join(sessions, "session_id", "left_semi").select("id")).distinct()


def items_of(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Items with headline (alias, else that of the turn or of the session's first turn) and n_turns; gone refs have none."""
    about = turns.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by(headline(), F.struct("timestamp", "id")).alias("h")).withColumn("kind", F.lit("session"))
    each = turns.select(F.lit("turn").alias("kind"), F.col("id").alias("ref"), F.lit(1).cast("long").alias("n"), headline().alias("h"))
    known = about.select("kind", F.col("session_id").alias("ref"), "n", "h").union(each)
    rows = items.join(known, ["kind", "ref"], "left")
    return rows.select("folder_id", "kind", "ref", F.coalesce(filled(F.col("alias")), F.col("h"), F.lit("")).alias("headline"), F.coalesce("n", F.lit(0)).alias("n_turns"))


def folders_of(items: DataFrame, kind: str, ref: str) -> DataFrame:
    return items.where((F.col("kind") == kind) & (F.col("ref") == ref)).select("folder_id").distinct()


def breadcrumbs(folders: DataFrame) -> DataFrame:
    """id and crumbs: the names from the root down."""
    names = folders.select("id", "name")
    each = paths(folders).select("id", F.posexplode("path").alias("place", "of"))
    named = each.join(names.select(F.col("id").alias("of"), "name"), "of")
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " / ").alias("crumbs"))


def flattened(folders: DataFrame) -> DataFrame:
    """id, depth and place in pre-order: siblings by position, name and id; folders with an unknown parent are roots."""
    placed = folders.withColumn("_nth", F.row_number().over(Window.partitionBy("parent_id").orderBy(*sibling_order())))
    known = folders.select(F.col("id").alias("_known"))
    orphan = F.col("parent_id").isNotNull() & F.col("_known").isNull()
    nth = placed.join(known, F.col("parent_id") == F.col("_known"), "left").select(F.col("id").alias("of"), F.struct(orphan, F.col("_nth"), F.col("id")).alias("key"))
    each = paths(folders).select("id", "depth", F.posexplode("path").alias("level", "of")).join(nth, "of")
    keys = each.groupBy("id", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "key"))), lambda x: x["key"]).alias("keys"))
    return placed_in(keys, [F.col("keys")], "place").select("id", "depth", "place")


def placed_in(rows: DataFrame, order: list, name: str) -> DataFrame:
    """`rows` with their place, from 1, in an order over all of them, by one distributed sort."""
    return running_sum(rows.withColumn("_one", F.lit(1)), order, "_one", name).drop("_one")


def reordered(rows: DataFrame, given: DataFrame) -> DataFrame:
    """`rows` (id, position) with dense positions from 0: the ids of `given` (id, given) first, the rest as they were."""
    order = [F.col("given").asc_nulls_last(), F.col("position").asc_nulls_last(), F.col("id")]
    return placed_in(rows.join(given, "id", "left"), order, "place").select("id", (F.col("place") - 1).cast("double").alias("position"))


def moves(folders: DataFrame) -> DataFrame:
    """id with the siblings before and after it, the folder it would be indented into, and the parent it would leave to."""
    order = Window.partitionBy("parent_id").orderBy(*sibling_order())
    up = folders.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("outdent_to"))
    rows = folders.withColumn("up", F.lag("id").over(order)).withColumn("down", F.lead("id").over(order))
    return rows.join(up, "parent_id", "left").select("id", "up", "down", F.col("up").alias("indent_into"), "outdent_to")


def may_move(folders: DataFrame, folder_id: int, into: int) -> bool:
    """Whether a folder may move into another: not into itself or below itself."""
    return paths(folders, folders.where(F.col("id") == folder_id)).where(F.col("id") == into).isEmpty()


def created(folders: DataFrame, name: str, parent_id: int | None, uid: str, at: float) -> DataFrame:
    """`folders` with a new one, without a position, whose id is the next."""
    last = folders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = last.select((F.col("last") + 1).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(parent_id).cast("long").alias("parent_id"), F.lit(None).cast("double").alias("position"))
    return folders.unionByName(new.withColumn("uid", F.lit(uid)).withColumn("at", F.lit(at)), allowMissingColumns=True).select(*folders.columns)


def moved(folders: DataFrame, folder_id: int, into: int | None, before: int | None = None, at: float | None = None) -> DataFrame | None:
    """`folders` after one moved into another (None: the root), right before a sibling or behind all; None if it may not move there.

    The folders of the new parent get positions from 1, by one distributed rank of them alone, and `at` as their time of change.
    """
    if into is not None and not may_move(folders, folder_id, into):
        return None
    there = F.col("parent_id").eqNullSafe(F.lit(into).cast("long")) & (F.col("id") != folder_id)
    placed = placed_in(folders.where(there).select("id", "position", "name"), sibling_order(), "place").select("id", "place")
    first = placed.agg(F.max(F.when(F.col("id") == F.lit(before).cast("long"), F.col("place"))).alias("found"), (F.coalesce(F.max("place"), F.lit(0)) + 1).alias("behind"))
    row = first.select(F.coalesce("found", "behind").alias("_to")).first()
    place = row["_to"]
    rows = folders.join(placed, "id", "left")
    mine = F.col("id") == folder_id
    position = F.when(mine, F.lit(float(place))).when(F.col("place").isNotNull(), (F.col("place") + (F.col("place") >= place).cast("int")).cast("double")).otherwise(F.col("position"))
    told = {"position": position, "parent_id": F.when(mine, F.lit(into).cast("long")).otherwise(F.col("parent_id"))}
    if "at" in folders.columns and at is not None:
        told["at"] = F.when(mine | F.col("place").isNotNull(), F.lit(at)).otherwise(F.col("at"))
    return rows.select(*(told.get(c, F.col(c)).alias(c) for c in folders.columns))


def deleted(folders: DataFrame, items: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """folders and items without a folder and all below it, and the tombstones (id) of what went."""
    gone = cut(paths(folders, folders.where(F.col("id") == folder_id)).select("id"))
    return folders.join(gone, "id", "left_anti"), items.join(gone.withColumnRenamed("id", "folder_id"), "folder_id", "left_anti"), gone


def added(items: DataFrame, new: DataFrame, at: float) -> DataFrame:
    """`items` with those of `new` (folder_id, kind, ref, place) that are not there, behind the last of their folder, by place."""
    key = ["folder_id", "kind", "ref"]
    last = items.groupBy("folder_id").agg(F.max("position").alias("_last"))
    fresh = new.dropDuplicates(key).join(items.select(*key), key, "left_anti").join(last, "folder_id", "left")
    nth = F.row_number().over(Window.partitionBy("folder_id").orderBy("place", "kind", "ref"))
    rows = fresh.select(*key, F.lit(None).cast("string").alias("alias"), (F.coalesce("_last", F.lit(-1.0)) + nth).cast("double").alias("position"), F.lit(at).alias("at"))
    return items.select(*key, "alias", "position", "at").unionByName(rows)


def removed(items: DataFrame, gone: DataFrame, at: float) -> tuple[DataFrame, DataFrame]:
    """`items` without those of `gone` (folder_id, kind, ref), and tombstones for those that were there."""
    key = ["folder_id", "kind", "ref"]
    return items.join(gone, key, "left_anti"), items.join(gone, key, "left_semi").select(*key, F.lit(at).alias("removed_at"))


def aliased(items: DataFrame, names: DataFrame) -> DataFrame:
    """`items` with the aliases of `names` (folder_id, kind, ref, new_alias); an empty one takes the alias away."""
    rows = items.join(names, ["folder_id", "kind", "ref"], "left")
    return rows.withColumn("alias", F.when(F.col("new_alias").isNotNull(), filled(F.col("new_alias"))).otherwise(F.col("alias"))).drop("new_alias")


def renamed(folders: DataFrame, names: DataFrame) -> DataFrame:
    """`folders` with the names of `names` (id, new_name); empty names change nothing."""
    return folders.join(names, "id", "left").withColumn("name", F.coalesce(filled(F.trim("new_name")), F.col("name"))).drop("new_name")
