"""Mixing sources to target weights by Sainte-Lague apportionment of equal-word blocks.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words of the corpus by
weight; a target stops at REPEATS times its source's words, and the excess is shared again by weight. That is
`least(weight * x, REPEATS * size)` for one x, found by running sums over the table of sources.

Quotas: all words make blocks of `block` words. The blocks go to sources, and a source's blocks to its shards
(documents dealt by hash, about `shard` words each), one by one to the highest quotient target / (2 k + 1), k being
what it has. Only quotients that can still matter are sorted: an allocation by divisors gives everyone its share of
between N - n/2 and N + n/2 blocks, so the rest is sure to be had or sure to be missed.

Selection: a shard's documents, in the order of a seeded hash, make one line of words, cut into blocks. Its quota is
spread over the blocks from a seeded start, so that two blocks differ by one repeat at most; a document takes the
words of its blocks. No text is moved to decide any of this, and a rerun decides alike.

Defined results: null texts have size 0 and take nothing; rows without an identifier, and rows whose identifier stands
there again, are dealt by their place among such rows and taken like others; repeated rows count each; empty tables give empty results; extra columns are ignored (`mixed` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from convoweave.functions.ordering import running_sum
from convoweave.llm.rows import ranked, salted_join, small_or_shuffled
from convoweave.session import cut, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 128
SHARD = 1_000_000
SPARE = 8
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def drawn(*parts: Column) -> Column:
    """A number below 2^32 that the seed and the parts fix."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """`sources` (rank, source_size) with weight and target.

    Sources reach their limit in the order of limit / weight; the x at which all words are shared is the greatest of
    (words less the limits reached) / (weights of the others), over the places in that order.
    """
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    weighed = weighed.withColumn("_limit", F.col("source_size") * REPEATS)
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    if not total:
        return weighed.withColumn("target", F.lit(0.0)).drop("_limit")
    order = [F.col("_limit") / F.col("weight"), F.col("rank")]
    summed = running_sum(running_sum(weighed, order, "_limit", "_above"), order, "weight", "_gone")
    left = F.lit(total) - (F.col("_above") - F.col("_limit"))
    x = summed.agg(F.max(left.cast("double") / (F.lit(weight) - (F.col("_gone") - F.col("weight"))).cast("double"))).first()[0]
    return weighed.withColumn("target", F.least(F.lit(x) * F.col("weight"), F.col("_limit").cast("double"))).drop("_limit")


def open_quotients(share: Column, seats: Column, rivals: Column, size: Column) -> tuple[Column, Column]:
    """The seats that are sure for a share of all, and the indexes (k) of those that quotients decide."""
    low = F.greatest(F.lit(0), F.floor(share * (seats - rivals / 2) - 0.5)).cast("long")
    high = F.ceil(share * (seats + rivals / 2) + 1.5).cast("long")
    return low, F.when(size > 0, F.sequence(low, F.greatest(low, high)))


def source_quotas(sources: DataFrame, block: int) -> DataFrame:
    """`sources` with quota: their blocks by Sainte-Lague."""
    total, n = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.when(F.col("target") > 0, 1))).first()
    if not total:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    seats = int(total / block + 0.5)
    low, ks = open_quotients(F.col("target") / total, F.lit(seats), F.lit(n), F.col("target"))
    sure = sources.withColumn("_sure", F.when(F.col("target") > 0, low).otherwise(0))
    left = seats - sure.agg(F.sum("_sure")).first()[0]
    tried = sources.select("rank", "target", F.explode(ks).alias("k"))
    order = [(F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("rank"), F.col("k")]
    won = ranked(tried, order, "place").where(F.col("place") < left).groupBy("rank").count()
    return sure.join(won, "rank", "left").withColumn("quota", F.col("_sure") + F.coalesce("count", F.lit(0))).drop("_sure", "count")


def shard_quotas(cells: DataFrame, n_sources: int, block: int) -> DataFrame:
    """`cells` (rank, shard, words, source_size, quota of the source) with the shard's own quota.

    A shard takes REPEATS times its blocks at most; its further quotients do not stand, so the blocks go to others. Limits
    are the shards' fair shares or more, so SPARE indexes beyond those of an apportionment without limits are enough.
    """
    rivals = small_or_shuffled(cells.groupBy(F.col("rank").alias("_rank")).agg(F.count(F.when(F.col("words") > 0, 1)).alias("_n")), n_sources)
    counted = cells.join(rivals, F.col("rank") == F.col("_rank")).drop("_rank")
    share, limit = F.col("words") / F.col("source_size"), F.ceil(F.col("words") / block) * REPEATS
    low, ks = open_quotients(share, F.col("quota"), F.col("_n"), F.col("words"))
    low, last = F.least(low, limit), F.least(F.element_at(ks, -1) + SPARE, limit - 1)
    counted = cut(counted.withColumn("_sure", F.when(F.col("words") > 0, low).otherwise(0)).withColumn("_last", F.when(F.col("words") > 0, last)))
    sure = counted.groupBy(F.col("rank").alias("_rank")).agg(F.sum("_sure").alias("_all"))
    tried = counted.where("_last >= _sure").select("rank", "shard", "words", "quota", F.explode(F.sequence("_sure", "_last")).alias("k"))
    placed = cut(ranked(tried, [F.col("rank"), (F.col("words") / (2 * F.col("k") + 1)).desc(), F.col("shard"), F.col("k")], "_place"))
    starts = placed.groupBy(F.col("rank").alias("_rank")).agg(F.min("_place").alias("_start"))
    told = small_or_shuffled(sure.join(starts, "_rank"), n_sources)
    won = placed.join(told, F.col("rank") == F.col("_rank")).where(F.col("_place") - F.col("_start") < F.col("quota") - F.col("_all")).groupBy("rank", "shard").count()
    return counted.join(won, ["rank", "shard"], "left").select("rank", "shard", "words", (F.col("_sure") + F.coalesce("count", F.lit(0))).alias("shard_quota"))


def keyed(sized: DataFrame) -> DataFrame:
    """`sized` (doc_id, source, size, mark) with `key`, by which rows are dealt and ordered: the identifier, and of rows
    without one or with one that stands there again also their place among all such rows, so that they spread like others."""
    again = cut(sized.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1 OR _id IS NULL").select("_id"))
    n = again.count()
    plain = sized.withColumn("key", F.col("doc_id").cast("string"))
    if not n:
        return plain
    side, same = small_or_shuffled(again, n), F.col("doc_id").eqNullSafe(F.col("_id"))
    repeated = ranked(sized.join(side, same, "left_semi"), [F.col(c).asc_nulls_first() for c in ("doc_id", "source", "size", "mark")], "_place")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_place")
    return plain.join(side, same, "left_anti").unionByName(repeated.withColumn("key", key).drop("_place"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, carry: bool = False) -> DataFrame:
    """For every row of `docs`: doc_id, size, source_size, target, taken, and how its words are repeated.

    start, blocks, shard_quota, first: the row's first word in its shard's line, the line's blocks, the shard's quota
    and the seeded start; `repeats` tells from these how often a word is taken. With `carry`, the whole row comes along
    as `row`, so that repeated rows and rows without an identifier each have a plan of their own.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(text).alias("mark"), *([F.struct(*names(docs)).alias("row")] if carry else []))
    sizes = cut(sized.select("doc_id", "source", "size", "mark"))
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()])
    sources = cut(source_quotas(targets(cut(sources)), block))
    n = sources.count()
    side = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target", "quota")
    placed = salted_join(keyed(sized if carry else sizes), side, F.col("source").eqNullSafe(F.col("_source")), F.xxhash64("doc_id", "mark"), n, 128)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard))
    placed = placed.withColumn("shard", F.pmod(drawn(F.lit("shard"), F.col("key")), shards)).drop("_source")
    cells = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("quota").alias("quota"))
    quotas = cut(shard_quotas(cells, n, block))
    blocks = F.ceil(F.col("words") / block).cast("long")
    line = Window.partitionBy("rank", "shard").orderBy(drawn(F.lit("order"), F.col("key")), "doc_id", "size", "mark", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(quotas, ["rank", "shard"]).select(
        "doc_id", "source", "size", "source_size", "target", *(["row"] if carry else []), blocks.alias("blocks"), "shard_quota",
        (F.sum("size").over(line) - F.col("size")).alias("start"), F.pmod(drawn(F.lit("first"), F.col("rank"), F.col("shard")), F.greatest(blocks, F.lit(1))).alias("first"),
    )
    return rows.withColumn("taken", F.when(F.col("size") > 0, taken_before(F.col("start") + F.col("size"), block) - taken_before(F.col("start"), block)).otherwise(F.lit(0)).cast("long"))


def repeats_before(j: Column) -> Column:
    """Repeats of a line's blocks before block j."""
    return F.floor((j * F.col("shard_quota") + F.col("first")) / F.col("blocks"))


def repeats(at: Column, block: int) -> Column:
    """How often the word at a place of the line is taken."""
    j = F.floor(at / block)
    return repeats_before(j + 1) - repeats_before(j)


def taken_before(at: Column, block: int) -> Column:
    """Words taken, repeats counted, of a line's words before a place."""
    return repeats_before(F.floor(at / block)) * block + at % block * repeats(at, block)


def names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix itself, with the columns of `docs` (doc_id, text, source, n_chars and others).

    A document comes once for each repeat, with the words that are taken as often; words that the mix leaves out are
    left out of the text. Texts are shuffled once, to their shards.
    """
    whole = F.floor(F.col("shard_quota") / F.col("blocks"))
    plans = plan(docs, block=block, shard=shard, carry=True).where("taken > 0")
    levels = plans.select("*", F.explode(F.sequence(F.lit(1).cast("long"), whole + 1)).alias("_level"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    some = F.array_join(F.filter(words, lambda _, i: repeats(F.col("start") + i, block) > whole), "")
    text = F.when(F.col("_level") <= whole, F.col("row.text")).otherwise(some)
    put = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    found = levels.withColumn("_text", text).where("_text <> ''")
    return found.select(*((put[c] if c in put else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all `documents`."""
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
DRAWN = "('0x' || substr(md5('mix:' || {}), 1, 8))::BIGINT"
ORACLE_SQL = {
    "op1_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS weight FROM s),
c AS (SELECT *, sum(3 * source_size) OVER o - 3 * source_size AS above, sum(weight) OVER o - weight AS gone FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, r)),
x AS (SELECT max(((SELECT sum(source_size) FROM w) - above)::DOUBLE / ((SELECT sum(weight) FROM w) - gone)::DOUBLE) AS x FROM c),
t AS (SELECT w.*, least(x * weight, (3 * source_size)::DOUBLE) AS target FROM w, x),
k AS (SELECT r, target, unnest(range(0, 3 * source_size // {BLOCK} + 3)) AS k FROM t WHERE target > 0),
q AS (SELECT r, count(*) AS quota FROM (SELECT r FROM k ORDER BY target / (2 * k + 1) DESC, r, k LIMIT (SELECT floor(sum(target) / {BLOCK} + 0.5)::BIGINT FROM t)) GROUP BY r),
p AS (SELECT d.*, t.r, source_size, target, coalesce(quota, 0) AS quota,
      {DRAWN.format("'shard:' || coalesce(doc_id::VARCHAR, '')")} % greatest(1, ceil(source_size / {SHARD}))::BIGINT AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON q.r = t.r),
cell AS (SELECT r, shard, sum(size)::BIGINT AS words, any_value(quota) AS quota FROM p GROUP BY r, shard),
seat AS (SELECT r, shard, row_number() OVER (PARTITION BY r ORDER BY words / (2 * k + 1) DESC, shard, k) AS place, quota
         FROM (SELECT *, unnest(range(0, 3 * ceil(words / {BLOCK})::BIGINT)) AS k FROM cell WHERE words > 0)),
got AS (SELECT r, shard, count(*) AS n FROM seat WHERE place <= quota GROUP BY r, shard),
line AS (SELECT p.*, ceil(words / {BLOCK})::BIGINT AS blocks, coalesce(n, 0) AS b,
         (sum(size) OVER (PARTITION BY p.r, p.shard ORDER BY {DRAWN.format("'order:' || coalesce(doc_id::VARCHAR, '')")}, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start,
         {DRAWN.format("'first:' || p.r || ':' || p.shard")} % greatest(ceil(words / {BLOCK})::BIGINT, 1) AS first
         FROM p JOIN cell ON cell.r = p.r AND cell.shard = p.shard LEFT JOIN got ON got.r = p.r AND got.shard = p.shard),
ends AS (SELECT *, start // {BLOCK} AS j, (start + size) // {BLOCK} AS l FROM line)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE
       (((l * b + first) // blocks) * {BLOCK} + (start + size) % {BLOCK} * (((l + 1) * b + first) // blocks - (l * b + first) // blocks))
     - (((j * b + first) // blocks) * {BLOCK} + start % {BLOCK} * (((j + 1) * b + first) // blocks - (j * b + first) // blocks)) END::BIGINT AS taken
FROM ends"""
}
