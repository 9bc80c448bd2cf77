"""A stored inverted index for keyword search, so that a query reads its terms' postings and no text.

An index is a folder of segments and of versions of a manifest, which names the live segments in order. A segment's rows lie in
folders by the hash of their term: blocks, the postings of a term in one shard. A shard is a few thousand documents of about
the same length, which postings name by their place in it; the folder `bucket=-1` has a row for each shard with their ids
and lengths. Beside it, `gone` has the places of earlier segments whose documents no longer count (replaced or removed). A change
writes one segment and then the next manifest; readers see it once Spark has committed that, and a change that fails leaves nothing
that is read. One writer at a time.

A segment is made in one pass and nothing is shuffled: tasks sort what they hold (PENDING words, or SHARDS shards) into blocks, and write
them to their folders in the order of terms, in small pages, so that a search reads those of its terms. A block's row begins with the
most occurrences and the least length, from which the highest score of the block follows. Most terms stand in hardly a document of a
shard: terms with RARE postings at most share rows, by their hash, in which `terms` names the term of each posting. A search
1. reads the heads of its terms' blocks: how many documents have each term, and the highest score a document of each shard can have;
2. scores the shards that promise most, for a floor that the result is certain to reach;
3. scores the shards that can reach the floor; the others are skipped unread. The result is exact.

`compact` merges the newest segments of like size (each at most TIER times all newer ones), so that a document is rewritten a
logarithmic number of times; that drops what is gone. Only shards under half a block and under half of PENDING words are put together, by a
shuffle of their blocks; those of the others are written where they are read. No text is read again.

Identifiers are strings, not null, and distinct in one change (else the change fails). A null text counts as a document without a length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from convoweave.functions.ordering import running_sum
from convoweave.functions.text import tokens
from convoweave.operators.keyword import B, K1, LEAST_IDF, query_terms
from convoweave.session import cut, last_version, settings

BUCKETS = 4  # folders of terms; each task writes one file into each, so their number does not grow
PAGE_BYTES, PAGE_ROWS = 128 << 10, 2000  # pages of those files, of which a search reads its terms' own
BLOCK, SHARDS, PENDING = 4096, 4, 1 << 20
ROWS_AT_ONCE = 256  # documents that come to a task's Python at once
PROBED = 8  # shards that give the floor
SEGMENTS, TIER = 8, 2.0
BROADCAST_ROWS = 500_000
ROW_BYTES = 64  # of these rows
RARE, GROUPS = 8, 2048  # postings of a term in a shard that share a row with others, and rows that they are dealt to (a multiple of all numbers of folders)
MANIFEST = "segment long, buckets int, n long, n_text long, total long, dead long, dead_text long, dead_total long"
ROWS = "bucket int, term string, shard string, n int, most int, least int, places array<int>, tfs array<int>, lengths array<int>, ids array<string>, terms array<string>"
GONE = "of long, shard string, place int"
WHERE = ["segment", "shard", "place"]
ROUNDING = 1e-9  # of a bound, far above what sums of doubles lose


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast where its counted rows (numbers and short names) are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def group_of(term: str) -> str:
    """What names the rows that a term shares with others; no term has such a sign."""
    return f"#{crc32(term.encode()) % GROUPS}"


def blocks_of(held: list[pa.RecordBatch], buckets: int, block: int, name: str) -> Iterator[pa.RecordBatch]:
    """The blocks, and the rows of the shards, of some documents (id, words)."""
    table = pa.Table.from_batches(held).combine_chunks()
    words = table["words"].combine_chunks()
    known = words.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(known, np.diff(words.offsets.to_numpy()), 0)
    order = np.argsort(lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = table["id"].combine_chunks().take(pa.array(order))
    shards = -(-len(order) // block)
    names = pa.array([f"{name}-{k}" for k in range(shards)])
    ends = pa.array(np.minimum(np.arange(shards + 1) * block, len(order)).astype(np.int32))
    told = pa.array(lengths[order].astype(np.int32), mask=~known[order])
    none, schema = pa.nulls(shards, pa.int32()), [f.split()[0] for f in ROWS.split(", ")]
    lists = lambda values, at: pa.ListArray.from_arrays(at, values)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(shards, -1, np.int32)), pa.nulls(shards, pa.string()), names, none, none, none, pa.nulls(shards, pa.list_(pa.int32())), pa.nulls(shards, pa.list_(pa.int32())), lists(told, ends), lists(ids, ends), pa.nulls(shards, pa.list_(pa.string()))], schema
    )
    coded = words.flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if not len(codes):
        return
    document, n = np.repeat(rank, lengths), len(terms)
    key, tf = np.unique(((document // block) * n + codes) * block + document % block, return_counts=True)  # by shard, term and place
    place, group = (key % block).astype(np.int32), key // block
    length = lengths[order][(group // n) * block + place].astype(np.int32)
    crc = np.array([crc32(t.encode()) % GROUPS for t in terms.to_pylist()], np.int64)
    tf, code, shard = tf.astype(np.int32), group % n, group // n
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    few = np.repeat(sizes <= RARE, sizes)
    shared = np.flatnonzero(few)
    shared = shared[np.argsort(shard[shared] * GROUPS + crc[code[shared]], kind="stable")]
    for chosen, row in ((np.flatnonzero(~few), group), (shared, shard * GROUPS + crc[code])):
        if len(chosen):
            row, alone = row[chosen], row is group
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            at, first = pa.array(np.r_[starts, len(chosen)].astype(np.int32)), chosen[starts]
            named = terms.take(pa.array(code[first])) if alone else pa.array([f"#{g}" for g in crc[code[first]]])
            parts = place[chosen], tf[chosen], length[chosen]
            yield from sliced(
                [
                    pa.array((crc[code[first]] % buckets).astype(np.int32)), named, names.take(pa.array(shard[first])), pa.array(np.diff(np.r_[starts, len(chosen)]).astype(np.int32)),
                    pa.array(np.maximum.reduceat(parts[1], starts)), pa.array(np.minimum.reduceat(parts[2], starts)), *(lists(pa.array(x), at) for x in parts), pa.nulls(len(starts), pa.list_(pa.string())),
                    pa.nulls(len(starts), pa.list_(pa.string())) if alone else lists(terms.take(pa.array(code[chosen])), at),
                ],
                schema,
            )


def sliced(columns: list[pa.Array], schema: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, schema)
    for k in range(0, whole.num_rows, 1 << 14):
        yield whole.slice(k, 1 << 14)


class KeywordIndex:
    """The index in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block

    # What is stored

    def _manifest(self) -> list[dict]:
        """The live segments, oldest first; a row each, a few dozen at most."""
        version = last_version(self.spark, f"{self.path}/manifest")
        if not version:
            return []
        return sorted((r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()), key=lambda s: s["segment"])

    def ready(self) -> bool:
        """Whether anything has been committed."""
        return last_version(self.spark, f"{self.path}/manifest") > 0

    def _commit(self, segments: list[dict]) -> None:
        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        rows = self.spark.createDataFrame([tuple(s[c] for c in columns) for s in segments], MANIFEST)
        rows.coalesce(1).write.parquet(f"{self.path}/manifest/version={last_version(self.spark, f'{self.path}/manifest') + 1}")

    def _rows(self, segments: list[dict]) -> DataFrame:
        """Blocks and shards of some segments, with `segment`."""
        parts = [self.spark.read.schema(ROWS).parquet(f"{self.path}/segment={s['segment']}/rows").withColumn("segment", F.lit(s["segment"])) for s in segments if s["n"]]
        return self._all(parts, f"{ROWS}, segment long")

    def _all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        """The union of parts; without one, no rows."""
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).select("x.*")

    def _live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """`rows` (WHERE and others) of documents that still count."""
        n = sum(s["dead"] for s in segments)
        if not n:
            return rows
        gone = self._all([self.spark.read.schema(GONE).parquet(f"{self.path}/segment={s['segment']}/gone") for s in segments if s["dead"]], GONE)
        return rows.join(small(gone.withColumnRenamed("of", "segment"), n), WHERE, "left_anti")

    def _docs(self, segments: list[dict]) -> DataFrame:
        """segment, shard, place, id and length of the documents of some segments that still count."""
        each = self._rows(segments).where("bucket = -1").select("segment", "shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "d"))
        return self._live(each.select("segment", "shard", "place", F.col("d.ids").alias("id"), F.col("d.lengths").alias("length")), segments)

    def docs(self) -> DataFrame:
        """id and length of every document that counts."""
        return self._docs(self._manifest()).select("id", "length")

    # Changes

    def _number(self, segments: list[dict]) -> int:
        return max((s["segment"] for s in segments), default=0) + 1

    def _write(self, number: int, rows: DataFrame) -> None:
        ordered = rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket")
        ordered.option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/segment={number}/rows")

    def put(self, docs: DataFrame, doc_id: str = "id", text: str = "text") -> None:
        """Adds documents; those that are there already are replaced."""
        segments = self._manifest()
        number, block = self._number(segments), self.block
        given = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
        buckets = BUCKETS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, words, rows, flushed = TaskContext.get().partitionId(), [], 0, 0, 0
            for b in batches:
                held.append(b)
                words, rows = words + len(b.column(1).flatten()), rows + b.num_rows
                if words >= PENDING or rows >= SHARDS * block:
                    yield from blocks_of(held, buckets, block, f"{part}-{flushed}")
                    held, words, rows, flushed = [], 0, 0, flushed + 1
            if held:
                yield from blocks_of(held, buckets, block, f"{part}-{flushed}")

        with settings(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(ROWS_AT_ONCE)):
            self._write(number, given.select("id", tokens(F.col("text")).alias("words")).mapInArrow(run, ROWS))
        mine = self._docs([dict(segment=number, n=1, dead=0)])
        n, ids, n_text, total = mine.agg(F.count("*"), F.count_distinct("id"), F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if ids < n:
            raise ValueError("documents need identifiers, each its own")
        if not n:
            return
        self._append(segments, dict(segment=number, buckets=buckets, n=n, n_text=n_text, total=total), mine.select("id"))

    def remove(self, ids: DataFrame) -> None:
        """Takes out the documents of `ids` (id)."""
        segments = self._manifest()
        self._append(segments, dict(segment=self._number(segments), buckets=BUCKETS, n=0, n_text=0, total=0), ids.select(F.col("id").cast("string").alias("id")))

    def _append(self, segments: list[dict], new: dict, ids: DataFrame) -> None:
        """Commits a segment; `ids` are the documents that no longer count in earlier ones."""
        dead = cut(self._docs(segments).join(ids, "id", "left_semi"))
        new |= self._take_out(new["segment"], dead)
        if new["n"] or new["dead"]:
            self._commit([*segments, new])
            if len(segments) + 1 > SEGMENTS:
                self.compact()

    def _take_out(self, number: int, dead: DataFrame) -> dict:
        """Writes what a segment takes out of earlier ones, and its figures."""
        n, n_text, total = dead.agg(F.count("*"), F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n:
            dead.select(F.col("segment").alias("of"), "shard", "place").write.mode("overwrite").parquet(f"{self.path}/segment={number}/gone")
        return dict(dead=n, dead_text=n_text, dead_total=total)

    def compact(self, whole: bool = False) -> None:
        """Merges the newest segments of like size, or all."""
        segments = self._manifest()
        first = len(segments) - 1
        while first > 0 and (whole or segments[first - 1]["n"] <= TIER * sum(s["n"] + s["dead"] for s in segments[first:])):
            first -= 1
        kept, merged = segments[: max(first, 0)], segments[max(first, 0) :]
        if len(merged) < 2:
            return
        number, names = self._number(segments), [s["segment"] for s in merged]
        rows, shards = self._rows(merged), self._merged_shards(segments, merged)
        n, n_text, total, docs = shards.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("with_text"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
        n_shards = shards.count()
        buckets = max(s["buckets"] for s in merged)
        number_of = F.when(F.col("terms").isNull(), F.crc32(F.col("term").cast("binary"))).otherwise(F.substring("term", 2, 9).cast("long"))
        bucket = F.pmod(number_of, F.lit(buckets)).cast("int")
        kept_ones = F.filter(F.arrays_zip("places", "tfs", "lengths", F.coalesce("terms", F.array_repeat(F.lit(None).cast("string"), F.size("places"))).alias("terms")), lambda p: F.get("to", p["places"]).isNotNull())

        def moved(chosen: DataFrame) -> DataFrame:
            """bucket, term, new and p (places, tfs, lengths, terms) of the blocks of some shards."""
            moves = small(chosen.select("segment", "shard", "new", "start", "to"), n_shards + 4 * docs // ROW_BYTES)  # four bytes a place
            each = rows.where("bucket >= 0").join(moves, ["segment", "shard"]).select(bucket.alias("bucket"), "term", "new", "start", "to", F.col("terms").isNotNull().alias("shared"), kept_ones.alias("p")).where(F.size("p") > 0)
            parts = F.struct(F.transform("p", lambda p: F.col("start") + F.get("to", p["places"])).alias("places"), F.col("p.tfs").alias("tfs"), F.col("p.lengths").alias("lengths"), F.when(F.col("shared"), F.col("p.terms")).alias("terms"))
            return each.select("bucket", "term", "new", parts.alias("p"))

        together = moved(shards.where("NOT alone")).groupBy("bucket", "term", "new").agg(F.collect_list("p").alias("p"))
        blocks = moved(shards.where("alone")).withColumn("p", F.array("p")).unionByName(together)
        lists = {c: F.flatten(F.col(f"p.{c}")) for c in ("places", "tfs", "lengths", "terms")}
        none = lambda kind: F.lit(None).cast(kind)
        blocks = blocks.select("bucket", "term", F.col("new").alias("shard"), *(v.alias(c) for c, v in lists.items()))
        blocks = blocks.select("bucket", "term", "shard", F.size("places").alias("n"), F.array_max("tfs").alias("most"), F.array_min("lengths").alias("least"), "places", "tfs", "lengths", none("array<string>").alias("ids"), "terms")
        listed = shards.where("size > 0").groupBy(F.col("new").alias("shard")).agg(F.array_sort(F.collect_list(F.struct("start", "lengths", "ids"))).alias("d"))
        listed = listed.select(
            F.lit(-1).alias("bucket"), none("string").alias("term"), "shard", *(none("int").alias(c) for c in ("n", "most", "least")), *(none("array<int>").alias(c) for c in ("places", "tfs")),
            F.flatten("d.lengths").alias("lengths"), F.flatten("d.ids").alias("ids"), none("array<string>").alias("terms"),
        )
        self._write(number, blocks.unionByName(listed))
        gone = [self.spark.read.schema(GONE).parquet(f"{self.path}/segment={s['segment']}/gone") for s in merged if s["dead"]]
        earlier = self._all(gone, GONE).where(~F.col("of").isin(*names)).withColumnRenamed("of", "segment")  # what they take out of those that stay
        dead = cut(self._docs([s | dict(dead=0) for s in kept]).join(earlier, WHERE, "left_semi"))
        self._commit([*kept, dict(segment=number, buckets=buckets, n=n, n_text=n_text, total=total) | self._take_out(number, dead)])

    def _merged_shards(self, segments: list[dict], merged: list[dict]) -> DataFrame:
        """The shards of `merged`: segment, shard, new (the shard that takes them in), start (their first place there), to (the place of
        each document behind that, null if it no longer counts), and of those that count the ids, lengths, number and figures.

        Small shards go by their length, as many into a new one as fit into a block; they move as arrays, and no posting for itself.
        Larger ones (`alone`) are new ones by themselves.
        """
        columns = "segment long, shard string, to array<int>, ids array<string>, lengths array<int>, size long, with_text long, words long"
        least_docs, least_words = self.block / 2, PENDING / 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    gone = set(r["gone"] or ())
                    alive = [k for k in range(len(r["ids"])) if k not in gone]
                    to = [None] * len(r["ids"])
                    for place, k in enumerate(alive):
                        to[k] = place
                    lengths = [r["lengths"][k] for k in alive]
                    told = [x for x in lengths if x is not None]
                    out.append({"segment": r["segment"], "shard": r["shard"], "to": to, "ids": [r["ids"][k] for k in alive], "lengths": lengths, "size": len(alive), "with_text": len(told), "words": sum(told)})
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip((c.split()[0] for c in columns.split(", ")), kinds, strict=True))))

        parts = [self.spark.read.schema(GONE).parquet(f"{self.path}/segment={s['segment']}/gone") for s in segments if s["dead"]]
        gone = self._all(parts, GONE).groupBy(F.col("of").alias("segment"), "shard").agg(F.collect_set("place").alias("gone"))
        rows = self._rows(merged).where("bucket = -1").select("segment", "shard", "ids", "lengths").join(gone, ["segment", "shard"], "left")
        with settings(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch="16"):
            found = cut(rows.mapInArrow(run, columns))
        found = found.withColumn("alone", (F.col("size") >= least_docs) | (F.col("words") >= least_words))
        order = [F.coalesce(F.get("lengths", F.lit(0)), F.lit(0)), F.col("segment"), F.col("shard")]
        placed = running_sum(found.where("NOT alone").select("segment", "shard", "lengths", "size"), order, "size", "total")
        placed = placed.withColumn("before", F.col("total") - F.col("size")).withColumn("nth", F.floor(F.col("before") / self.block))
        start = F.col("before") - F.min("before").over(Window.partitionBy("nth"))
        places = placed.select("segment", "shard", F.concat(F.lit("m"), "nth").alias("_new"), start.cast("int").alias("_start"))
        new = F.coalesce("_new", F.concat(F.lit("a"), "segment", F.lit("-"), "shard")).alias("new")
        found = found.join(places, ["segment", "shard"], "left")
        return cut(found.select(*(c.split()[0] for c in columns.split(", ")), "alone", new, F.coalesce("_start", F.lit(0)).alias("start")))

    def heal(self, docs: DataFrame, doc_id: str = "id", text: str = "text") -> tuple[int, int]:
        """Makes the index hold the documents of `docs`: adds what lacks and removes what is too much; how many of each."""
        ids = docs.select(F.col(doc_id).cast("string").alias("id"))
        here = self.docs().select("id")
        lacking, extra = cut(ids.join(here, "id", "left_anti")), cut(here.join(ids, "id", "left_anti"))
        n, m = lacking.count(), extra.count()
        if m:
            self.remove(extra)
        if n:
            self.put(docs.join(lacking.withColumnRenamed("id", "_lacking"), F.col(doc_id).cast("string") == F.col("_lacking"), "left_semi"), doc_id, text)
        return n, m

    # Questions

    def _blocks(self, segments: list[dict], terms: Sequence[str]) -> DataFrame:
        """The blocks of some terms, those in shared rows as rows of their own: only the folders of their hashes are read."""
        found, names = [], dict.fromkeys([*terms, *map(group_of, terms)])
        for buckets in {s["buckets"] for s in segments if s["n"]}:
            asked = {crc32(t.encode()) % buckets for t in terms}
            rows = self._rows([s for s in segments if s["buckets"] == buckets and s["n"]])
            found.append(rows.where(F.col("bucket").isin(*asked) & F.col("term").isin(*names)))
        rows = self._all(found, f"{ROWS}, segment long")
        shared = rows.where("terms IS NOT NULL").withColumn("_t", F.explode(F.array(*(F.struct(F.lit(group_of(t)).alias("name"), F.lit(t).alias("term")) for t in terms)))).where("term = _t.name")
        mine = F.filter(F.arrays_zip("places", "tfs", "lengths", "terms"), lambda p: p["terms"] == F.col("_t.term"))
        shared = shared.withColumn("_p", mine).where(F.size("_p") > 0).withColumn("term", F.col("_t.term"))
        shared = shared.withColumns({c: F.col(f"_p.{c}") for c in ("places", "tfs", "lengths")}).drop("_t", "_p")
        shared = shared.withColumns({"n": F.size("places"), "most": F.array_max("tfs"), "least": F.array_min("lengths")})
        return rows.where("terms IS NULL").unionByName(cut(shared))  # few and short, but dearer to read

    def _postings(self, blocks: DataFrame, *others: str) -> DataFrame:
        """segment, shard, place, term, tf, length and other columns of every posting of some blocks."""
        each = blocks.select("segment", "shard", "term", *others, F.explode(F.arrays_zip("places", "tfs", "lengths")).alias("p"))
        return each.select("segment", "shard", "term", *others, F.col("p.places").alias("place"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))

    def search(self, query: str, limit: int, compat: bool = False) -> DataFrame:
        """id and score of the best `limit` documents that have a term of the query, as `keyword.bm25` scores them."""
        terms = query_terms(query, compat)
        distinct = list(dict.fromkeys(terms))
        segments = self._manifest()
        if not terms or not segments or limit < 1:
            return self.spark.range(0).select(F.lit("").alias("id"), F.lit(0.0).alias("score"))
        n, n_text, total = (sum(s[c] - s[d] for s in segments) for c, d in (("n", "dead"), ("n_text", "dead_text"), ("total", "dead_total")))
        mean = total / n_text if n_text else 0.0
        blocks = self._blocks(segments, distinct)
        heads = blocks.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
        if any(s["dead"] for s in segments):
            heads = heads.drop("n").join(self._live(self._postings(blocks), segments).groupBy("term").agg(F.count("*").alias("n")), "term")
        heads = heads.select("term", "n", "blocks").collect()  # a row for each term of the query
        having = {r["term"]: r["n"] for r in heads}
        idf = [max(math.log((n - having.get(t, 0) + 0.5) / (having.get(t, 0) + 0.5)), 0.0) or LEAST_IDF for t in distinct]
        place = F.element_at(F.create_map(*(F.lit(x) for k, t in enumerate(distinct) for x in (t, k))), F.col("term"))
        weight = F.element_at(F.create_map(*(F.lit(x) for k, t in enumerate(distinct) for x in (k, terms.count(t) * idf[k]))), F.col("k"))

        def part(tf: Column, length: Column) -> Column:
            tf = tf.cast("double")
            return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length.cast("double") / F.lit(mean or 1.0)))

        asked = blocks.withColumn("k", place)

        def scored(rows: DataFrame) -> DataFrame:
            """WHERE and score of the documents of some blocks; a document's parts add up in the order of the query's terms."""
            each = self._live(self._postings(rows, "k"), segments).select(*WHERE, F.struct("k", part(F.col("tf"), F.col("length")).alias("part")).alias("p"))
            parts = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])
            return each.groupBy(*WHERE).agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("score"))

        most, floor = sum(r["blocks"] for r in heads), 0.0  # shards at most
        if most > 2 * PROBED:
            bounds = asked.groupBy("segment", "shard").agg(F.sum(part(F.col("most"), F.col("least"))).alias("bound"))
            first = bounds.orderBy(F.desc("bound"), "segment", "shard").limit(PROBED).select("segment", "shard")
            probed = scored(asked.join(F.broadcast(first), ["segment", "shard"], "left_semi")).orderBy(F.desc("score")).limit(limit).collect()
            floor = probed[-1]["score"] if len(probed) == limit else 0.0
            worth = bounds.where(F.col("bound") * (1 + ROUNDING) >= floor).select("segment", "shard")
            asked = asked.join(small(worth, most), ["segment", "shard"], "left_semi")
        good = scored(asked).where(F.col("score") >= floor)
        shards = self._rows(segments).where("bucket = -1").select("segment", "shard", "ids")
        return good.join(shards, ["segment", "shard"]).select(F.get("ids", F.col("place")).alias("id"), "score").orderBy(F.desc("score"), "id").limit(limit)
