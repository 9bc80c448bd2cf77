"""Hybrid search: exact nearest neighbours and BM25, fused by reciprocal ranks, filtered and diversified."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from convoweave.functions.text import question_key, source_or_default, strip
from convoweave.functions.times import within
from convoweave.functions.vectors import dot, int8, norm, normalised
from convoweave.operators.keyword import bm25
from convoweave.operators.keyword_index import KeywordIndex
from convoweave.session import cut, settings

RRF_K = 60
SLAB, BLOCK = 4096, 1024  # vectors and queries of a pair
ASKED = 256  # queries of a block that are scored at once
PAIRS = 4  # slabs with a block that come to a task's Python at once
CELLS = 3  # tasks for each core at least, where there are so many slabs
BROADCAST_BYTES = 32 << 20
LAST = np.int64(2**63 - 1)
MODES = ("hybrid", "semantic", "keyword")


def nearest(vectors: DataFrame, query: Sequence[float], limit: int, key: str = "chunk_key", embedding: str = "embedding") -> DataFrame:
    """key and score (dot product) of the `limit` best vectors; ties go by key. The scan scores, each task keeps its top."""
    return vectors.select(F.col(key), dot(F.col(embedding), query).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def first_copies(keys: pa.Array, v: np.ndarray, limit: int) -> np.ndarray:
    """The places of all vectors but those that `limit` equal ones of lower keys stand before."""
    kind = np.unique(v.view(f"V{v.itemsize * v.shape[1]}").ravel(), return_inverse=True)[1]
    by = pc.array_sort_indices(keys).to_numpy().astype(np.int64)
    by = by[np.argsort(kind[by], kind="stable")]
    return np.sort(by[np.arange(len(by)) - np.searchsorted(kind[by], kind[by]) < limit])


def packed(vectors: DataFrame, key: str, embedding: str, most: int, limit: int | None = None) -> DataFrame:
    """dims, keys and data: vectors of one length, up to `most` of a task in a row, as one block of doubles.

    Vectors that are null, empty or hold nulls are left out: they have no score. limit: how many a query gets at most; of equal vectors
    in a block only so many are ever among them.
    """
    rows = vectors.select(F.col(key).cast("string").alias("key"), F.transform(embedding, lambda x: x.cast("double")).alias("e"))
    rows = rows.where("key IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL)")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, e = b.column(0), b.column(1)
            ends = e.offsets.to_numpy()
            flat, dims = e.values.to_numpy(), np.diff(ends)
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                for k in range(0, len(mine), most):
                    part = mine[k : k + most]
                    data = flat[ends[part][:, None] + np.arange(d)]
                    if limit:
                        first = first_copies(keys.take(pa.array(part)), data, limit)
                        part, data = part[first], data[first]
                    yield pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "keys": [keys.take(pa.array(part)).to_pylist()], "data": [data.tobytes()]})

    return rows.mapInArrow(pack, "dims int, keys array<string>, data binary")


def rounded(scores: np.ndarray) -> np.ndarray:
    """12 digits, so that equal vectors tie; what has no such digits stays."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.round(scores, 12)
    return np.where(np.isfinite(out), out, scores)


def ordered(scores: np.ndarray) -> np.ndarray:
    """Longs in the order of the scores, as SQL has it: NaN is above all, zeros are alike. `ordered` of their bits gives the scores' bits."""
    bits = (np.where(np.isnan(scores), np.nan, scores) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ LAST, bits)


def scores_of(places: np.ndarray) -> np.ndarray:
    return np.where(places < 0, places ^ LAST, places).view(np.float64)


class Best:
    """The `limit` best vectors so far for each query of a block; ties go by key.

    Whole slabs are multiplied at once. What may be among the best is scored again, component by component, since a product of
    matrices may differ in its last digit from place to place, and equal vectors must tie. Up to twice `limit` vectors a query are
    held between slabs.
    """

    def __init__(self, asked: pa.Array, q: np.ndarray, limit: int):
        self.asked, self.q, self.limit = asked, q, limit
        with np.errstate(over="ignore"):
            self.length = np.sqrt((q * q).sum(axis=1))
        self.floor = np.full(len(q), -LAST)  # what a query's last place has, once all its places are taken
        self.row, self.place, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], asked.type)
        self.more: list = []
        self.held = 0

    def meet(self, keys: pa.Array, v: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((v * v).sum(axis=1))
            odd = ~np.isfinite(length)  # their products bound nothing
            slack = self.length * np.max(length[~odd], initial=0) * (v.shape[1] + 4) * 2.0**-52 + 1e-12
        columns = np.ascontiguousarray(v.T)
        for a in range(0, len(self.q), ASKED):
            q = self.q[a : a + ASKED]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = q @ columns
                scores[:, odd] = -np.inf
                least = scores_of(self.floor[a : a + ASKED])
                # no floor yet is the least long, which is no score
                least = np.where(self.floor[a : a + ASKED] == -LAST, -np.inf, np.where(np.isnan(least), np.inf, least)) - slack[a : a + ASKED]
                able = ~(scores < least[:, None])
                if np.count_nonzero(able) > self.limit * len(q) and self.limit < len(keys):
                    kth = np.partition(scores, len(keys) - self.limit, axis=1)[:, len(keys) - self.limit]
                    able &= ~(scores < (kth - 2 * slack[a : a + ASKED])[:, None])
                able[:, odd] = True
                row, at = np.divmod(np.flatnonzero(able), len(keys))
                exact = np.zeros(len(row))
                for x, y in zip(np.ascontiguousarray(q.T), columns, strict=True):
                    exact += x[row] * y[at]
            place = ordered(rounded(exact))
            good = place >= self.floor[a + row]
            self.more.append((a + row[good], place[good], keys.take(pa.array(at[good]))))
            self.held += len(self.more[-1][0])
            if self.held > 2 * self.limit * len(self.q):
                self.settle()

    def settle(self) -> None:
        """Leaves `limit` at most for each query, in the order of queries and scores."""
        rows, places, keys = zip((self.row, self.place, self.key), *self.more, strict=True)
        row, place, key = np.concatenate(rows), np.concatenate(places), pa.concat_arrays(keys)
        by = np.lexsort((~place, row))  # ~ turns the order around
        row, place = row[by], place[by]
        ends = np.searchsorted(row, np.arange(len(self.q) + 1))
        full = np.flatnonzero(np.diff(ends) >= self.limit)
        self.floor[full] = place[ends[full] + self.limit - 1]
        above, tied = place > self.floor[row], place == self.floor[row]
        room = self.limit - np.bincount(row[above], minlength=len(self.q))
        crowded = np.flatnonzero(tied & (np.bincount(row[tied], minlength=len(self.q)) > room)[row])
        nth = np.empty(len(crowded), np.int64)
        nth[pc.array_sort_indices(key.take(pa.array(by[crowded]))).to_numpy()] = np.arange(len(crowded))
        crowded = crowded[np.lexsort((nth, row[crowded]))]
        late = np.arange(len(crowded)) - np.searchsorted(row[crowded], row[crowded]) >= room[row[crowded]]
        keep = above | tied
        keep[crowded[late]] = False
        self.row, self.place, self.key, self.more, self.held = row[keep], place[keep], key.take(pa.array(by[keep])), [], int(keep.sum())

    def rows(self, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        self.settle()
        for k in range(0, len(self.row), most):
            at = slice(k, k + most)
            yield pa.RecordBatch.from_pydict({"query": self.asked.take(pa.array(self.row[at])), "key": self.key[at], "score": scores_of(self.place[at])})


def nearest_each(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_key", query: str = "query", embedding: str = "embedding") -> DataFrame:
    """query, key, score and rank: for each of `queries` (its key unique) the `limit` best of `vectors` by dot product, ties by key.

    Vectors are packed into slabs where they lie; queries are dealt over blocks. A task has one block and a share of the slabs, which pass by PAIRS
    at a time while it keeps the best so far (`Best`), so that its memory holds whatever the number of slabs. The more blocks
    there are, the fewer shares: rows that are ranked at the end grow with the queries, not with their pairs with slabs. A
    single block is broadcast while it is small. Slabs are cut first, since every block reads them; so are the results. Scores have
    12 digits, so that equal vectors tie. Keys are compared as strings. Only vectors as long as the query count.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-queries.count() // BLOCK))
    # a partition is one block, although not all are dealt equally many
    blocks = cut(packed(queries.repartition(parts), query, embedding, 2 * BLOCK).withColumn("block", F.monotonically_increasing_id()))
    size = blocks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    blocks = blocks.select(F.col("dims").alias("_d"), F.col("keys").alias("asked"), F.col("data").alias("asked_data"), "block")
    slabs = cut(packed(vectors, key, embedding, SLAB, limit)).coalesce(max(1, -(-CELLS * cores // parts)))
    met = F.broadcast(blocks) if parts == 1 and size <= BROADCAST_BYTES else blocks.hint("shuffle_replicate_nl")
    pairs = slabs.join(met, F.col("dims") == F.col("_d"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for b in batches:
            for r in range(b.num_rows):
                block, keys = b.column("block")[r].as_py(), b.column("keys")[r].values
                if block not in best:
                    asked = pa.array(b.column("asked")[r].as_py(), pa.string())  # not a part of the batch, which would stay
                    best[block] = Best(asked, np.frombuffer(b.column("asked_data")[r].as_py()).reshape(len(asked), -1), limit)
                best[block].meet(keys, np.frombuffer(b.column("data")[r].as_buffer()).reshape(len(keys), -1))
        for found in best.values():
            yield from found.rows()

    found = pairs.select("keys", "data", "asked", "asked_data", "block").mapInArrow(score, "query string, key string, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    with settings(vectors.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(PAIRS)):
        return cut(found.withColumn("rank", rank).where(F.col("rank") <= limit))


def cosines(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """`vectors` quantised to bytes and scaled to length one, so that their dot products are the cosines of `nearest_int8`."""
    return vectors.withColumn(embedding, normalised(int8(F.col(embedding))))


def by_turn_each(hits: DataFrame) -> DataFrame:
    """query, id, cosine and rank of turns, from the `nearest_each` of their chunks."""
    owner = F.regexp_replace("key", r"#[^#]*$", "")
    best = hits.groupBy("query", owner.alias("id")).agg(F.max(F.struct("score", "key")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_b.score"), F.col("_b.key")))
    return best.select("query", "id", F.col("_b.score").alias("cosine"), rank.alias("rank"))


def nearest_int8(vectors: DataFrame, query: Sequence[float], limit: int, key: str = "chunk_key", embedding: str = "embedding") -> DataFrame:
    """As `nearest`, by cosine of vectors quantised to bytes."""
    asked = [max(-127.0, min(127.0, float(int(abs(x) * 127 + 0.5)) * (1 if x >= 0 else -1))) for x in query]
    size = sum(x * x for x in asked) ** 0.5 or 1.0
    rows = vectors.select(F.col(key), int8(F.col(embedding)).alias("_q"))
    length = F.when(norm(F.col("_q")) == 0, F.lit(1.0)).otherwise(norm(F.col("_q")))
    return rows.select(key, (dot(F.col("_q"), asked) / (length * size)).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def by_turn(hits: DataFrame, key: str = "chunk_key") -> DataFrame:
    """id, cosine and rank of turns, from hits on their chunks: a turn's best chunk counts, ranks are among turns."""
    owner = F.regexp_replace(F.col(key).cast("string"), r"#[^#]*$", "")
    best = hits.groupBy(owner.alias("id")).agg(F.max(F.struct("score", F.col(key))).alias("_b"))
    return best.select("id", F.col("_b.score").alias("cosine"), F.row_number().over(Window.orderBy(F.desc("_b.score"), F.col(f"_b.{key}"))).alias("rank"))


def ranks(hits: DataFrame, name: str) -> DataFrame:
    """id and rank of a limited list of hits (id, score)."""
    return hits.select(F.col("id"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(name))


def fuse(semantic: DataFrame | None, keyword: DataFrame | None) -> DataFrame:
    """id, score, sem_rank, kw_rank, sources: reciprocal ranks of both lists added up."""
    if semantic is None or keyword is None:
        given, mine, other = (keyword, "kw_rank", "sem_rank") if semantic is None else (semantic, "sem_rank", "kw_rank")
        both = given.withColumn(other, F.lit(None).cast("int"))
        assert mine in both.columns
    else:
        both = semantic.join(keyword, "id", "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    sources = F.concat_ws(",", F.when(F.col("kw_rank").isNotNull(), "keyword"), F.when(F.col("sem_rank").isNotNull(), "semantic"))
    return both.select("id", (part("sem_rank") + part("kw_rank")).alias("score"), "sem_rank", "kw_rank", sources.alias("sources"))


def depth(k: int, scoped: bool) -> int:
    """How many candidates each list gives: more where a session or a folder bounds the search."""
    return max(8 * k, 1000) if scoped else 8 * k


def select_hits(
    fused: DataFrame, turns: DataFrame, k: int, hidden: DataFrame | None = None, allowed: DataFrame | None = None, sources: Sequence[str] = (),
    session: str | None = None, since: str | None = None, until: str | None = None,
) -> DataFrame:
    """The first k of `fused` that pass all filters, one for each question; columns of `fused` and `place`.

    The candidates are few (`depth`), so they are broadcast to the turns, whose light columns alone are read.
    """
    cand = F.broadcast(fused)
    rows = turns.select("id", "session_id", "project", "question", "timestamp", "source").join(cand, "id")
    if hidden is not None:
        rows = rows.join(hidden.select("id"), "id", "left_anti")
    if allowed is not None:
        rows = rows.join(allowed.select("id"), "id", "left_semi")
    if sources:
        rows = rows.where(source_or_default(F.col("source")).isin(*("claude-code" if s == "claude" else s for s in sources)))
    if session:
        rows = rows.where(F.col("session_id").startswith(session) | F.coalesce(F.col("project"), F.lit("")).contains(session))
    if since or until:
        rows = rows.where(within(F.col("timestamp"), since, until))
    order = [F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("kw_rank"), F.col("id")]
    rows = rows.withColumn("_q", question_key(F.coalesce("question", F.lit(""))))
    first = F.row_number().over(Window.partitionBy("_q").orderBy(*order))
    rows = rows.withColumn("_nth", first).where("_q = '' OR _nth = 1")
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("id", "score", "sem_rank", "kw_rank", "sources", "place")


def search(
    turns: DataFrame, vectors: DataFrame | None, query: str, query_vector: Sequence[float] | None, k: int = 5, mode: str = "hybrid", text: str = "text",
    index: KeywordIndex | None = None, **filters
) -> DataFrame:
    """Hits for a query: id, score, sem_rank, kw_rank, sources, place. Unknown modes are hybrid; filters as in `select_hits`.

    index: the stored keyword index of `turns`; without one their texts are read.
    """
    mode = mode if mode in MODES else "hybrid"
    n = depth(k, bool(filters.get("session")) or filters.get("allowed") is not None)
    semantic = keyword = None
    if mode != "keyword" and vectors is not None and query_vector is not None:
        semantic = by_turn(nearest(vectors, query_vector, n)).select("id", F.col("rank").alias("sem_rank"))
    if mode != "semantic" or semantic is None:
        keyword = ranks(index.search(query, n) if index else bm25(turns, query, n, text=text), "kw_rank")
    return select_hits(fuse(semantic, keyword), turns, k, **filters)


def related(hits: DataFrame, turns: DataFrame, session_id: str, k: int) -> DataFrame:
    """The first min(k, 10) of `hits` that are in other sessions."""
    rows = F.broadcast(hits).join(turns.select("id", "session_id"), "id").where(F.col("session_id") != session_id)
    return rows.orderBy("place").limit(min(k, 10))


EXAMPLE_TURNS = 12


def example_texts(turns: DataFrame, most: int = EXAMPLE_TURNS, trimmed: Callable[[Column], Column] = strip) -> DataFrame:
    """session_id and example: the text that a search by a session's example asks, of the summaries (else questions) of its first turns.

    trimmed: what is taken from both ends of the text; all white space, if nothing else is said.
    """
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "id"))
    said = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("question", F.lit("")))
    rows = turns.select("session_id", said.alias("said"), nth.alias("nth")).where((F.col("nth") <= most) & F.col("said").isNotNull())
    told = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("nth", "said"))).alias("t"))
    return told.select("session_id", trimmed(F.array_join(F.col("t.said"), " ")).alias("example"))


def in_cluster(hits: DataFrame, points: DataFrame, cluster: int) -> DataFrame:
    """`hits` on turns that have a point in a cluster of the map. points: cluster, turn_id."""
    return hits.join(points.where(F.col("cluster") == cluster).select(F.col("turn_id").alias("id")), "id", "left_semi")
