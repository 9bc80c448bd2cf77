"""Queries that search, merge, diagnose, map and follow the archive."""

from __future__ import annotations


from pyspark.sql import functions as F

from convoweave.functions import times
from convoweave.operators import density, enrich, keyword as kw, merge as me, quality as qu, search as sr, semantic_map as sm
from convoweave.operators.keyword_index import KeywordIndex
from convoweave.plans.listing import HARD_CHUNKS, folders, hard_chunks, items
from convoweave.plans.model import FOLDERS, ITEMS, TURNS, sql, stamp, turns
from convoweave.operators import folders as fo
from convoweave.session import new_path, shared_dir, table
from convoweave.streaming import incremental as inc

QUERIES, ORACLE_SQL = {}, {}
ASKED = "the of tion apache"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# Documents stand for turns with a text and a vector: text, source as session, lang as project.
DOCS = r"""docs AS (SELECT doc_id::VARCHAR AS id, 's' || source AS session_id, lang AS project, coalesce(text, '') AS question, text,
  strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(doc_id % 100) + to_minutes(doc_id % 60), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  CASE WHEN doc_id % 3 = 0 THEN 'codex' WHEN doc_id % 3 = 1 THEN 'claude-code' ELSE '' END AS source FROM documents)"""


def docs(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.cast("string").alias("id"), F.concat(F.lit("s"), F.col("source")).alias("session_id"), F.col("lang").alias("project"), F.coalesce("text", F.lit("")).alias("question"), "text",
        stamp(d % 100, d % 60).alias("timestamp"), F.when(d % 3 == 0, "codex").when(d % 3 == 1, "claude-code").otherwise("").alias("source"),
    )


def stored_index(spark, sf):
    """The keyword index of all documents below the shared folder: made on first use, and anew when the table's files are others."""
    files = table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    known = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0]
    index = KeywordIndex(spark, f"{shared_dir(spark)}/keyword-{known}")
    if not index.ready():
        index.put(docs(spark, sf).select("id", "text"))
    return index


POSTINGS = r"""tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM docs),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term), len AS (SELECT id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dl FROM docs)"""
BM25 = """bm AS (SELECT id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6::DOUBLE END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM post JOIN len USING (id) JOIN (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term) USING (term),
  (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM len) WHERE term IN ('the', 'of', 'tion', 'apache') GROUP BY id)"""


@query("keyword_postings", sql(DOCS, POSTINGS, "SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM post GROUP BY term"))
def keyword_postings(spark, sf):
    return kw.postings(docs(spark, sf), "id", "text").groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query("bm25_search", sql(DOCS, POSTINGS, BM25, "SELECT id, round(score, 9) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20"))
def bm25_search(spark, sf):
    return stored_index(spark, sf).search(ASKED, 20).select("id", F.round("score", 9).alias("score"))


@query("bm25_scan", sql(DOCS, POSTINGS, BM25, "SELECT id, round(score, 9) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20"))
def bm25_scan(spark, sf):
    """The same without an index, by two scans of all texts."""
    return kw.bm25(docs(spark, sf), ASKED, 20).select("id", F.round("score", 9).alias("score"))


CHANGED = """changed AS (SELECT id, CASE WHEN id::BIGINT % 10 = 3 THEN concat(text, ' the apache of apache') ELSE text END AS text FROM docs WHERE id::BIGINT % 10 <> 7
  UNION ALL SELECT id || '+', 'the new ' || text FROM docs WHERE id::BIGINT % 10 = 4)"""


@query("keyword_index_upkeep", sql(DOCS, CHANGED, POSTINGS.replace("FROM docs", "FROM changed"), BM25, "SELECT id, round(score, 9) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 200"))
def keyword_index_upkeep(spark, sf):
    """The index after a tenth of all documents was replaced, a tenth removed, a tenth came in, and all was merged."""
    rows, number = docs(spark, sf).select("id", "text"), F.col("id").cast("long") % 10
    index = KeywordIndex(spark, new_path(spark, "keyword"))
    index.put(rows)
    index.put(rows.where(number == 3).withColumn("text", F.concat("text", F.lit(" the apache of apache"))))
    index.remove(rows.where(number == 7))
    index.put(rows.where(number == 4).select(F.concat("id", F.lit("+")).alias("id"), F.concat(F.lit("the new "), "text").alias("text")))
    index.compact(whole=True)
    return index.search(ASKED, 200).select("id", F.round("score", 9).alias("score"))


VECTORS = "vec AS (SELECT vec_id, vec_id::VARCHAR AS chunk_key, embedding::DOUBLE[] AS e, label FROM embeddings), asked AS (SELECT e AS q FROM vec WHERE vec_id = 7)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_key"), "embedding", "label")


def asked(spark, sf):
    row = table(spark, sf, "embeddings").where("vec_id = 7").first()
    return list(row["embedding"]) if row else None


def every_twentieth(spark, sf):
    """The query set of the vector searches: every row whose id is divisible by 20."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


EACH = """v AS (SELECT vec_id, vec_id::VARCHAR AS chunk_key, {} AS e FROM embeddings),
scored AS (SELECT q.chunk_key AS query, v.chunk_key, v.vec_id, round(list_dot_product(v.e, q.e), 12) AS s FROM v, v q WHERE q.vec_id % 20 = 0)"""
BYTES = """list_transform(embedding::DOUBLE[], lambda x: least(127.0::DOUBLE, greatest(-127.0::DOUBLE, round(x * 127))))"""
UNIT = f"CASE WHEN list_dot_product({BYTES}, {BYTES}) = 0 THEN {BYTES} ELSE list_transform({BYTES}, lambda y: y / sqrt(list_dot_product({BYTES}, {BYTES}))) END"
BEST = "SELECT query, chunk_key, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, chunk_key) AS rank FROM scored) WHERE rank <= 25"


def best_chunks(hits):
    return hits.select("query", F.col("key").alias("chunk_key"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_exact", sql(EACH.format("embedding::DOUBLE[]"), BEST))
def knn_exact(spark, sf):
    return best_chunks(sr.nearest_each(vectors(spark, sf), every_twentieth(spark, sf), 25))


@query("knn_int8", sql(EACH.format(UNIT), BEST))
def knn_int8(spark, sf):
    return best_chunks(sr.nearest_each(sr.cosines(vectors(spark, sf)), sr.cosines(every_twentieth(spark, sf)), 25))


@query(
    "chunk_to_turn_collapse",
    sql(
        EACH.format("embedding::DOUBLE[]"), "k AS (SELECT query, s, 't' || (vec_id % 50) AS id, 't' || (vec_id % 50) || '#' || vec_id AS k FROM scored)", "h AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, k) <= 200)", "b AS (SELECT query, id, max((s, k)) AS m FROM h GROUP BY query, id)",
        "SELECT query, id, round(m[1], 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY m[1] DESC, m[2]) AS rank FROM b",
    ),
)
def chunk_to_turn_collapse(spark, sf):
    n = F.col("chunk_key").cast("long")
    rows = vectors(spark, sf).withColumn("chunk_key", F.concat(F.lit("t"), (n % 50).cast("string"), F.lit("#"), F.col("chunk_key")))
    found = sr.by_turn_each(sr.nearest_each(rows, every_twentieth(spark, sf), 200))
    return found.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def hybrid_sql(depth: int, where: str, k: int, tail: str = "SELECT id, round(score, 9) AS score, sources, place FROM hits") -> str:
    return sql(
        DOCS, POSTINGS, BM25, VECTORS, FOLDERS, ITEMS,
        f"sem AS (SELECT chunk_key AS id, row_number() OVER (ORDER BY s DESC, chunk_key) AS sem_rank FROM (SELECT chunk_key, list_dot_product(e, q) AS s FROM vec, asked ORDER BY s DESC, chunk_key LIMIT {depth}))",
        f"kwd AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS kw_rank FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT {depth}))",
        "fused AS (SELECT coalesce(sem.id, kwd.id) AS id, coalesce(1.0::DOUBLE / (60 + sem_rank), 0) + coalesce(1.0::DOUBLE / (60 + kw_rank), 0) AS score, sem_rank, kw_rank, concat_ws(',', CASE WHEN kw_rank IS NOT NULL THEN 'keyword' END, CASE WHEN sem_rank IS NOT NULL THEN 'semantic' END) AS sources FROM sem FULL JOIN kwd ON sem.id = kwd.id)",
        f"cand AS (SELECT fused.*, session_id, row_number() OVER o AS n, regexp_replace(regexp_replace(lower(question), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS nq, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(question), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') ORDER BY score DESC, sem_rank NULLS LAST, kw_rank NULLS LAST, id) AS nth FROM fused JOIN docs USING (id) WHERE {where} WINDOW o AS (ORDER BY score DESC, sem_rank NULLS LAST, kw_rank NULLS LAST, id))",
        f"hits AS (SELECT *, row_number() OVER (ORDER BY n) AS place FROM (SELECT * FROM cand WHERE nq = '' OR nth = 1 ORDER BY n LIMIT {k}))",
        tail,
    )


def hybrid(spark, sf, k=10, **filters):
    found = sr.search(docs(spark, sf), vectors(spark, sf), ASKED, asked(spark, sf), k, index=stored_index(spark, sf), **filters)
    return found.select("id", F.round("score", 9).alias("score"), "sources", F.col("place").cast("long").alias("place"))


@query("rrf_hybrid", hybrid_sql(80, "TRUE", 10))
def rrf_hybrid(spark, sf):
    return hybrid(spark, sf)


@query("search_filtered", hybrid_sql(1000, "source IN ('codex', 'nothing') AND (starts_with(session_id, 'ssrc1') OR contains(project, 'ssrc1'))", 10))
def search_filtered(spark, sf):
    return hybrid(spark, sf, sources=("codex", "nothing"), session="ssrc1")


@query("search_source_default", hybrid_sql(80, "source IN ('claude-code', '')", 10))
def search_source_default(spark, sf):
    return hybrid(spark, sf, sources=("claude",))


@query("search_date_window", hybrid_sql(80, "timestamp >= '2026-01-01T15:00:00Z' AND timestamp < '2026-01-03T15:00:00Z'", 10))
def search_date_window(spark, sf):
    return hybrid(spark, sf, since="2026-01-02", until="2026-01-03")


@query("search_hidden", hybrid_sql(80, "id::BIGINT % 2 = 1", 10))
def search_hidden(spark, sf):
    return hybrid(spark, sf, hidden=docs(spark, sf).where("cast(id AS long) % 2 = 0"))


@query("search_folder_scope", hybrid_sql(1000, "id IN (SELECT regexp_extract(ref, '[0-9]+') FROM item WHERE folder_id IN (SELECT id FROM folders WHERE parent_id = 2))", 10))
def search_folder_scope(spark, sf):
    f = folders(spark, sf)
    inside = fo.paths(f, f.where("id = 2")).select(F.col("id").alias("folder_id"))
    allowed = items(spark, sf).join(inside, "folder_id", "left_semi").select(F.regexp_extract("ref", "[0-9]+", 0).alias("id")).distinct()
    return hybrid(spark, sf, allowed=allowed)


@query("find_related", hybrid_sql(160, "TRUE", 20, "SELECT id, place FROM hits WHERE session_id <> 'ssrc0' ORDER BY place LIMIT 5"))
def find_related(spark, sf):
    hits = sr.search(docs(spark, sf), vectors(spark, sf), ASKED, asked(spark, sf), 20, index=stored_index(spark, sf))
    return sr.related(hits, docs(spark, sf), "ssrc0", 5).select("id", F.col("place").cast("long").alias("place"))


@query("date_bounds", sql(DOCS, "SELECT project AS lang, count(*) AS n FROM docs WHERE timestamp >= '2025-12-31T15:00:00Z' AND timestamp < '2026-01-02T15:00:00Z' GROUP BY project"))
def date_bounds(spark, sf):
    rows = docs(spark, sf).where(times.within(F.col("timestamp"), "2026-01-01", "2026-01-02"))
    return rows.groupBy(F.col("project").alias("lang")).agg(F.count("*").alias("n"))


# Merges: a peer has some turns cut short, some longer, and some of its own.
STATE = ["id", "session_id", "question", "answer", "actions", "source", "source_file", "queued", "parser_version"]


def state(spark, sf):
    return turns(spark, sf).withColumn("actions", F.lit("[]")).withColumn("queued", F.lit(False)).select(*STATE)


def peer(spark, sf):
    n = F.regexp_extract("id", ":(.*)", 1).cast("long")
    rows = state(spark, sf)
    answer = F.when(n % 3 == 0, F.substring("answer", 1, 5)).when(n % 3 == 1, F.concat("answer", F.lit(" and more"))).otherwise(F.concat(F.lit("z"), F.substring("answer", 2, 1 << 30)))
    return rows.withColumn("answer", answer).withColumn("session_id", F.lit("elsewhere")).withColumn("id", F.when(n % 5 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")))


PEER = """state AS (SELECT id, session_id, turn, question, answer, parser_version AS v, length(question) + length(answer) + 2 AS n FROM turns),
peer0 AS (SELECT id || CASE WHEN turn % 5 = 0 THEN 'x' ELSE '' END AS id, 'elsewhere' AS session_id, question, CASE turn % 3 WHEN 0 THEN substr(answer, 1, 5) WHEN 1 THEN answer || ' and more' ELSE 'z' || substr(answer, 2) END AS answer, v FROM state),
peer AS (SELECT *, length(question) + length(answer) + 2 AS n FROM peer0),
met AS (SELECT coalesce(s.id, p.id) AS id, coalesce(s.session_id, p.session_id) AS session_id, s.answer AS sa, p.answer AS pa, s.id IS NULL AS fresh, p.id IS NULL AS alone, p.id IS NOT NULL AND (p.v, p.n) {} (s.v, s.n) AS better FROM state s FULL JOIN peer p ON s.id = p.id)"""
UPSERTED = "SELECT id, session_id, CASE WHEN fresh OR better THEN pa ELSE sa END AS answer, CASE WHEN alone THEN 'kept' WHEN fresh THEN 'inserted' WHEN better THEN 'replaced' ELSE 'rejected' END AS outcome FROM met"


@query("upsert_rank", sql(TURNS, PEER.format(">="), UPSERTED))
def upsert_rank(spark, sf):
    return me.upsert(state(spark, sf), peer(spark, sf)).select("id", "session_id", "answer", "outcome")


@query("import_merge", sql(TURNS, PEER.format(">"), UPSERTED))
def import_merge(spark, sf):
    return me.upsert(state(spark, sf), peer(spark, sf), strict=True).select("id", "session_id", "answer", "outcome")


@query("latest_versions", sql(TURNS, PEER.format(">"), "u AS (SELECT id, answer, v, n, 1 AS arrival FROM state UNION ALL SELECT id, answer, v, n, 2 FROM peer)", "SELECT id, arg_max(answer, (v, n, arrival)) AS answer FROM u GROUP BY id"))
def latest_versions(spark, sf):
    versions = state(spark, sf).withColumn("arrival", F.lit(1)).union(peer(spark, sf).withColumn("arrival", F.lit(2)))
    return me.latest(versions).select("id", "answer")


@query("lww_titles", "WITH l AS (SELECT c_custkey AS k, c_name AS value, (c_custkey * 37 % 1000)::DOUBLE AS t FROM customer), p AS (SELECT k, 'peer ' || value AS value, (k * 53 % 1200)::DOUBLE * 100 AS t FROM l), u AS (SELECT *, 1 AS m FROM l UNION ALL SELECT *, 0 FROM p WHERE t <= 1000 + 86400) SELECT k AS session_id, arg_max(value, (t, m)) AS value, max(t) AS \"at\" FROM u GROUP BY k")
def lww_titles(spark, sf):
    local = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("value"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("at"))
    other = local.select("session_id", F.concat(F.lit("peer "), "value").alias("value"), ((F.col("session_id") * 53 % 1200).cast("double") * 100).alias("at"))
    return me.last_writer(local, other, "session_id", 1000.0)


@query("tombstones", "SELECT c_custkey AS uid, c_custkey * 37 % 1000 AS \"at\" FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey * 7 % 1000) AS r FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE r IS NULL OR r < c_custkey * 37 % 1000")
def tombstones(spark, sf):
    live = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") * 37 % 1000).alias("at"))
    tombs = table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), (F.col("o_orderkey") * 7 % 1000).alias("removed_at"))
    return me.with_tombstones(live, tombs)


@query("folders_attach", "SELECT n_nationkey AS uid, r_regionkey AS parent, r_regionkey IS NULL AS parked FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 1000, NULL, FALSE FROM region WHERE r_regionkey <> 3")
def folders_attach(spark, sf):
    top = table(spark, sf, "region").where("r_regionkey <> 3").select((F.col("r_regionkey") + 1000).alias("uid"), F.lit(None).cast("int").alias("parent_uid"))
    below = table(spark, sf, "nation").select(F.col("n_nationkey").alias("uid"), (F.col("n_regionkey") + 1000).alias("parent_uid"))
    return me.attached(top.union(below)).select("uid", (F.col("parent") - 1000).alias("parent"), "parked")


@query("reconcile_orphans", "SELECT 'd' || vec_id || '#0' AS chunk_key FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def reconcile_orphans(spark, sf):
    keys = table(spark, sf, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string"), F.lit("#0")).alias("chunk_key"))
    return me.orphans(keys, table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")))


@query("conflict_classify", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents), c AS (SELECT doc_id, b, CASE doc_id % 4 WHEN 0 THEN b WHEN 1 THEN list_append(b, 'x') WHEN 2 THEN b[1:len(b) - 1] ELSE list_append(b[1:len(b) - 1], 'y') END AS c FROM l) SELECT doc_id, CASE WHEN b = c THEN 'identical' WHEN len(b) < len(c) AND c[1:len(b)] = b THEN 'conflict_wins' WHEN len(c) < len(b) AND b[1:len(c)] = c THEN 'base_wins' ELSE 'fork' END AS verdict FROM c")
def conflict_classify(spark, sf):
    b = F.split("text", "\n")
    rows = table(spark, sf, "documents").select("doc_id", b.alias("b"))
    short = F.slice("b", 1, F.size("b") - 1)
    d = F.col("doc_id") % 4
    other = F.when(d == 0, F.col("b")).when(d == 1, F.concat("b", F.array(F.lit("x")))).when(d == 2, short).otherwise(F.concat(short, F.array(F.lit("y"))))
    return rows.select("doc_id", me.classify(F.col("b"), other).alias("verdict"))


@query("sync_roll_up", "SELECT l_suppkey AS device, least(greatest(min(l_discount * 1200 - 10), 0.0::DOUBLE), 100.0::DOUBLE) AS percent FROM lineitem GROUP BY l_suppkey")
def sync_roll_up(spark, sf):
    return me.roll_up(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("device"), (F.col("l_discount") * 1200 - 10).alias("percent")))


# Events stand for raw records: {"type": event_type, "payload": props}.
LINES = "line AS (SELECT event_id, user_id, '{\"type\":\"' || event_type || '\",\"payload\":{\"type\":\"p' || (event_id % 3) || '\",\"item\":{\"type\":\"' || CASE WHEN event_id % 2 = 0 THEN 'i' ELSE '' END || '\"}}' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END AS line FROM events)"


def lines(spark, sf):
    e = F.col("event_id")
    text = F.concat(
        F.lit('{"type":"'), F.col("event_type"), F.lit('","payload":{"type":"p'), (e % 3).cast("string"), F.lit('","item":{"type":"'), F.when(e % 2 == 0, "i").otherwise(""), F.lit('"}}'), F.when(e % 11 == 0, "").otherwise("}")
    )
    return table(spark, sf, "events").select(F.col("user_id").alias("file"), e.alias("offset"), e.alias("end_offset"), text.alias("line"))


@query("schema_fingerprint", "SELECT 'type' AS level, event_type AS name, count(*) AS n FROM events WHERE event_id % 11 > 0 GROUP BY 2 UNION ALL SELECT 'payload', 'p' || (event_id % 3), count(*) FROM events WHERE event_id % 11 > 0 GROUP BY 2 UNION ALL SELECT 'item', 'i', count(*) FROM events WHERE event_id % 11 > 0 AND event_id % 2 = 0")
def schema_fingerprint(spark, sf):
    return qu.fingerprint(lines(spark, sf).where(F.try_parse_json("line").isNotNull()))


REPORT = """l AS (SELECT user_id % 10 AS source, user_id AS file, event_id AS e, event_id % 11 > 0 AND user_id % 13 <> 5 AS sound,
  CASE WHEN event_id % 5 = 0 THEN 'session_meta' ELSE event_type END AS t FROM events),
f AS (SELECT source, bool_or(sound) AS readable, bool_or(sound AND t = 'purchase') AS with_turns FROM l GROUP BY source, file)"""


@query(
    "schema_report",
    sql(REPORT, """SELECT source, 'type' AS level, t AS name, count(*) AS n FROM l WHERE sound GROUP BY 1, 3
UNION ALL SELECT source, 'payload', 'p' || (e % 3), count(*) FROM l WHERE sound GROUP BY 1, 3
UNION ALL SELECT source, 'item', 'i', count(*) FROM l WHERE sound AND e % 2 = 0 GROUP BY 1
UNION ALL SELECT source, 'version', 'v' || (e % 4), count(*) FROM l WHERE sound AND t = 'session_meta' GROUP BY 1, 3
UNION ALL SELECT source, 'file', 'scanned', count(*) FROM f GROUP BY 1
UNION ALL SELECT source, 'file', 'with_turns', count(*) FROM f WHERE with_turns GROUP BY 1
UNION ALL SELECT source, 'file', 'without_turns', count(*) FROM f WHERE readable AND NOT with_turns GROUP BY 1
UNION ALL SELECT source, 'file', 'unreadable', count(*) FROM f WHERE NOT readable GROUP BY 1"""),
)
def schema_report(spark, sf):
    """Files of ten sources, with session records that tell a version and files without a sound line."""
    e = F.col("event_id")
    payload = F.struct(F.concat(F.lit("p"), e % 3).alias("type"), F.concat(F.lit("v"), e % 4).alias("cli_version"), F.struct(F.when(e % 2 == 0, "i").otherwise("").alias("type")).alias("item"))
    line = F.to_json(F.struct(F.when(e % 5 == 0, "session_meta").otherwise(F.col("event_type")).alias("type"), payload.alias("payload")))
    line = F.when((e % 11 == 0) | (F.col("user_id") % 13 == 5), F.concat(F.lit("{"), line)).otherwise(line)
    rows = table(spark, sf, "events").select((F.col("user_id") % 10).alias("source"), F.col("user_id").alias("file"), line.alias("line"))
    return qu.report(rows, qu.at("$.type") == "purchase")


@query("corrupt_lines", "SELECT user_id AS file, count(*) AS bad_lines, min(event_id) AS first_offset FROM events WHERE event_id % 11 = 0 GROUP BY user_id")
def corrupt_lines(spark, sf):
    return qu.corrupt(lines(spark, sf))


@query("drift_rule", "WITH f AS (SELECT user_id % 10 AS source, user_id, count(*) AS records, count(*) FILTER (event_type = 'purchase' AND user_id % 10 > 4) AS turns FROM events GROUP BY user_id) SELECT source, count(*) AS files, count(*) FILTER (turns > 0) AS files_with_turns, count(*) FILTER (turns > 0) = 0 AND sum(records) > 5 AND source NOT IN (1, 2) AS drifted FROM f GROUP BY source")
def drift_rule(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("records"), F.count(F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 10 > 4), 1)).alias("turns"))
    readable = spark.createDataFrame([(1,), (2,)], "source long")
    return qu.drift(rows.withColumn("source", F.col("user_id") % 10), readable)


@query("redacted_samples")
def redacted_samples(spark, sf):
    return qu.samples(lines(spark, sf))


@query("record_cap", sql(LINES, "SELECT user_id AS file, least(count(*), 5) AS n FROM line GROUP BY user_id"))
def record_cap(spark, sf):
    return qu.capped(lines(spark, sf), 5).groupBy("file").agg(F.count("*").alias("n"))


# The map: labels are clusters, words of documents are tags.
TAGS = "tags AS (SELECT label AS cluster, vec_id AS point, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS tag FROM embeddings JOIN documents ON doc_id = vec_id), counts AS (SELECT cluster, tag, count(*) AS tf, size FROM tags JOIN (SELECT cluster, count(DISTINCT point) AS size FROM tags GROUP BY cluster) USING (cluster) GROUP BY ALL)"


def counted_tags(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))
    rows = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("doc_id") == F.col("vec_id"))
    return sm.tag_counts(rows.select(F.col("label").alias("cluster"), F.col("vec_id").alias("point"), F.explode(words).alias("tag")))


@query(
    "cluster_tags",
    sql(TAGS, "k AS (SELECT count(DISTINCT cluster)::DOUBLE AS k FROM tags)", "s AS (SELECT cluster, tag, tf, size, tf * ln(k / df) AS score FROM counts JOIN (SELECT tag, count(*) AS df FROM counts GROUP BY tag) USING (tag), k WHERE tf >= CASE WHEN size >= 10 THEN 2 ELSE 1 END AND ln(k / df) > 0)", "r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, tf DESC, tag) AS place FROM s)", "SELECT cluster, place, tag, round(score, 6) AS score FROM r WHERE place <= 4"),
)
def cluster_tags(spark, sf):
    counts = counted_tags(spark, sf)
    n = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("doc_id") == F.col("vec_id")).select("label").distinct().count()
    return sm.distinctive_tags(counts, n).select("cluster", F.col("place").cast("long").alias("place"), "tag", F.round("score", 6).alias("score"))


@query("cluster_common_tags", sql(TAGS, "r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY tf DESC, tag) AS n FROM counts)", "q AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY tf DESC, tag) AS place FROM r WHERE n <= 6 AND tf >= CASE WHEN size >= 10 THEN 2 ELSE 1 END)", "SELECT cluster, place, tag FROM q WHERE place <= 4"))
def cluster_common_tags(spark, sf):
    return sm.common_tags(counted_tags(spark, sf)).withColumn("place", F.col("place").cast("long"))


def points(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("cluster"), (v % 40).alias("turn_id"), F.concat(F.lit("s"), (v % 17).cast("string")).alias("session_id"), stamp(v % 24, v % 60).alias("timestamp"), v.alias("idx"), v.cast("string").alias("key"),
        F.transform("embedding", lambda x: x.cast("double")).alias("coords"),
    )


@query("cluster_summary", "WITH w AS (SELECT label, count(*) AS points, count(DISTINCT vec_id % 40) AS turns FROM embeddings GROUP BY label), e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT label AS cluster, points, turns, dim, round(avg(x), 6) AS centre FROM e JOIN w USING (label) GROUP BY ALL")
def cluster_summary(spark, sf):
    rows = sm.summary(points(spark, sf))
    each = rows.select("cluster", "points", "turns", F.posexplode("centroid").alias("dim", "centre"))
    return each.withColumn("dim", F.col("dim").cast("long")).withColumn("centre", F.round("centre", 6))


@query("session_paths", "WITH p AS (SELECT 's' || (vec_id % 17) AS session_id, strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(vec_id % 24) + to_minutes(vec_id % 60), '%Y-%m-%dT%H:%M:%SZ') AS ts, vec_id FROM embeddings) SELECT session_id, string_agg(vec_id::VARCHAR, ',' ORDER BY ts, vec_id) AS keys FROM p GROUP BY session_id HAVING count(*) >= 2")
def session_paths(spark, sf):
    return sm.paths(points(spark, sf)).select("session_id", F.array_join("keys", ",").alias("keys"))


@query("cluster_members", "SELECT label AS cluster, vec_id % 40 AS turn_id, min(vec_id::VARCHAR) AS key FROM embeddings GROUP BY ALL")
def cluster_members(spark, sf):
    return sm.members(points(spark, sf))


@query("cluster_overlap_jaccard", "WITH n AS (SELECT label AS c, vec_id AS k FROM embeddings), o AS (SELECT CASE WHEN vec_id % 5 = 0 THEN label + 1 ELSE label END AS c, vec_id AS k FROM embeddings WHERE vec_id % 7 > 0), j AS (SELECT n.c AS new_id, o.c AS old_id, count(*)::DOUBLE AS s FROM n JOIN o USING (k) GROUP BY ALL), r AS (SELECT new_id, old_id, s / ((SELECT count(*) FROM n WHERE c = new_id) + (SELECT count(*) FROM o WHERE c = old_id) - s) AS jaccard FROM j) SELECT new_id, old_id, round(jaccard, 6) AS jaccard FROM r WHERE jaccard >= 0.2")
def cluster_overlap_jaccard(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("key"))
    old = rows.where("key % 7 > 0").select(F.when(F.col("key") % 5 == 0, F.col("cluster") + 1).otherwise(F.col("cluster")).alias("cluster"), "key")
    return sm.overlaps(rows, old).select("new_id", "old_id", F.round("jaccard", 6).alias("jaccard"))


@query("pca_projection")
def pca_projection(spark, sf):
    return sm.projected(table(spark, sf, "embeddings"), 2).select("vec_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return sm.clustered(table(spark, sf, "embeddings")).select("vec_id", "cluster")


@query("density_clusters")
def density_clusters(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = density.clustered(vectors)
    if found is None:  # too few vectors, or none in heaps
        found = sm.clustered(vectors).withColumn("dense", F.lit(False))
    return found.select("vec_id", "cluster", "dense")


@query("idle_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 86400 SECOND THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT user_id, min(ts)::VARCHAR AS started, max(ts)::VARCHAR AS ended, count(*) AS n FROM g GROUP BY user_id, g")
def idle_sessions(spark, sf):
    rows = inc.activity(table(spark, sf, "events"), "user_id", "ts", 86_400)
    return rows.select("user_id", F.col("started").cast("string").alias("started"), F.col("ended").cast("string").alias("ended"), "n")


@query("backfill_missing", sql(TURNS, HARD_CHUNKS, "SELECT chunk_key, input FROM chunk WHERE (turn + i) % 3 <> 0"))
def backfill_missing(spark, sf):
    t = turns(spark, sf)
    chunks = hard_chunks(t)
    with_vector = chunks.where((F.regexp_extract("turn_id", ":(.*)", 1).cast("long") + F.col("idx")) % 3 == 0)
    return inc.missing_vectors(t, chunks.drop("idx"), with_vector)


@query("turn_slices", sql(TURNS, "SELECT id, (turn - min(turn) OVER (PARTITION BY session_id)) // 4 AS slice FROM turns"))
def turn_slices(spark, sf):
    return inc.slices(turns(spark, sf), 4).select("id", "slice")


@query("enrich_extractive")
def enrich_extractive(spark, sf):
    return enrich.enriched(turns(spark, sf)).select("id", "summary", F.array_join("tags", ",").alias("tags"))


