"""The pipeline on the driver tables and on planted documents."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from convoweave.llm import exact_dedup, mixing, simhash

SF = "/root/testdata/sf0.01"


def test_each_stage_keeps_the_columns_and_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        n.append(docs.count())
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "exact dedup":
            assert n[-1] == exact_dedup.exact_groups(before).where("kept").count() < n[-2]
            assert exact_dedup.exact_groups(docs).where("NOT kept").count() == 0
        if name == "SimHash near-dedup":
            assert n[-1] == simhash.near_groups(before).select("component_id").distinct().count()
            assert simhash.near_groups(docs).where("doc_id <> component_id").count() == 0
        if name == "mixing sources":
            taken = {r["doc_id"]: r["taken"] for r in mixing.plan(before).where("taken > 0").collect()}
            got: dict[int, int] = {}
            for r in docs.select("doc_id", "text").collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].encode().split())
            assert got == taken
    assert n[1] < n[0]
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)


def test_stages_on_repeated_rows_and_null_identifiers(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string"
    long_text = " ".join(f"w{k}" for k in range(300))
    data = [(1, "same  text here", "en", "a"), (1, "same text here", "en", "a"), (2, "same text here", "en", "b"), (2, "other words stand here", "en", "b"), (3, long_text, "en", None), (3, long_text, "en", None),
            (None, "same text here", "en", "a"), (None, "no id at all", None, "b"), (4, None, "en", "a"), (5, "", "en", "a")]
    docs = spark.createDataFrame([(*r, 0, "clash") for r in data], schema).repartition(3)
    once = exact_dedup.one_of_each(docs)
    assert once.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, " ".join((r["text"] or "").split())) for r in once.collect())
    assert kept == [(0, "no id at all"), (1, "same text here"), (2, "other words stand here"), (3, long_text), (4, "")]
    near = sorted((r["doc_id"] or 0, " ".join((r["text"] or "").split())) for r in simhash.one_of_each(docs.where("text <> ''")).collect())
    assert [x for x in near if x[0]] == [(1, "same text here"), (2, "other words stand here"), (3, long_text)]
    assert [x for x in near if not x[0]] == [(0, "no id at all"), (0, "same text here")]
    for mix in (mixing.mixed(docs, block=2, shard=100), mixing.mixed(docs)):
        assert mix.columns == docs.columns
        got = sum(len(r["text"].split()) for r in mix.collect())
        assert 0 < got <= 3 * sum(len((t or "").split()) for _, t, _, _ in data)
    plan = mixing.plan(docs, block=2, shard=100)
    assert sum(len(r["text"].split()) for r in mixing.mixed(docs, block=2, shard=100).collect()) == plan.groupBy().sum("taken").first()[0]


def test_reruns_agree(spark):
    one, two = (sorted(map(tuple, cp.run(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert one == two
    assert len(one) > 0


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_columns_whose_names_clash(spark, tmp_path):
    """Columns named like those that the stages make for themselves stay as they are."""
    names = ("fp", "size", "target", "taken", "kept", "keep_id", "component_id", "source_size", "n", "part", "_row_digest")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), "doc_id"))
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns, name
        assert docs.where(" OR ".join(f"`{c}` <> '{j}:' || doc_id" for j, c in enumerate(names))).count() == 0, name
    assert docs.count() > 0
