"""SimHash against brute force, components, and the mixing's promises."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from convoweave.llm import mixing, rows, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize(("segments", "tile"), [(8, 4096), (4, 3), (16, 2)])
def test_links_of_planted_fingerprints(spark, segments, tile):
    rng = random.Random(segments)
    fps = [0, 2**64 - 1]
    for _ in range(40):
        fps.append(rng.getrandbits(64))
        for _ in range(3):
            fps.append(fps[-1] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    fps = list(dict.fromkeys(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    found = rows.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), segments=segments, tile=tile))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = brute_components(dict(enumerate(fps)))
    root = {k: min(signed[j] for j in want if want[j] == want[k]) for k in want}
    assert {k: got.get(signed[k], signed[k]) for k in want} == root


def test_simhash_odd_rows(spark):
    data = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "x " * 5000), (5, " \t\n")]
    found = simhash.near_groups(spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, fp string")).collect()
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in found)
    assert got == [(-1, None), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (5, 1)]
    assert {r["fingerprint"] for r in found if r["doc_id"] in (1, 2, 5)} == {"0" * 16}
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3)]
    found = {r["node"]: r["root"] for r in rows.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 100 for k in range(100, 161))
    assert all(found[k] == 7 for k in range(7, 60))


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.plan(docs).cache()
    total = plan.groupBy().sum("size").first()[0]
    by = plan.groupBy("source").agg({"taken": "sum", "target": "first", "size": "sum"}).collect()
    assert abs(sum(r["first(target)"] for r in by) - total) < 1e-6 * total
    for r in by:
        assert abs(r["sum(taken)"] - r["first(target)"]) <= 2 * mixing.BLOCK
        assert r["first(target)"] <= 3 * r["sum(size)"]
    assert plan.where("taken > 3 * size").count() == 0
    words = sum(len(t["text"].split()) for t in mixing.mixed(docs).collect())
    assert abs(words - plan.groupBy().sum("taken").first()[0]) <= 0.001 * words


def test_mix_of_many_shards_and_odd_rows(spark):
    rng = random.Random(5)
    data = [(k, "w " * rng.randint(0, 90), rng.choice(["b", "a", None, "é"])) for k in range(400)] + [(None, "x y", "a"), (7, None, "a"), (7, None, "a")]
    docs = spark.createDataFrame([(i, t, s, 0, "z") for i, t, s in data], "doc_id long, text string, source string, n_chars long, shard string")
    plan = mixing.plan(docs, block=8, shard=500).cache()
    assert plan.count() == len(data)
    for r in plan.groupBy("source").agg({"taken": "sum", "target": "first", "source_size": "first"}).collect():
        assert abs(r["sum(taken)"] - r["first(target)"]) <= 0.08 * r["first(source_size)"] + 8
    assert plan.where("taken > 3 * size OR taken < 0").count() == 0
    empty = docs.limit(0)
    assert mixing.plan(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_textual_identifiers_and_hot_fingerprints(spark, monkeypatch):
    data = [(f"d{k:03d}", "") for k in range(60)] + [("e1", "one two three four"), ("a9", "ONE two three  four"), (None, "one two three four")]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id string, text string, fp int").repartition(3)
    for small in (1 << 20, 0):
        monkeypatch.setattr(rows, "BROADCAST_BYTES", small)
        got = {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
        assert got == {(i, "d000") for i, t in data if not t} | {("e1", "a9"), ("a9", "a9"), (None, None)}
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.near_groups(docs.limit(0)).count() == simhash.one_of_each(docs.limit(0)).count() == 0
