"""SimHash near-deduplication by tiled exact comparison.

A document's fingerprint holds, for each of 64 bits, whether over half of its 3-word shingle hashes have it. Equal
fingerprints are one class from the start. Classes are laid into tiles by the population counts of the
fingerprint's segments. Two fingerprints within the radius differ, in the sum over segments, by at most the radius in
these counts; so a tile meets the tiles whose counts lie that near, and all other tile pairs are skipped. In a tile,
numpy compares exactly (exclusive-or, bit counts). Each class goes to its own tile as a member and to half of the
neighbouring tiles as a guest, so each pair of tiles meets once.

Tiles of over TILE members are dealt over sub-tiles by hash, to which guests go one and all; members of a sub-tile
are held, guests stream by. A task gives a spanning forest of the links that it sees (all components, no
quadratic list), and alternating stars give the component of every class.

More `segments` mean fewer comparisons and more guests: 8 (73 rows a class) suit up to some 10^9 classes, 16 (274)
more. Either gives the same links.

Identifiers may be of any type that has an order. Defined results: null and blank texts have fingerprint zero and link like any other; rows without an identifier
have a fingerprint and no component; repeated rows link to each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from xxhash import xxh64_intdigest

from convoweave.llm.rows import Forest, components, kept_rows, salted_join, slices, small_or_shuffled
from convoweave.session import cut, table

WORDS, SEED, BITS = 3, 42, 64
TILE = 4096
BLOCK = 1 << 14  # hashes counted at once
PAIRS = 1 << 20  # pairs compared at once


def fingerprint(raw: bytes | None) -> int:
    words = (raw or b"").lower().split()  # on bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= WORDS:
        hashes = np.array([xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = list(accumulate(map((1).__add__, map(len, words))))
        spans = zip([0, *ends], ends[WORDS - 1 :], strict=False)
        hashes = np.fromiter((xxh64_intdigest(line[a : b - 1], SEED) for a, b in spans), np.uint64, len(words) - WORDS + 1)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def text_digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and digest (SHA-256 of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2)], ["doc_id", "fp", "digest"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"), text_digest(text).alias("digest"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fp", "long").add("digest", "string"))


def half_offsets(segments: int, radius: int) -> np.ndarray:
    """Zero, and of each other pair of opposite count differences within the radius one."""
    found = [np.zeros(segments, np.int64)]
    for n in range(1, radius + 1):
        for places in product(range(segments), repeat=n):
            for signs in product((1, -1), repeat=n):
                d = np.zeros(segments, np.int64)
                np.add.at(d, list(places), signs)
                found.append(d)
    distinct = np.unique(np.array(found), axis=0)
    first = np.array([next((x for x in d if x), 1) for d in distinct])
    return distinct[first > 0]


def tile_rows(classes: DataFrame, segments: int, radius: int) -> DataFrame:
    """key, fp, home: each class once in its own tile, and as a guest in the tiles that it has to meet."""
    width, step = BITS // segments, (BITS // segments).bit_length()
    if segments * step > 63:
        step = 0
    offsets = half_offsets(segments, radius)
    weights = (1 << step * np.arange(segments, dtype=np.int64)) if step else (np.uint64(width + 1) ** np.arange(segments, dtype=np.uint64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            fp = b.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = bits.reshape(len(fp), segments, width).sum(axis=2, dtype=np.int64)
            near = counts[:, None, :] + offsets[None]
            row, at = np.nonzero(((near >= 0) & (near <= width)).all(axis=2))
            keys = np.r_[counts @ weights, near[row, at] @ weights]
            home = np.r_[np.ones(len(fp), bool), np.zeros(len(row), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.r_[fp, fp[row]]), pa.array(home)], ["key", "fp", "home"])

    return classes.select("fp").mapInArrow(run, "key long, fp long, home boolean")


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key and sub, members first, as stars of a spanning forest."""
    forest, held = Forest(), None
    for b in batches:
        key, sub, fp, home = (b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "sub", "fp", "home"))
        if held is not None and (held[0][0], held[1][0]) == (key[0], sub[0]):
            key, sub, fp = (np.r_[x, y] for x, y in zip(held, (key, sub, fp), strict=True))
            home = np.r_[np.ones(len(held[0]), bool), home]
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]) - 1
        members = np.flatnonzero(home)
        n = np.bincount(group[members], minlength=group[-1] + 1)
        first = np.cumsum(n) - n  # of each group's members, among `members`
        # A class is also a guest of its own tile, whose members it meets.
        guests = np.flatnonzero(~home & (n[group] > 0))
        many = n[group[guests]]
        last = members[group[members] == group[-1]]
        held = (key[last], sub[last], fp[last]) if len(last) else None
        bounds = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + PAIRS, PAIRS))
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            g, m = guests[a : z + 1], many[a : z + 1]
            left = np.repeat(g, m)
            right = members[np.repeat(first[group[g]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            near = np.flatnonzero((np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= radius) & (fp[left] != fp[right]))
            for x, y in zip(fp[left[near]].tolist(), fp[right[near]].tolist(), strict=True):
                forest.link(x, y)
    a, z = forest.links()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])


def links(classes: DataFrame, radius: int = 2, segments: int = 8, tile: int = TILE) -> DataFrame:
    """a, b (fingerprints): links between classes (fp) that join all classes which links within the radius join."""
    rows = tile_rows(classes, segments, radius)
    large = cut(rows.where("home").groupBy("key").count().where(F.col("count") > tile).select(F.col("key").alias("_key"), F.ceil(F.col("count") / tile).alias("n")))
    rows = salted_join(rows, large, F.col("key") == F.col("_key"), F.xxhash64("fp"), large.count()).withColumn("n", F.coalesce("n", F.lit(1)))
    subs = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("fp"), "n"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    dealt = rows.select("key", "fp", "home", F.explode(subs).alias("sub")).repartition("key", "sub").sortWithinPartitions("key", "sub", F.desc("home"))
    return dealt.mapInArrow(lambda batches: compare(batches, radius), "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, segments: int = 8, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach) and digest of every row."""
    rows = cut(fingerprints(docs, doc_id, text))
    classes = cut(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(links(classes, radius, segments, tile))
    label = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root")))
    joined = label.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    label = label.join(joined, "root", "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "id").alias("component_id"))
    found = salted_join(rows, label, F.col("fp") == F.col("_fp"), F.xxhash64("doc_id", "digest"), classes.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "digest")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and others) with one row of each component, and all rows without an identifier.

    The component's smallest doc_id stays; of several texts with that doc_id, the one with the smallest digest.
    """
    rows = near_groups(docs)
    first = cut(rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("digest").alias("first"), F.count_distinct("digest").alias("n")).where("n > 1"))
    told = rows.join(small_or_shuffled(first.select("component_id", "first"), first.count(), 128), "component_id", "left")
    kept = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.coalesce("first", "digest")))
    return kept_rows(docs, text_digest(), told.select("doc_id", "digest", kept.alias("kept")).where("doc_id IS NOT NULL"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all of `documents`."""
    return near_groups(table(spark, sf_dir, "documents")).drop("digest")


QUERIES = {"op3_simhash": op3_simhash}
ORACLE_SQL: dict[str, str] = {}
