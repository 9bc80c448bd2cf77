"""Spelling variant grouping by a symmetric-delete join.

Words are counted by one aggregation over all runs of letters. Every word then emits keys for itself and for each of its
distinct single deletions. A key is a number: the sum of a mix of each code point times a power by its place, of which any
deletion follows from the prefix sums, so a word of n letters makes its keys in n steps and never spells its deletions out.
Words that differ by one inserted, deleted or replaced code point share exactly one deletion (or the one word is a deletion
of the other), so they meet exactly once in an equi-join of the keys; words that are further apart and meet (two letters
that changed places) or whose keys are equal by chance fall to the check of the exact distance. A key is shared by as many
words as one letter can be put into it at most, so no bucket grows with the corpus.

A word's near words are counted, and its form found, by one aggregation of the checked pairs. Forms are joined
to their own forms until nothing changes, each round doubling the steps; as counts grow tenfold at each step, the
rounds grow with the logarithm of the logarithm of the largest count.

`counted` has runs of letters dropped at random (by crc32 of document and run), as a stated noise; `noise` of 0 has none.

Defined results: null and empty texts have no words; a null doc_id is written as an empty string; repeated rows count each
time; words of any length are whole; ties go to the smallest in code-point order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from convoweave.llm.rows import slices
from convoweave.llm.url_filter import LOWER, UPPER
from convoweave.session import cut, table

LETTERS = "[A-Za-zÀ-ÿ]"
NOISE, SHORTEST, LEAST, RATIO = 31, 7, 2, 10
LETTERS_AT_ONCE = 1 << 18
#: An odd multiplier and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n: the words of all texts with at least `shortest` code points and `least` occurrences."""
    runs = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{shortest},}}+"), F.lit(0))).alias("run"),
    )
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = runs.select("doc", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    word = F.col("run")
    if noise:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        word = F.when(h % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mixed(points: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each code point."""
    z = points.astype(np.uint64) + np.uint64(1)
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(multiplier)
    return z ^ (z >> np.uint64(31))


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each word and of its distinct single deletions, and the place of the word of each."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[owner]
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(1, sizes.max(initial=0)), BASE, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(mixed(points) * powers[place], dtype=np.uint64)]
    whole = sums[starts + sizes] - sums[starts]
    first = np.r_[True, (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])][: len(points)]  # of a letter in a row, one deletion
    at = np.flatnonzero(first)
    begun = sums[starts[owner[at]]]
    deleted = (sums[at] - begun) + (sums[starts[owner[at]] + sizes[owner[at]]] - sums[at + 1]) * np.uint64(BACK)
    lengths = np.r_[sizes, sizes[owner[at]] - 1].astype(np.uint64)
    keys = np.r_[whole, deleted] + lengths * np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    return keys.view(np.int64), np.r_[np.arange(len(words)), owner[at]]


def emitted(words: DataFrame) -> DataFrame:
    """key and id: of every word of `words` (id, word) itself and its distinct single deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            ids, listed = b.column("id").to_numpy(), b.column("word").to_pylist()
            ends = np.cumsum([len(w) for w in listed])
            for k in np.unique(ends // LETTERS_AT_ONCE).tolist():
                some = np.flatnonzero(ends // LETTERS_AT_ONCE == k)
                keys, owner = keys_of([listed[j] for j in some])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[some][owner])], ["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (ids): the pairs of `words` (id, word) at exact distance one, each once."""
    keys = emitted(words)
    met = keys.join(keys.select("key", F.col("id").alias("other")), "key").where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    for side in ("a", "b"):
        met = met.join(words.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}")), side)
    return met.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """`links` (id, form: ids, without circles) with root: where the forms of forms end."""
    state = cut(links.withColumn("root", F.col("form")))
    while True:
        ahead = state.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        moved = state.join(ahead, F.col("root") == F.col("_id"), "left")
        state = cut(moved.select("id", "form", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("went")))
        if not state.where("went").limit(1).count():
            return state.drop("went")
        state = state.drop("went")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of `words` (word, n)."""
    words = cut(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = cut(near_pairs(words))
    both = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    sized = both.join(words.select("id", "n"), "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("_word"), F.col("n").alias("_n")), "other")
    best = F.min(F.when(F.col("_n") >= ratio * F.col("n"), F.struct((-F.col("_n")).alias("less"), "_word", "other")))
    near = cut(sized.groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best")))
    ends = roots(near.where("best IS NOT NULL").select("id", F.col("best.other").alias("form")))
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    found = words.join(near, "id", "left").join(ends, "id", "left")
    return found.select("word", F.col("best._word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of the words of all `documents`."""
    return variants(counted(table(spark, sf_dir, "documents")))


QUERIES = {"op12_spelling": op12_spelling}
ORACLE_SQL = {
    # A crc32 by its rule, bit by bit: the polynomial is 0xEDB88320. A word's keys are itself and its deletions, spelt out; a
    # word and a longer one that share a key are near. DuckDB's levenshtein compares bytes, so places are compared instead.
    "op12_spelling": """
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc,
     translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
distinct_runs AS (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
     lambda c, byte: list_reduce(list_prepend(xor(c, byte), range(0, 8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h FROM distinct_runs),
noised AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM noised WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
keys AS (SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS k FROM words),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b USING (k) WHERE a.word <> b.word AND (length(a.word) <> length(b.word)
     OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1)),
told AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, w := other)) FILTER (other_n >= 10 * n) AS best FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, best.w AS form, (-best.less)::BIGINT AS form_n FROM words LEFT JOIN told USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
}
