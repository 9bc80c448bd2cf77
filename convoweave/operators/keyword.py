"""Keyword search: BM25 as SQLite's FTS5 scores it, over any text column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from convoweave.functions.text import COMPAT_TOKEN, TOKEN, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def query_terms(query: str, compat: bool = False) -> list[str]:
    """The terms of a query, repeated ones again; compat: split as ASCII words and Hangul runs."""
    pattern = COMPAT_TOKEN if compat else r"[^\W_]+"
    return [t.lower() for t in re.findall(pattern, query)]


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, term, tf and the document's length: the inverted index, one shuffle at most."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("_t"))
    each = rows.select("doc_id", F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return each.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, limit: int, doc_id: str = "id", text: str = "text", compat: bool = False) -> DataFrame:
    """id and score of the best `limit` documents that have a term of the query.

    Two scans and no shuffle of text: the first gives the corpus figures (one row), the second scores and keeps the
    top of each task. A repeated term counts again; terms in most documents count LEAST_IDF.
    """
    terms = query_terms(query, compat)
    distinct = list(dict.fromkeys(terms))
    rows = docs.select(F.col(doc_id).alias("id"), tokens(F.col(text), TOKEN).alias("_t"))
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)

    def occurrences(term: str):
        return F.size(F.filter("_t", lambda x: x == term)).cast("double")

    counted = rows.select("id", F.size("_t").cast("double").alias("_len"), *(occurrences(t).alias(f"_tf{k}") for k, t in enumerate(distinct)))
    figures = counted.agg(F.count("*"), F.avg("_len"), *(F.count(F.when(F.col(f"_tf{k}") > 0, 1)) for k in range(len(distinct)))).first()
    n, mean = figures[0], figures[1] or 1.0
    weight = 1 - B + B * F.col("_len") / F.lit(float(mean) or 1.0)

    def part(k: int, times: int):
        idf = F.greatest(F.log(F.lit((n - figures[2 + k] + 0.5) / (figures[2 + k] + 0.5))), F.lit(0.0))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        f = F.col(f"_tf{k}")
        return times * idf * f * (K1 + 1) / (f + K1 * weight)

    score = reduce(lambda a, b: a + b, (part(k, terms.count(t)) for k, t in enumerate(distinct)))
    some = reduce(lambda a, b: a | b, (F.col(f"_tf{k}") > 0 for k in range(len(distinct))))
    return counted.where(some).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
