"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

toxicity drops rejected documents; exact dedup keeps the smallest doc_id of equal texts; SimHash keeps the smallest of each
component; mixing repeats or cuts documents to the target weights; the last stage gives token counts and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from convoweave.llm import exact_dedup, mixing, piece_bpe, simhash, toxicity
from convoweave.session import new_path, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on a bounded sample of `labels`, does not reject."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document, or a part of it, is taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row."""
    return piece_bpe.token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("mixing sources", mix_sources), ("SentencePiece", tokens)]
ORACLE_SQL = None  # the classifier and the tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
