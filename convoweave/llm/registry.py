"""The queries of this subpackage: one per operator, and the pipeline; their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("mixing", "exact_dedup", "simhash", "main_text", "secrets", "vector_dedup", "toxicity", "archive", "url_filter", "piece_bpe", "whitening", "vector_file", "spelling")


def queries() -> dict:
    import corpus_pipeline

    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").ORACLE_SQL
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
