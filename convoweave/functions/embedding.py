"""Embedding texts in tasks, by an injected function; the default hashes words and needs no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, types as T
from pyspark.sql.functions import pandas_udf

Embedder = Callable[[Sequence[str]], np.ndarray]
PASSAGE, QUERY = "passage: ", "query: "
DIMS = 256


def hashed(texts: Sequence[str], dims: int = DIMS) -> np.ndarray:
    """Signed word and word-pair hashes; texts that share words are near."""
    out = np.zeros((len(texts), dims), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = re.findall(r"\w+", text.lower().removeprefix(PASSAGE).removeprefix(QUERY))
        for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            h = zlib.crc32(w.encode())
            row[h % dims] += 1 if h >> 16 & 1 else -1
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def embedded(text: Column, embedder: Embedder = hashed) -> Column:
    """The vectors of passages, of length one, as array<float>."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(unit(embedder([PASSAGE + (t or "") for t in texts]).astype(np.float32))))

    return run(text)


def query_vector(query: str, embedder: Embedder = hashed) -> list[float]:
    return unit(embedder([QUERY + query]))[0].astype(float).tolist()
