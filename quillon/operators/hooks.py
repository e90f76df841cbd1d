"""Places where a model is plugged in: embedding, reranking, token counting. The defaults need no model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION, MOST_TOKENS = 64, 2048


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """Unit vectors of signed word hashes: the same for the same text everywhere. A text without words has a zero vector."""
    out = np.zeros((len(texts), DIMENSION))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % DIMENSION] += 1 if h & (1 << 40) else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size, size, 1)


def overlap_reranker(queries: list[str], bodies: list[str]) -> list[float]:
    """The share of the query's words that the body holds."""
    out = []
    for q, b in zip(queries, bodies):
        a, c = set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", b.lower()))
        out.append(len(a & c) / len(a) if a else 0.0)
    return out


def embed(df: DataFrame, text: str, column: str = "embedding", load: Callable[[], Callable] = lambda: hashing_embedder) -> DataFrame:
    """Adds the vector of each text; ``load`` gives the encoder and runs once a worker. Null texts have a null vector.

    Equal texts are encoded once a batch.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            codes, distinct = pd.factorize(s)
            vectors = encode(list(distinct)).astype("float32") if len(distinct) else np.zeros((0, DIMENSION), "float32")
            yield pd.Series([vectors[c] if c >= 0 else None for c in codes])

    return df.withColumn(column, run(F.col(text)))


def rerank(df: DataFrame, query: str, body: str, load: Callable[[], Callable] | None = None, score: str = "score") -> DataFrame:
    """Adds the reranker's score of (query, body); without one the rows pass through with the score they have."""
    if load is None:
        return df

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge = load()
        for q, b in batches:
            yield pd.Series(judge(list(q.fillna("")), list(b.fillna(""))), dtype="float64")

    return df.withColumn(score, run(F.col(query), F.col(body)))


def pending(new: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """Rows that aren't stored under the same identity yet; a null part of an identity is never up to date."""
    return new.join(stored.select(*identity).distinct(), identity, "left_anti")
