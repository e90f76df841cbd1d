"""Vector scores: expressions for one query vector, Arrow batches for many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, element by element in order (null if either is null)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def literal(vector) -> Column:
    """A query vector as a literal array of doubles."""
    return F.lit([float(x) for x in vector]) if len(vector) else F.array().cast("array<double>")


def score(vector: Column, query) -> Column:
    """Similarity of unit vectors: the inner product, not under 0."""
    return F.greatest(F.lit(0.0), dot(vector, literal(query)))


def distance_score(squared: Column) -> Column:
    """1 minus half the squared distance, not under 0; null counts as 0."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - squared / 2), F.lit(0.0))


def unit_check(vector: Column, tolerance: float = 1e-3) -> Column:
    """Whether all numbers are finite and the norm is 1 within the tolerance."""
    return F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.abs(norm(vector) - 1) <= tolerance)


def batch_scores(df: DataFrame, key: str, vector: str, queries: list[tuple], k: int, digits: int | None = None) -> DataFrame:
    """(query, key, score): the ``k`` best rows of each partition for every query vector, by matrix products of Arrow batches.

    ``queries``: (id, vector) pairs, a stated set. A top-k over all partitions follows where it is wanted. Scores rounded to
    ``digits`` before the cut tie as they do after it, so that no row of a tie is lost.
    """
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)

    def run(batches):
        best_s, best_k = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            s = np.maximum(0.0, matrix @ x.T)
            s = s if digits is None else np.round(s, digits)
            best_s = np.concatenate([best_s, s], 1)
            best_k = np.concatenate([best_k, np.broadcast_to(b.column(0).to_numpy(), s.shape)], 1)
            order = np.lexsort((best_k, -best_s))[:, :k]
            best_s, best_k = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_k, order, 1)
        n = best_s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_k.reshape(-1)), pa.array(best_s.reshape(-1))], names=["query", "key", "score"])

    return df.select(F.col(key).cast("long"), vector).where(f"{vector} IS NOT NULL").mapInArrow(run, "query long, key long, score double")


def nearest_of(df: DataFrame, key: str, vector: str, among: list[tuple], k: int, digits: int = 6) -> DataFrame:
    """(key, item, score, rank): for every row its ``k`` most similar of a stated set of (id, vector), by matrix products.

    A row without a vector has one row with null item, score and rank.
    """
    among = sorted(among, key=lambda x: x[0])
    ids, matrix = np.array([q for q, _ in among], np.int64), np.array([v for _, v in among], np.float64)

    def run(batches):
        for b in batches:
            have = b.filter(b.column(1).is_valid())
            none = b.column(0).filter(b.column(1).is_null())
            x = have.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(have.num_rows, matrix.shape[1])
            s = np.round(np.maximum(0.0, x @ matrix.T), digits)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # stable: of equal scores the least id
            n = best.shape[1]
            cols = [np.repeat(have.column(0).to_numpy(), n), ids[best].reshape(-1), np.take_along_axis(s, best, 1).reshape(-1), np.tile(np.arange(1, n + 1), have.num_rows)]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "item", "score", "rank"])
            yield pa.RecordBatch.from_arrays([none, *(pa.nulls(len(none), t) for t in types[1:])], names=["key", "item", "score", "rank"])

    return df.select(F.col(key).cast("long"), vector).mapInArrow(run, "key long, item long, score double, rank long")
