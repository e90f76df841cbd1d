"""Formula comparison by matched characters: assignment of least cost, precision and recall of what is matched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHTS = {"token": 1.0, "place": 0.5, "order": 0.1}


def assignment(cost: list[list[float]]) -> list[int]:
    """For each row its column in an assignment of least total cost; -1 if there are fewer columns (shortest augmenting paths)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m:
        back, out = assignment([list(c) for c in zip(*cost)]) if m else [], [-1] * n
        for col, row in enumerate(back):
            out[row] = col
        return out
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[at]:
            used[at], row, best, to = True, match[at], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[row - 1][j - 1] - u[row] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, at
                    if least[j] < best:
                        best, to = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += best
                    v[j] -= best
                else:
                    least[j] -= best
            at = to
        while at:
            match[at] = match[way[at]]
            at = way[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def formula_score(predicted: list[str], truth: list[str]) -> float:
    """F1 of matched tokens: pairs of the cheapest assignment whose tokens agree. Two empty lists agree fully."""
    if not predicted or not truth:
        return float(not predicted and not truth)
    cost = [[WEIGHTS["token"] * (a != b) + WEIGHTS["place"] * abs(i / len(predicted) - j / len(truth)) + WEIGHTS["order"] * (i != j) for j, b in enumerate(truth)] for i, a in enumerate(predicted)]
    hits = sum(j >= 0 and predicted[i] == truth[j] for i, j in enumerate(assignment(cost)))
    return 2 * hits / (len(predicted) + len(truth))


@F.pandas_udf(T.DoubleType())
def formula_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([formula_score(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b)], dtype="float64")


def mean_score(scored: DataFrame, score: str) -> DataFrame:
    """The mean with missing scores as 0."""
    return scored.agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("mean"))
