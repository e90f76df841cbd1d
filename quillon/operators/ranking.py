"""Ranked lists: every order is (score descending, id ascending)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RRF_K = 60


def top(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def top_per(df: DataFrame, group: list[str], k: int, score: str = "score", key: str = "id", rank: str = "rank") -> DataFrame:
    """The ``k`` best of each group with their 1-based rank."""
    w = W.partitionBy(*group).orderBy(F.desc(score), F.asc(key))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_per(df: DataFrame, group: list[str | Column], score: str = "score", key: str = "id") -> DataFrame:
    """The best row of each group."""
    w = W.partitionBy(*group).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reciprocal_rank_fusion(lists: list[DataFrame], by: list[str] | None = None, k: int = RRF_K, key: str = "id") -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; ``lists`` have ``rank``. An id twice in one list counts twice."""
    group = [*(by or []), key]
    union = lists[0].select(*group, "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select(*group, "rank"))
    return union.groupBy(*group).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
