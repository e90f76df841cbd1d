"""Evaluation and operations reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RELEVANT = 3


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int = 5, recall_k: int = 10) -> DataFrame:
    """(query, ndcg, recall): ``ranked`` is (query, id, rank), ``truth`` (query, id, grade 0..3).

    Linear gains, ids without a grade count 0. A query without any gain has nDCG 0, one without a grade-3 id recall 0.
    """
    got = ranked.join(truth, ["query", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda place: F.col("grade") / F.log2(F.col(place) + 1.0)
    mine = got.groupBy("query").agg(F.sum(F.when(F.col("rank") <= k, gain("rank")).otherwise(0.0)).alias("dcg"), F.count_if((F.col("rank") <= recall_k) & (F.col("grade") >= RELEVANT)).alias("hits"))
    place = truth.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "id")))
    ideal = place.groupBy("query").agg(F.sum(F.when(F.col("place") <= k, gain("place")).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") >= RELEVANT).alias("relevant"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(mine, "query", "full_outer").select("query", zero(F.try_divide(zero(F.col("dcg")), F.col("idcg"))).alias("ndcg"), zero(F.try_divide(F.col("hits").cast("double"), F.col("relevant"))).alias("recall"))


def regressions(scores: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(version, score) with the fall in percent against the version before and whether it exceeds the threshold; a rise never does."""
    before = F.lag("score").over(W.orderBy("version"))
    drop = F.when(before > 0, (before - F.col("score")) / before * 100)
    return scores.select("version", "score", drop.alias("drop_pct"), F.coalesce(drop > threshold, F.lit(False)).alias("alert"))


def histogram_quantile(buckets: DataFrame, group: list[str], q: float) -> DataFrame:
    """The q-quantile of cumulative (le, count) buckets, linear within a bucket; in the last (infinite) one its lower end.

    A group without an infinite bucket or without observations has null.
    """
    w = W.partitionBy(*group).orderBy("le")
    b = buckets.withColumns({"_below": F.lag("count", 1, 0).over(w), "_from": F.lag("le", 1, 0.0).over(w), "_total": F.max("count").over(W.partitionBy(*group)), "_top": F.max("le").over(W.partitionBy(*group))})
    want = F.lit(q) * F.col("_total")
    hit = b.where((F.col("_total") > 0) & (F.col("_top") == float("inf")) & (F.col("count") >= want) & (F.col("_below") < want))
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * (want - F.col("_below")) / (F.col("count") - F.col("_below"))
    found = hit.select(*group, F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(inside).alias("quantile"))
    return buckets.select(*group).distinct().join(found, group, "left")


def counter_pivot(counts: DataFrame, row: str, column: str, value: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Sums of ``value`` by row and column, zero-filled for the listed columns, and for the listed rows and all of the table."""
    base = counts.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string").union(counts.select(row)).where(F.col(row).isNotNull()).distinct()
    sums = counts.groupBy(row).pivot(column, columns).agg(F.sum(value))
    return base.join(sums, row, "left").na.fill(0, columns)


def census(df: DataFrame, group: list[str], keys: dict[str, Column]) -> DataFrame:
    """One row a group with the count of rows that meet each condition, and of all."""
    agg = [F.count_if(c).alias(n) for n, c in keys.items()] + [F.count(F.lit(1)).alias("total")]
    return df.groupBy(*group).agg(*agg) if group else df.agg(*agg)


def divergence(actual: Column, marked: Column, tolerance: float = 0.05) -> Column:
    """``over`` or ``under`` where two counts differ by more than one and the tolerance; ``unknown`` where one is -1."""
    far = F.abs(actual - marked) > F.greatest(F.lit(1.0), tolerance * marked)
    return F.when((actual == -1) | (marked == -1), "unknown").when(far & (actual > marked), "over").when(far, "under").otherwise("none")


def digest(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """A digest of the rows of each group that doesn't depend on their order: the sum of 64-bit row hashes and the count.

    Unlike a hash of the sorted list it is combined map-side, so a group of any size stays spread.
    """
    part = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(*group).agg(F.sum(part).alias("digest"), F.count(F.lit(1)).alias("rows"))


def worst(df: DataFrame, group: list[str], status: str, order: list[str]) -> DataFrame:
    """The most severe status of each group; one that isn't listed counts as the most severe."""
    severity = F.coalesce(F.nullif(F.array_position(F.lit(order), F.col(status)), F.lit(0)), F.lit(len(order) + 1))
    return df.groupBy(*group).agg(F.max_by(F.col(status), F.struct(severity, F.col(status))).alias(status))
