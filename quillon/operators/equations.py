"""Equation search: dense candidates, tree edit distance within a budget of work, fused scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import mathml

MOST_QUERY, MOST_PAIR, BUDGET, CANDIDATES = 1500, 2500, 120_000, 200


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, alpha: float = 0.5, most: int | None = CANDIDATES, budget: int | None = BUDGET) -> DataFrame:
    """(query, id, cosine, ted, score, rank).

    ``candidates``: (query, id, cosine, tree) with trees as JSON or null; ``queries``: (query, tree). A candidate's tree is
    compared if the product of both sizes is at most 2500 and the products of the comparable candidates before it (cosine
    descending, id) sum to less than 120,000; else its distance is 1. A query whose tree is missing, has more than 1500
    nodes or meets no comparable candidate has no rows (the caller falls back to the dense order). ``most`` candidates of a
    query are looked at, within ``budget``; None is no bound, for callers whose candidates are chosen already.
    """
    q = queries.select("query", F.col("tree").alias("_tree"), mathml.tree_size("tree").alias("_nodes")).where(f"_nodes <= {MOST_QUERY}")
    top = W.partitionBy("query").orderBy(F.desc("cosine"), "id")
    c = candidates if most is None else candidates.withColumn("_place", F.row_number().over(top)).where(F.col("_place") <= most)
    c = c.withColumn("_size", mathml.tree_size("tree")).join(q, "query")
    pair = F.when(F.col("_size") * F.col("_nodes") <= MOST_PAIR, F.col("_size") * F.col("_nodes"))
    before = F.coalesce(F.sum(pair).over(top.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ok = c.withColumn("_go", pair.isNotNull() & (F.lit(True) if budget is None else before < budget)).withColumn("_any", F.max("_go").over(W.partitionBy("query"))).where("_any")
    scored = ok.withColumn("ted", mathml.tree_distance(F.when(F.col("_go"), F.col("tree")), "_tree")).withColumn("score", mathml.fuse(F.col("ted"), F.col("cosine"), alpha))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", *(F.round(x, 6).alias(x) for x in ("cosine", "ted", "score")), "rank")
