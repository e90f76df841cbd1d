"""Lookups in which the first step that finds anything wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import text

JACCARD_LEAST = 0.3


def cascade(rows: DataFrame, steps: list[tuple[str, Column, Column]], query: str, key: str, k: int) -> DataFrame:
    """Rows of the first non-empty step of each query, its best ``k``.

    ``steps``: (mode, condition, score) in order. Adds ``mode``, ``score`` and ``rank``; rows that meet no step drop out.
    """
    step, mode, score = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (name, condition, value) in reversed(list(enumerate(steps))):
        step, mode, score = (F.when(condition, x).otherwise(y) for x, y in ((F.lit(i), step), (F.lit(name), mode), (value, score)))
    found = rows.withColumns({"_step": step, "mode": mode, "score": score}).where("_step IS NOT NULL")
    found = found.withColumn("_least", F.min("_step").over(W.partitionBy(query))).where("_step = _least")
    w = W.partitionBy(query).orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_step", "_least")


def by_name(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Lemma by name: exact key, then containment (three characters at least), then trigram similarity of at least 0.3.

    ``index``: (id, key), ``queries``: (query, wanted), both normalised and unique. An empty wanted name finds nothing.
    Whatever one of the three steps can find shares a trigram with the query, so both sides meet by trigrams, and the
    counts of shared ones give the similarity; no pair without a common trigram is formed.
    """
    names = index.where("key <> ''").withColumn("_grams", text.trigrams(F.col("key")))
    asked = queries.where("wanted <> ''").withColumn("_asked", text.trigrams(F.col("wanted")))
    left = names.select("id", "key", F.size("_grams").alias("_n"), F.explode("_grams").alias("_g"))
    right = asked.select("query", "wanted", F.size("_asked").alias("_m"), F.explode("_asked").alias("_g"))
    pairs = left.join(right, "_g").groupBy("query", "id").agg(F.count(F.lit(1)).alias("_both"), *(F.first(c).alias(c) for c in ("key", "wanted", "_n", "_m")))
    near = F.col("_both").cast("double") / (F.col("_n") + F.col("_m") - F.col("_both"))
    steps = [
        ("exact", F.col("key") == F.col("wanted"), F.lit(1.0)),
        ("contains", (F.length("wanted") >= 3) & F.col("key").contains(F.col("wanted")), F.lit(0.5)),
        ("fuzzy", near >= JACCARD_LEAST, F.round(near, 6)),
    ]
    return cascade(pairs, steps, "query", "id", k).select("query", "id", "mode", "score", "rank")
