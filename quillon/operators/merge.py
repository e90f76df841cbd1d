"""Changes to tables as new contents: upserts, replacements, deletes, and comparisons of two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of the same key, the others kept. Keys of ``new`` must be unique; a null key matches nothing."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_group(old: DataFrame, new: DataFrame, key: list[str], group: str) -> DataFrame:
    """An upsert that also drops the other old rows of every group that ``new`` holds."""
    kept = old.join(new.select(group).distinct(), group, "left_anti")
    return upsert(kept, new, key)


def delete(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't among the first column of ``keys``; deleting again changes nothing."""
    return df.join(keys.toDF(column).distinct(), column, "left_anti")


def coalesce_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys of both; every other column the new value where there is one, else the old."""
    n = new.select(*(F.col(c).alias(f"_{c}") for c in new.columns))
    both = old.join(n, old[key] == n[f"_{key}"], "full_outer")
    return both.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def reuse_plan(new: DataFrame, stored: DataFrame, identity: str, key: str, vector: str) -> DataFrame:
    """``new`` with the vector of the stored row of the same identity (the least key of several), else to embed again.

    A null identity is a legacy row's and never reusable.
    """
    usable = stored.where(F.col(identity).isNotNull() & F.col(vector).isNotNull()).groupBy(identity).agg(F.min_by(vector, key).alias("_vector"), F.min(key).alias("source_key"))
    return new.join(usable, identity, "left").withColumn("action", F.when(F.col("source_key").isNotNull(), "copy").otherwise("re_embed"))


def compare_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, bucket): in both, only in the first, only in the second."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "only_second").when(F.col("_b").isNull(), "only_first").otherwise("both").alias("bucket"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, valid_from: str, value: str) -> DataFrame:
    """``left`` with the value of the last right row of the same key at or before its time; null where there is none.

    Both sides go into one sorted stream of a key and the last value is carried forward: no pair is formed, however
    many revisions a key has. Of right rows of one time the greatest value counts. A null time gets null.
    """
    cols = left.columns
    r = right.where(F.col(valid_from).isNotNull()).groupBy(F.col(by), F.col(valid_from).alias("_at")).agg(F.max(value).alias("_value"))
    stream = left.withColumns({"_at": F.col(at), "_left": F.lit(1)}).unionByName(r.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(F.asc_nulls_first("_at"), "_left").rowsBetween(W.unboundedPreceding, 0)
    return stream.withColumn(value, F.when(F.col("_at").isNotNull(), F.last("_value", ignorenulls=True).over(w))).where("_left = 1").select(*cols, value)


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) of every row and rule that isn't kept; a rule that is null isn't kept either."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))
