"""Pairs within groups, with large groups spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one group that one task may hold on its left side.
BLOCK = 2000


def grouped_pairs(rows: DataFrame, group: str, key: str, differ: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Ordered pairs (key_a < key_b) of rows that share ``group``.

    ``differ``: a condition over ``a.*`` and ``b.*``. A group of n rows is cut into ceil(n / block) blocks by a hash of
    the key: the left side goes to its block, the right side to all of them, so no task holds a whole hot group twice.
    """
    size = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    sized = rows.join(size.filter("_blocks > 0"), group)
    left = sized.withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).drop("_blocks").alias("a")
    right = sized.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks").alias("b")
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a._block") == F.col("b._block")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    if differ is not None:
        on = on & differ
    return left.join(right, on).select(F.col(f"a.{key}").alias("key_a"), F.col(f"b.{key}").alias("key_b"))
