"""Rate limits, state flags, canonical ids and other computations along the order of rows."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOUR = 3600.0


def offered_load(calls: DataFrame, session: str, at: str, seconds: float = HOUR) -> DataFrame:
    """Each call with the number of calls of its session in the time up to it, itself included (``at`` in seconds)."""
    w = W.partitionBy(session).orderBy(at).rangeBetween(-int(seconds), 0)
    return calls.withColumn("offered", F.count(F.lit(1)).over(w))


def rate_limited(calls: DataFrame, session: str, order: str, at: str, tool: str, units: str, hourly: int, caps: dict[str, int]) -> DataFrame:
    """(session, order, accepted): limits of calls an hour and of units a tool and session; a batch over its cap is rejected whole.

    Accepted calls alone count, so each decision needs the ones before it: rows of a session are read in order, as a
    stream, with the state of one session at a time.
    """
    rows = calls.select(F.col(session).cast("long").alias("session"), F.col(order).cast("long").alias("order"), F.col(at).cast("double").alias("at"), F.col(tool).cast("string").alias("tool"), F.col(units).cast("long").alias("units"))
    rows = rows.repartition("session").sortWithinPartitions("session", "at", "order")

    def run(batches):
        now, window, used = None, deque(), {}
        for b in batches:
            ok = []
            for s, t, tool_, n in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if s != now:
                    now, window, used = s, deque(), {}
                while window and window[0] < t - HOUR:
                    window.popleft()
                cap = caps.get(tool_)
                yes = len(window) < hourly and (cap is None or used.get(tool_, 0) + n <= cap)
                if yes:
                    window.append(t)
                    used[tool_] = used.get(tool_, 0) + n
                ok.append(yes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["session", "order", "accepted"])

    return rows.mapInArrow(run, "session long, order long, accepted boolean")


def carried(df: DataFrame, group: list[str], order: list[str], value: Column) -> Column:
    """The last value that isn't null up to each row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def hysteresis(df: DataFrame, group: list[str], order: list[str], value: Column, low: float, high: float) -> DataFrame:
    """Adds ``paused``: set once the value falls under ``low``, cleared once it exceeds ``high``, kept in between; first clear."""
    change = F.when(value < low, True).when(value > high, False)
    return df.withColumn("paused", F.coalesce(carried(df, group, order, change), F.lit(False)))


def canonical_ids(df: DataFrame, group: list[str], order: str, key: str, prefix: str = "toolu_") -> DataFrame:
    """Adds ``canonical``: ids renumbered in the order of their first place; doing it again changes nothing but names."""
    first = df.groupBy(*group, key).agg(F.min(order).alias("_first"))
    n = first.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy("_first", key)) - 1)
    return df.join(n.drop("_first"), [*group, key]).withColumn("canonical", F.format_string(prefix + "%08d", "_n")).drop("_n")


def size_prefix(df: DataFrame, group: list[str], order: list[Column], size: Column, cap: int) -> DataFrame:
    """Rows in order as long as twice their summed sizes stays within the cap."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") * 2 <= cap).drop("_sum")


def packed(blocks: Column, target: int) -> Column:
    """Greedy packing of an array of sizes: the number of the pack each goes to; a pack is closed before it would exceed the target."""
    start = F.struct(F.lit(0).cast("bigint").alias("pack"), F.lit(0).cast("bigint").alias("fill"), F.array().cast("array<bigint>").alias("out"))

    def step(s, n):
        full = (s.fill > 0) & (s.fill + n > target)
        pack = F.when(full, s.pack + 1).otherwise(s.pack).cast("bigint")
        return F.struct(pack.alias("pack"), F.when(full, n).otherwise(s.fill + n).cast("bigint").alias("fill"), F.concat(s.out, F.array(pack)).alias("out"))

    return F.aggregate(blocks, start, step, lambda s: s.out)
