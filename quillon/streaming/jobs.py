"""Structured Streaming jobs: deltas into versioned tables, event-time windows, deduplication, rate limits with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import merge
from quillon.session import scratch
from quillon.sources.catalog import Catalog


def stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream; times without zone become UTC times, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: a single file is no base folder
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields))


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and gives its result as a table in shared storage.

    ``complete`` keeps the last batch's table, ``append`` collects all batches.
    """
    spark = df.sparkSession
    root = scratch(spark, "stream")
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def tumbling(events: DataFrame, at: str, size: str, group: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *group).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "40 days") -> DataFrame:
    """Repeated deliveries of a key within the watermark count once."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def apply_delta(catalog: Catalog, name: str, changes: DataFrame, key: str, order: str, deleted: str) -> None:
    """Applies a stream of changes to a versioned table: in arrival order the last change of a key wins, deletes remove it.

    Each batch publishes one version; a batch that changes nothing publishes none. A repeated batch leaves the same rows,
    so a restart after a failure does no harm.
    """

    def batch(rows: DataFrame, n: int) -> None:
        rows.persist()
        try:
            if rows.isEmpty():
                return
            last = merge.latest(rows, [key], [F.desc(order)])
            base = catalog.version(name)
            new = last.where(~F.col(deleted)).drop(deleted)
            old = catalog.scan(name, base) if base else new.limit(0)
            catalog.write(name, merge.upsert(merge.delete(old, key, last.where(deleted).select(key)), new, [key]), based_on=base)
        finally:
            rows.unpersist()

    root = scratch(changes.sparkSession, "delta")
    changes.writeStream.foreachBatch(batch).option("checkpointLocation", root).trigger(availableNow=True).start().awaitTermination()


def rate_limited(calls: DataFrame, session: str, key: str, at: str, hourly: int) -> DataFrame:
    """(session, key, accepted) of a stream of calls (``at`` in seconds); the state of a session is the times of its
    accepted calls in the last hour, ``hourly`` at most. Within a batch, calls of a session are taken in order of time and key."""
    rows = calls.select(F.col(session).cast("long").alias("session"), F.col(key).cast("long").alias("key"), F.col(at).cast("double").alias("at"))

    def decide(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["at", "key"])
        ok = []
        for t in frame["at"]:
            window = [x for x in window if x >= t - 3600.0]
            yes = len(window) < hourly
            if yes:
                window.append(float(t))
            ok.append(yes)
        state.update((window,))
        yield pd.DataFrame({"session": frame["session"], "key": frame["key"], "accepted": ok})

    return rows.groupBy("session").applyInPandasWithState(decide, "session long, key long, accepted boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)
