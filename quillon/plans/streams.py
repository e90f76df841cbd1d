"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.session import scratch
from quillon.sources.catalog import Catalog
from quillon.streaming import jobs


def _events(spark, sf):
    return jobs.stream(spark, f"{sf}/events.parquet")


def stream_tumbling(spark, sf):
    out = jobs.run(jobs.tumbling(_events(spark, sf), "ts", "6 hours", ["event_type"], "40 days"), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_sliding(spark, sf):
    e = _events(spark, sf).withWatermark("ts", "40 days").groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return jobs.run(e, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def stream_session(spark, sf):
    out = jobs.run(jobs.sessions(_events(spark, sf), "ts", "8 hours", "user_id", "40 days"), "complete")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def stream_dedup(spark, sf):
    """The first delivery of each user and type."""
    e = _events(spark, sf).select("ts", "user_id", "event_type")
    return jobs.run(jobs.deduplicated(e, "ts", ["user_id", "event_type"])).select("user_id", "event_type")


def stream_rate_limit(spark, sf):
    e = _events(spark, sf).select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("at"))
    return jobs.run(jobs.rate_limited(e, "user_id", "event_id", "at", 2)).select(F.col("key").alias("event_id"), "accepted")


def delta_apply(spark, sf):
    """The last event of each user; a user whose last event is an error is deleted."""
    catalog = Catalog(spark, scratch(spark, "catalog"))
    e = _events(spark, sf).select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    jobs.apply_delta(catalog, "users", e, "user_id", "event_id", "gone")
    return catalog.scan("users").select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_rate_limit, delta_apply)}
ORACLE_SQL = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY 1",
    "stream_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "delta_apply": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
}
