"""Evaluation metrics, operations reports, windows over rows and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import text
from quillon.operators import reports, sessions
from quillon.operators.ranking import top_per
from quillon.plans._read import table


def _run(spark, sf):
    """A ranked list of documents for each language, and grades 0 to 3, both made from sizes."""
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND n_chars IS NOT NULL").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), "license_status")
    return top_per(d, ["query"], 20), d.where("license_status = 'known'").select("query", "id", (F.floor(F.col("score") / 300) % 4).cast("int").alias("grade"))


def ndcg_recall(spark, sf):
    return reports.retrieval_metrics(*_run(spark, sf)).select("query", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


def mean_metrics(spark, sf):
    m = reports.retrieval_metrics(*_run(spark, sf))
    return m.agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.percentile("ndcg", F.lit(0.95)), 6).alias("p95"))


def eval_regression(spark, sf):
    """Average event value by day, each against the day before."""
    e = table(spark, sf, "events").groupBy(F.dayofyear("ts").cast("long").alias("version")).agg(F.round(F.avg("value"), 6).alias("score"))
    return reports.regressions(e, 3.0).withColumn("drop_pct", F.round("drop_pct", 4))


def _buckets(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    edges = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, float("inf")]
    return e.groupBy("event_type").agg(*(F.count_if(F.col("value") <= x).alias(str(i)) for i, x in enumerate(edges))).select("event_type", F.explode(F.array(*(F.struct(F.lit(x).alias("le"), F.col(str(i)).alias("count")) for i, x in enumerate(edges)))).alias("b")).select("event_type", "b.le", "b.count")


def hist_quantile(spark, sf):
    b = _buckets(spark, sf)
    out = [reports.histogram_quantile(b, ["event_type"], q).select("event_type", F.lit(q).alias("q"), F.round("quantile", 6).alias("quantile")) for q in (0.5, 0.95, 0.99)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def latency_quantiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", F.lit(p)), 6).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


def counter_pivot(spark, sf):
    """The rows of two slugs, as the SQL says; ``all_counter_pivot`` has those of all."""
    return all_counter_pivot(spark, sf).where(F.col("slug").isin("ninuvi0000", "nothing"))


def all_counter_pivot(spark, sf):
    """Runs by slug and status, zero-filled for the two listed slugs and all of the table."""
    runs = table(spark, sf, "notebook_ingest_runs").select("id", "slug", "status").distinct().withColumn("one", F.lit(1).cast("long"))
    out = reports.counter_pivot(runs, "slug", "status", "one", ["ninuvi0000", "nothing"], ["succeeded", "failed", "running"])
    return out.select("slug", *(F.col(c).cast("long").alias(c) for c in ("succeeded", "failed", "running")))


def hit_rate(spark, sf):
    """Purchases over views of each user, null without views."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count_if(F.col("event_type") == "view").alias("lookups"))
    return e.select("user_id", "hits", "lookups", F.round(F.try_divide(F.col("hits").cast("double"), F.col("lookups")), 6).alias("rate"))


def failure_top(spark, sf):
    """The ten most frequent ends of failed runs by exit code."""
    r = table(spark, sf, "notebook_ingest_runs").where("status = 'failed'").dropDuplicates(["id"]).groupBy(F.col("exit_code").cast("long").alias("stage"), F.coalesce("stderr_tail", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("stage").orderBy(F.desc("n"), "reason")
    return r.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")


def iso_week(spark, sf):
    """Papers published in the ISO weeks 10 to 20 of any year, undated ones passed on."""
    p = table(spark, sf, "paper_metadata").select("paper_id", F.try_to_timestamp("published").alias("t")).distinct()
    return p.where(F.col("t").isNull() | F.weekofyear("t").between(10, 20)).select("paper_id", F.extract(F.lit("YEAROFWEEK"), F.col("t")).cast("long").alias("year"), F.weekofyear("t").cast("long").alias("week")).distinct()


def license_census(spark, sf):
    s = F.col("license_status")
    return reports.census(table(spark, sf, "documents"), ["source"], {"known": s == "known", "unknown": s == "unknown", "unlicensed": s == "unlicensed"})


def id_shape_census(spark, sf):
    p = F.col("paper_id")
    return reports.census(table(spark, sf, "chunks").select("paper_id").distinct(), [], {"new": p.rlike(r"^\d{4}\.\d{5}(v\d+)?$"), "old": p.rlike(r"^[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$"), "versioned": p.rlike(r"v\d+$"), "textbook": p.startswith("textbook:")})


def coverage_rate(spark, sf):
    """Documents without a known licence by language, and which share needs a look."""
    d = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.when(F.col("license_status") == "unknown", 1.0).otherwise(0.0)), 6).alias("unknown"))
    return d.withColumn("escalate", F.col("unknown") > 0.2)


def count_divergence(spark, sf):
    """Pages of a paper's metadata against its chunks: which counts differ too much."""
    c = table(spark, sf, "chunks").groupBy("paper_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    d = table(spark, sf, "documents").groupBy(F.col("work_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("docs"))
    j = c.join(d, "paper_id", "full_outer").na.fill(-1, ["chunks", "docs"])
    return j.select("paper_id", "chunks", "docs", reports.divergence(F.col("chunks"), F.col("docs")).alias("state"))


def row_digest(spark, sf):
    """Digest of the rows of each source, in whatever order they come (rows of both runs have one digest)."""
    return reports.digest(table(spark, sf, "documents").select("source", "doc_id", "work_id"), ["source"], ["doc_id", "work_id"])


def health_fold(spark, sf):
    r = table(spark, sf, "notebook_ingest_runs").groupBy("id").agg(F.max("slug").alias("slug"), F.max("status").alias("status"))
    return reports.worst(r, ["slug"], "status", ["succeeded", "running", "failed"])


def latest_runs(spark, sf):
    """The last run of each slug; a running one that began more than six hours before the last start of all counts as failed."""
    r = table(spark, sf, "notebook_ingest_runs").groupBy("id").agg(*(F.max(c).alias(c) for c in ("slug", "status", "started_at")))
    cut = r.agg(F.max("started_at").alias("cut"))
    r = r.crossJoin(F.broadcast(cut)).withColumn("status", F.when((F.col("status") == "running") & (F.col("started_at") < F.col("cut") - F.expr("INTERVAL 6 HOURS")), "failed").otherwise(F.col("status")))
    return r.groupBy("slug").agg(F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("r")).select("slug", "r.id", "r.status")


def rate_limit_offered(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return sessions.offered_load(e, "user_id", "at", 86_400).select("event_id", F.col("offered").cast("long").alias("offered"))


def rate_limit_accepted(spark, sf):
    """Three calls an hour and forty of a kind; rejected ones don't count."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumns({"at": F.col("us") / 1e6, "one": F.lit(1)})
    out = sessions.rate_limited(e, "user_id", "event_id", "at", "event_type", "one", 3, {"click": 40, "view": 40})
    return out.select(F.col("order").alias("event_id"), "accepted")


def carry_forward_label(spark, sf):
    """The last label seen in a textbook up to each chunk, by page."""
    c = table(spark, sf, "chunks").where("source_kind = 'textbook'").select("chunk_id", "textbook_slug", F.coalesce("page_start", F.lit(0)).alias("page"), "theorem_label").distinct()
    return c.select("chunk_id", sessions.carried(c, ["textbook_slug"], ["page", "chunk_id"], F.col("theorem_label")).alias("label"))


def section_counter(spark, sf):
    """Statements numbered within their section."""
    c = table(spark, sf, "chunks").where("kind <> 'proof'").select("chunk_id", "paper_id", F.coalesce(F.try_element_at("section_path", F.lit(1)), F.lit("")).alias("section")).distinct()
    n = F.row_number().over(W.partitionBy("paper_id", "section").orderBy("chunk_id"))
    return c.select("chunk_id", F.concat_ws(".", F.nullif(F.regexp_extract("section", r"^(\d+)", 1), F.lit("")), n.cast("string")).alias("number"))


def disk_hysteresis(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value", "ts")
    return sessions.hysteresis(e, ["user_id"], ["ts", "event_id"], F.col("value"), 5.0, 15.0).select("event_id", "paused")


def canonical_turn_ids(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sessions.canonical_ids(e, ["user_id"], "event_id", "event_type").select("event_id", "canonical")


def byte_cap_prefix(spark, sf):
    """Documents of each source, by id, as long as twice their bytes stay within 64 KB."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return sessions.size_prefix(d, ["source"], [F.col("doc_id")], F.col("size"), 65_536).select("source", "doc_id")


def packed_blocks(spark, sf):
    """Paragraphs packed to 120 words; rows-only."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "").alias("blocks"))
    sizes = F.transform("blocks", lambda x: F.size(text.words(x)).cast("bigint"))
    return d.select("doc_id", F.posexplode(F.arrays_zip(F.col("blocks").alias("block"), sessions.packed(sizes, 120).alias("pack"))).alias("at", "b")).groupBy("doc_id", F.col("b.pack").alias("pack")).agg(F.count(F.lit(1)).alias("blocks"))


def fixed_windows(spark, sf):
    """Overlapping windows of 64 words, 16 of them shared, over whole documents."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 16, F.lit(1)), F.lit(48))
    return d.where("size(w) > 0").select("doc_id", F.posexplode(F.transform(starts, lambda i: F.size(F.slice("w", i, 64)))).alias("at", "n")).select("doc_id", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"))


def events_tumbling(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def events_sliding(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def events_sessions(spark, sf):
    """Sessions of a user: no pause of more than eight hours."""
    e = table(spark, sf, "events")
    return e.groupBy(F.session_window("ts", "8 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


_D = "d AS (SELECT lang AS query, doc_id AS id, n_chars::DOUBLE AS score, license_status FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL), r AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM d) WHERE rank <= 20), t AS (SELECT query, id, floor(score / 300)::BIGINT % 4 AS grade FROM d WHERE license_status = 'known'), m AS (SELECT r.query, sum(CASE WHEN rank <= 5 THEN coalesce(grade, 0) / log2(rank + 1) ELSE 0 END) AS dcg, count_if(rank <= 10 AND coalesce(grade, 0) >= 3) AS hits FROM r LEFT JOIN t USING (query, id) GROUP BY 1), i AS (SELECT query, sum(CASE WHEN p <= 5 THEN grade / log2(p + 1) ELSE 0 END) AS idcg, count_if(grade >= 3) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS p FROM t) GROUP BY 1), f AS (SELECT coalesce(m.query, i.query) AS query, CASE WHEN coalesce(idcg, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(dcg, 0) / idcg END AS ndcg, CASE WHEN coalesce(rel, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(hits, 0)::DOUBLE / rel END AS recall FROM m FULL JOIN i ON m.query = i.query)"
_EDGES = "(0.5), (1.0), (2.0), (5.0), (10.0), (20.0), (50.0), ('Infinity'::DOUBLE)"

QUERIES = {f.__name__: f for f in (ndcg_recall, mean_metrics, eval_regression, hist_quantile, latency_quantiles, counter_pivot, all_counter_pivot, hit_rate, failure_top, iso_week, license_census, id_shape_census, coverage_rate, count_divergence, row_digest, health_fold, latest_runs, rate_limit_offered, rate_limit_accepted, carry_forward_label, section_counter, disk_hysteresis, canonical_turn_ids, byte_cap_prefix, packed_blocks, fixed_windows, events_tumbling, events_sliding, events_sessions)}
ORACLE_SQL = {
    "ndcg_recall": f"WITH {_D} SELECT query, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM f",
    "mean_metrics": f"WITH {_D} SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(quantile_cont(ndcg, 0.95), 6) AS p95 FROM f",
    "eval_regression": "WITH e AS (SELECT dayofyear(ts) AS version, round(avg(value), 6) AS score FROM events GROUP BY 1), l AS (SELECT *, lag(score) OVER (ORDER BY version) AS b FROM e) SELECT version, score, round(CASE WHEN b > 0 THEN (b - score) / b * 100 END, 4) AS drop_pct, coalesce(b > 0 AND (b - score) / b * 100 > 3, false) AS alert FROM l",
    "hist_quantile": f"WITH b AS (SELECT event_type, le, count_if(value <= le) AS c FROM events, (VALUES {_EDGES}) v(le) GROUP BY 1, 2), w AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY event_type ORDER BY le) AS below, lag(le, 1, 0.0::DOUBLE) OVER (PARTITION BY event_type ORDER BY le) AS lo, max(c) OVER (PARTITION BY event_type) AS total FROM b), q AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.95), (0.99)) v(q)) SELECT event_type, q, round(CASE WHEN le = 'Infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * (q * total - below) / (c - below) END, 6) AS quantile FROM w, q WHERE c >= q * total AND below < q * total",
    "latency_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "all_counter_pivot": "WITH r AS (SELECT DISTINCT id, slug, status FROM notebook_ingest_runs), s AS (SELECT slug FROM r WHERE slug IS NOT NULL UNION SELECT 'ninuvi0000' UNION SELECT 'nothing') SELECT s.slug, coalesce(sum((status = 'succeeded')::INT), 0)::BIGINT AS succeeded, coalesce(sum((status = 'failed')::INT), 0)::BIGINT AS failed, coalesce(sum((status = 'running')::INT), 0)::BIGINT AS running FROM s LEFT JOIN r USING (slug) GROUP BY 1",
    "counter_pivot": "WITH r AS (SELECT DISTINCT id, slug, status FROM notebook_ingest_runs) SELECT s.slug, coalesce(sum((status = 'succeeded')::INT), 0)::BIGINT AS succeeded, coalesce(sum((status = 'failed')::INT), 0)::BIGINT AS failed, coalesce(sum((status = 'running')::INT), 0)::BIGINT AS running FROM (VALUES ('ninuvi0000'), ('nothing')) s(slug) LEFT JOIN r ON r.slug = s.slug GROUP BY 1",
    "hit_rate": "SELECT user_id, count_if(event_type = 'purchase')::BIGINT AS hits, count_if(event_type = 'view')::BIGINT AS lookups, round(CASE WHEN count_if(event_type = 'view') > 0 THEN count_if(event_type = 'purchase')::DOUBLE / count_if(event_type = 'view') END, 6) AS rate FROM events GROUP BY 1",
    "failure_top": "WITH r AS (SELECT exit_code::BIGINT AS stage, coalesce(stderr_tail, '') AS reason, count(*) AS n FROM (SELECT id, any_value(exit_code) AS exit_code, any_value(stderr_tail) AS stderr_tail FROM notebook_ingest_runs WHERE status = 'failed' GROUP BY 1) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY n DESC, reason) AS place FROM r) WHERE place <= 10",
    "iso_week": "SELECT DISTINCT paper_id, isoyear(t)::BIGINT AS year, weekofyear(t)::BIGINT AS week FROM (SELECT paper_id, TRY_CAST(published AS TIMESTAMP) AS t FROM paper_metadata) WHERE t IS NULL OR weekofyear(t) BETWEEN 10 AND 20",
    "license_census": "SELECT source, count_if(license_status = 'known')::BIGINT AS known, count_if(license_status = 'unknown')::BIGINT AS unknown, count_if(license_status = 'unlicensed')::BIGINT AS unlicensed, count(*) AS total FROM documents GROUP BY 1",
    "id_shape_census": r"SELECT count_if(regexp_matches(paper_id, '^\d{4}\.\d{5}(v\d+)?$'))::BIGINT AS new, count_if(regexp_matches(paper_id, '^[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$'))::BIGINT AS old, count_if(regexp_matches(paper_id, 'v\d+$'))::BIGINT AS versioned, count_if(starts_with(paper_id, 'textbook:'))::BIGINT AS textbook, count(*) AS total FROM (SELECT DISTINCT paper_id FROM chunks)",
    "coverage_rate": "SELECT lang, count(*) AS rows, round(avg(CASE WHEN license_status = 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS unknown, round(avg(CASE WHEN license_status = 'unknown' THEN 1.0 ELSE 0.0 END), 6) > 0.2 AS escalate FROM documents GROUP BY 1",
    "count_divergence": "WITH j AS (SELECT coalesce(c.paper_id, d.paper_id) AS paper_id, coalesce(chunks, -1) AS chunks, coalesce(docs, -1) AS docs FROM (SELECT paper_id, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY 1) c FULL JOIN (SELECT work_id AS paper_id, count(*) AS docs FROM documents GROUP BY 1) d ON c.paper_id = d.paper_id) SELECT *, CASE WHEN chunks = -1 OR docs = -1 THEN 'unknown' WHEN abs(chunks - docs) > greatest(1.0, 0.05 * docs) THEN CASE WHEN chunks > docs THEN 'over' ELSE 'under' END ELSE 'none' END AS state FROM j",
    "health_fold": "WITH r AS (SELECT id, max(slug) AS slug, max(status) AS status FROM notebook_ingest_runs GROUP BY 1) SELECT slug, arg_max(status, list_position(['succeeded', 'running', 'failed'], status)) AS status FROM r GROUP BY 1",
    "latest_runs": "WITH r AS (SELECT id, max(slug) AS slug, max(status) AS status, max(started_at) AS t FROM notebook_ingest_runs GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY t DESC, id DESC) AS n FROM r) SELECT slug, id, CASE WHEN status = 'running' AND t < (SELECT max(t) FROM r) - INTERVAL 6 HOUR THEN 'failed' ELSE status END AS status FROM f WHERE n = 1",
    "rate_limit_offered": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS offered FROM events",
    "carry_forward_label": "SELECT chunk_id, last_value(theorem_label IGNORE NULLS) OVER (PARTITION BY textbook_slug ORDER BY page, chunk_id ROWS UNBOUNDED PRECEDING) AS label FROM (SELECT DISTINCT chunk_id, textbook_slug, coalesce(page_start, 0) AS page, theorem_label FROM chunks WHERE source_kind = 'textbook')",
    "section_counter": r"SELECT chunk_id, concat_ws('.', nullif(regexp_extract(section, '^(\d+)', 1), ''), row_number() OVER (PARTITION BY paper_id, section ORDER BY chunk_id)) AS number FROM (SELECT DISTINCT chunk_id, paper_id, coalesce(section_path[1], '') AS section FROM chunks WHERE kind <> 'proof')",
    "disk_hysteresis": "SELECT event_id, coalesce(last_value(CASE WHEN value < 5 THEN true WHEN value > 15 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS paused FROM events",
    "canonical_turn_ids": "WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) - 1 AS n FROM f) SELECT event_id, 'toolu_' || lpad(n::VARCHAR, 8, '0') AS canonical FROM events JOIN n USING (user_id, event_type)",
    "byte_cap_prefix": "SELECT source, doc_id FROM (SELECT source, doc_id, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s * 2 <= 65536",
    "fixed_windows": r"WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}(?:(?:\p{L}|-)*\p{L})?')) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, n, unnest(range(1, greatest(n - 16, 1) + 1, 48)) AS i FROM d WHERE n > 0) SELECT doc_id, (i - 1) // 48 AS at, least(64, n - i + 1) AS n FROM s",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY 1",
    "events_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
}
