"""Feeds put together from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans._read import table
from quillon.sources import feeds


def _safe(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def oai_records(spark, sf):
    """Pages of records by primary category; withdrawn papers (of year 0) are deleted records."""
    p = table(spark, sf, "paper_metadata").groupBy("paper_id").agg(F.max("fetched_at").alias("at"), F.max("year").alias("year"), F.max("primary_category").alias("cat"))
    record = F.concat(F.lit("<record><header"), F.when(F.col("year") == 0, ' status="deleted"').otherwise(""), F.lit("><identifier>oai:x:"), F.col("paper_id"), F.lit("</identifier><datestamp>"), F.substring("at", 1, 10), F.lit("</datestamp><setSpec>"), F.coalesce("cat", F.lit("")), F.lit("</setSpec><setSpec>all</setSpec></header></record>"))
    page = p.groupBy("cat").agg(F.concat(F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>'), F.array_join(F.array_sort(F.collect_list(record)), ""), F.lit("<resumptionToken>t1</resumptionToken></ListRecords></OAI-PMH>")).alias("xml"))
    return feeds.oai_records(page, "xml").select(F.regexp_replace("identifier", "^oai:x:", "").alias("paper_id"), "datestamp", "deleted", "token")


def atom_entries(spark, sf):
    p = table(spark, sf, "paper_metadata").groupBy("paper_id").agg(F.max("title").alias("title"), F.max("published").alias("published"))
    entry = F.concat(F.lit("<entry><id>http://x.org/abs/"), F.col("paper_id"), F.lit("v2</id><title>"), _safe(F.col("title")), F.lit("</title><summary>s</summary><published>"), F.coalesce("published", F.lit("")), F.lit('</published><author><name>A</name></author><category term="c"/></entry>'))
    page = p.groupBy(F.substring("paper_id", 1, 2).alias("g")).agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</feed>")).alias("xml"))
    return feeds.atom_entries(page, "xml").select("paper_id", "version", "title")


def json_works(spark, sf):
    """Works with inverted abstracts and references, as JSON."""
    p = table(spark, sf, "paper_metadata").where("abstract <> ''").groupBy("paper_id").agg(F.max("title").alias("title"), F.max("year").alias("year"), F.max("abstract").alias("abstract"))
    words = p.select("paper_id", "title", "year", F.posexplode(F.filter(F.split("abstract", " "), lambda x: x != "")).alias("at", "word")).groupBy("paper_id", "title", "year", "word").agg(F.collect_list(F.col("at").cast("int")).alias("places"))
    inverted = words.groupBy("paper_id", "title", "year").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("i"))
    refs = table(spark, sf, "cites").groupBy(F.col("src").alias("paper_id")).agg(F.collect_set(F.concat(F.lit("https://w.org/"), F.regexp_replace("dst", "/", "_"))).alias("refs"))
    raw = inverted.join(refs, "paper_id", "left").select(F.to_json(F.struct(F.concat(F.lit("https://w.org/"), F.regexp_replace("paper_id", "/", "_")).alias("id"), "title", F.col("year").alias("publication_year"), F.col("refs").alias("referenced_works"), F.col("i").alias("abstract_inverted_index"))).alias("raw"))
    return feeds.works(raw, "raw").select("work", "title", F.col("year").cast("long").alias("year"), "abstract", F.coalesce(F.size("references"), F.lit(0)).cast("long").alias("references"))


def exposition_samples(spark, sf):
    """Counters of events by type and user as exposition text."""
    e = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    line = e.select(F.concat(F.lit('requests_total{tool="'), F.col("event_type"), F.lit('",user="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("n").cast("string")).alias("line"))
    comments = spark.createDataFrame([("# HELP requests_total x",), ("",), ("up 1",)], "line string")
    return feeds.samples(line.unionByName(comments), "line").select("name", F.element_at("labels", "tool").alias("tool"), F.element_at("labels", "user").cast("long").alias("user_id"), "value")


def failure_records(spark, sf):
    """Failed runs as TSV lines and as JSON lines, with an unreadable line in each."""
    r = table(spark, sf, "notebook_ingest_runs").where("status = 'failed'").select("id", F.coalesce("stderr_tail", F.lit("")).alias("reason"), F.date_format("started_at", "yyyy-MM-dd").alias("at")).distinct()
    bad = spark.createDataFrame([("no tabs here",)], "line string")
    tsv = r.select(F.concat_ws("\t", "id", "reason", "at").alias("line")).unionByName(bad)
    jsonl = r.select(F.to_json(F.struct(F.col("id").alias("paper"), "reason", "at")).alias("line")).unionByName(bad)
    return feeds.failure_logs(tsv, jsonl, "line")


def oai_revisions(spark, sf):
    """Version histories with RFC-2822 dates."""
    d = table(spark, sf, "documents").where("arxiv_version <> ''").groupBy("work_id", "arxiv_version").agg(F.max("revised_at").alias("t"), F.max("license_status").alias("lic"))
    version = F.concat(F.lit('<version version="'), F.col("arxiv_version"), F.lit('"><date>'), F.coalesce(F.date_format(F.col("t").cast("timestamp"), "EEE, d MMM yyyy HH:mm:ss 'GMT'"), F.lit("")), F.lit("</date></version>"))
    page = d.groupBy("work_id").agg(F.concat(F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><GetRecord><record><metadata><arXivRaw><id>'), F.first("work_id"), F.lit("</id><license>"), F.max("lic"), F.lit("</license>"), F.array_join(F.array_sort(F.collect_list(version)), ""), F.lit("</arXivRaw></metadata></record></GetRecord></OAI-PMH>")).alias("xml"))
    return feeds.revisions(page, "xml").select("paper_id", "license", "version", F.unix_seconds("posted_at").alias("posted"))


def inspire_records(spark, sf):
    p = table(spark, sf, "paper_metadata").groupBy("paper_id").agg(F.max("title").alias("title"), F.max("authors").alias("a"), F.max("categories").alias("c"), F.max("year").alias("year"))
    refs = table(spark, sf, "cites").groupBy(F.col("src").alias("paper_id")).agg(F.array_sort(F.collect_set("dst")).alias("refs"))
    names = F.transform(F.from_json("a", "array<string>"), lambda x: F.struct(x.alias("full_name")))
    raw = p.join(refs, "paper_id", "left").select(F.to_json(F.struct(F.struct(F.array(F.struct("title")).alias("titles"), names.alias("authors"), F.array(F.struct(F.col("paper_id").alias("value"), F.from_json("c", "array<string>").alias("categories"))).alias("arxiv_eprints"), F.transform("refs", lambda x: F.struct(F.struct(x.alias("arxiv_eprint")).alias("reference"))).alias("references"), F.array(F.struct(F.lit("J").alias("journal_title"), F.nullif("year", F.lit(0)).alias("year"), F.lit("3").alias("page_start"), F.lit("9").alias("page_end"))).alias("publication_info")).alias("metadata"))).alias("raw"))
    return feeds.inspire_records(raw, "raw").select("paper_id", "title", "authors", F.coalesce(F.size("categories"), F.lit(0)).cast("long").alias("categories"), F.coalesce(F.size("references"), F.lit(0)).cast("long").alias("references"), "journal")


def render_states(spark, sf):
    return table(spark, sf, "documents").select("doc_id", feeds.render_state(F.col("text")).alias("state"))


QUERIES = {f.__name__: f for f in (oai_records, atom_entries, json_works, exposition_samples, failure_records, oai_revisions, inspire_records, render_states)}
ORACLE_SQL = {
    "oai_records": "SELECT paper_id, substring(max(fetched_at), 1, 10) AS datestamp, max(year) = 0 AS deleted, 't1' AS token FROM paper_metadata GROUP BY 1",
    "atom_entries": r"SELECT paper_id, 'v2' AS version, trim(regexp_replace(max(title), '\s+', ' ', 'g')) AS title FROM paper_metadata GROUP BY 1",
    "json_works": r"WITH p AS (SELECT paper_id, max(title) AS title, max(year)::BIGINT AS year, max(abstract) AS abstract FROM paper_metadata WHERE abstract <> '' GROUP BY 1), r AS (SELECT src, count(DISTINCT dst) AS n FROM cites GROUP BY 1) SELECT replace(paper_id, '/', '_') AS work, title, year, array_to_string(list_filter(string_split(abstract, ' '), lambda x: x <> ''), ' ') AS abstract, coalesce(n, 0) AS references FROM p LEFT JOIN r ON src = paper_id",
    "exposition_samples": "SELECT 'requests_total' AS name, event_type AS tool, user_id, count(*)::DOUBLE AS value FROM events GROUP BY 2, 3 UNION ALL SELECT 'up', NULL, NULL, 1.0",
    "failure_records": """WITH r AS (SELECT DISTINCT id, coalesce(stderr_tail, '') AS reason, strftime(started_at, '%Y-%m-%d') AS "at" FROM notebook_ingest_runs WHERE status = 'failed') SELECT 'fetch' AS stage, id AS paper, reason, "at" FROM r UNION ALL SELECT 'parse', id, reason, "at" FROM r UNION ALL SELECT 'fetch', NULL, 'unreadable: no tabs here', NULL UNION ALL SELECT 'parse', NULL, 'unreadable: no tabs here', NULL""",
    "oai_revisions": "WITH d AS (SELECT work_id, arxiv_version, max(revised_at) AS t, max(license_status) AS lic FROM documents WHERE arxiv_version <> '' GROUP BY 1, 2) SELECT work_id AS paper_id, max(lic) OVER (PARTITION BY work_id) AS license, arxiv_version AS version, epoch(date_trunc('second', t))::BIGINT AS posted FROM d",
    "inspire_records": "WITH r AS (SELECT src, count(DISTINCT dst) AS n FROM cites GROUP BY 1), p AS (SELECT paper_id, max(title) AS title, max(authors) AS a, max(categories) AS c, max(year) AS year FROM paper_metadata GROUP BY 1) SELECT paper_id, title, coalesce(array_to_string(from_json(a, '[\"VARCHAR\"]'), '; '), '') AS authors, len(list_distinct(from_json(c, '[\"VARCHAR\"]'))) AS categories, coalesce(n, 0) AS references, 'J ' || CASE WHEN year <> 0 THEN '(' || year || ') ' ELSE '' END || '3-9' AS journal FROM p LEFT JOIN r ON src = paper_id",
    "render_states": r"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN contains(lower(text), 'could not be processed') THEN 'banner' WHEN NOT regexp_matches(text, '<math\b|\$') THEN 'no_math' ELSE 'ok' END AS state FROM documents",
}
