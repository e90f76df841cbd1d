"""The smaller operators: probes, plans, keys, registry checks and folds over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import text, vectors
from quillon.operators import hooks, merge, reports
from quillon.operators.ranking import top_per
from quillon.plans._read import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT count(embedding_stmt) AS stmt, count(embedding_proof) AS proof, count(embedding_eq) AS eq, count(embedding_eq) > 0 AS eq_populated FROM chunks")
def column_probes(spark, sf):
    return table(spark, sf, "chunks").agg(F.count("embedding_stmt").alias("stmt"), F.count("embedding_proof").alias("proof"), F.count("embedding_eq").alias("eq"), (F.count("embedding_eq") > 0).alias("eq_populated"))


@query("SELECT DISTINCT chunk_id, kind = 'proof' AS proof, CASE WHEN kind <> 'proof' THEN round(embedding_stmt[1]::DOUBLE, 6) END AS stmt, CASE WHEN kind = 'proof' THEN round(embedding_proof[1]::DOUBLE, 6) END AS pf FROM chunks WHERE coalesce(embedding_stmt, embedding_proof) IS NOT NULL")
def vector_assembly(spark, sf):
    """Chunks joined with their vectors by id, each placed in the column of its route."""
    c = table(spark, sf, "chunks")
    vec = c.select("chunk_id", F.coalesce("embedding_stmt", "embedding_proof").alias("vector")).where("vector IS NOT NULL").groupBy("chunk_id").agg(F.first("vector").alias("vector"))
    rows = c.select("chunk_id", (F.col("kind") == "proof").alias("proof")).distinct().join(vec, "chunk_id")
    first = F.round(F.col("vector")[0].cast("double"), 6)
    return rows.select("chunk_id", "proof", F.when(~F.col("proof"), first).alias("stmt"), F.when(F.col("proof"), first).alias("pf"))


@query("SELECT paper_id, count(*) AS rows FROM chunks WHERE source_kind = 'arxiv' AND chunker_version <> 'v1.3' GROUP BY 1")
def stale_chunkers(spark, sf):
    return table(spark, sf, "chunks").where("source_kind = 'arxiv' AND chunker_version <> 'v1.3'").groupBy("paper_id").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT a.doc_id, b.n IS NOT NULL AS collides FROM documents a LEFT JOIN (SELECT work_id, count(*) AS n FROM documents WHERE arxiv_version = 'v1' GROUP BY 1) b USING (work_id) WHERE a.arxiv_version = ''")
def rekey_collisions(spark, sf):
    """Documents without a revision that would get ``v1``, and whether that key is taken."""
    d = table(spark, sf, "documents")
    taken = d.where("arxiv_version = 'v1'").select("work_id").distinct().withColumn("_t", F.lit(True))
    return d.where("arxiv_version = ''").join(taken, "work_id", "left").select("doc_id", F.coalesce("_t", F.lit(False)).alias("collides"))


@query("SELECT slug, count(*) AS runs, coalesce(sum((status = 'succeeded')::INT), 0)::BIGINT AS ok, coalesce(sum((status = 'failed')::INT), 0)::BIGINT AS failed, round(avg(epoch(finished_at - started_at)), 3) AS seconds FROM (SELECT DISTINCT * FROM notebook_ingest_runs) GROUP BY 1")
def ingest_summary(spark, sf):
    r = table(spark, sf, "notebook_ingest_runs").distinct()
    took = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return r.groupBy("slug").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "succeeded").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(took), 3).alias("seconds"))


@query("WITH c AS (SELECT DISTINCT chunk_id, embedder_version LIKE '%9a8b7c6d' AS new, sha256(body_text) AS i FROM chunks) SELECT count(*) AS total, count_if(i IN (SELECT i FROM c WHERE NOT new))::BIGINT AS copied, round(count_if(i IN (SELECT i FROM c WHERE NOT new)) / count(*)::DOUBLE, 6) AS fraction FROM c WHERE new")
def copy_fraction(spark, sf):
    c = table(spark, sf, "chunks").select("chunk_id", F.col("embedder_version").like("%9a8b7c6d").alias("new"), F.sha2("body_text", 256).alias("i")).distinct()
    old = c.where("NOT new").select("i").distinct().withColumn("_o", F.lit(1))
    return c.where("new").join(old, "i", "left").agg(F.count(F.lit(1)).alias("total"), F.count("_o").alias("copied"), F.round(F.try_divide(F.count("_o").cast("double"), F.count(F.lit(1))), 6).alias("fraction"))


@query("SELECT DISTINCT paper_id FROM paper_metadata WHERE year >= 2015 AND length(abstract) >= 150 AND list_contains(from_json(categories, '[\"VARCHAR\"]'), 'math.NT')")
def curation_filter(spark, sf):
    p = table(spark, sf, "paper_metadata").where("year >= 2015 AND length(abstract) >= 150")
    return p.where(F.array_contains(F.from_json("categories", "array<string>"), "math.NT")).select("paper_id").distinct()


@query("SELECT DISTINCT paper_id, coalesce(list_has_any(from_json(categories, '[\"VARCHAR\"]'), ['hep-th', 'math-ph', 'math.PR']), false) AS physics FROM paper_metadata")
def physics_gate(spark, sf):
    return table(spark, sf, "paper_metadata").select("paper_id", F.coalesce(F.arrays_overlap(F.from_json("categories", "array<string>"), F.array(F.lit("hep-th"), F.lit("math-ph"), F.lit("math.PR"))), F.lit(False)).alias("physics")).distinct()


@query(r"SELECT DISTINCT paper_id, CASE WHEN starts_with(paper_id, 'textbook:') THEN CASE WHEN regexp_full_match(paper_id, 'textbook:[a-z0-9]+') THEN 'textbook' ELSE 'malformed' END WHEN regexp_full_match(paper_id, '\d{4}\.\d{5}(v\d+)?|[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?') THEN 'arxiv' ELSE 'malformed' END AS source FROM chunks")
def admission(spark, sf):
    """Ids by their shape: of a supported source, or malformed."""
    p = F.col("paper_id")
    kind = F.when(p.startswith("textbook:"), F.when(p.rlike(r"^textbook:[a-z0-9]+\z"), "textbook").otherwise("malformed")).when(p.rlike(r"^(\d{4}\.\d{5}(v\d+)?|[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?)\z"), "arxiv").otherwise("malformed")
    return table(spark, sf, "chunks").select("paper_id", kind.alias("source")).distinct()


@query("WITH t AS (SELECT textbook_slug, list(DISTINCT chapter) AS titles FROM chunks WHERE chapter IS NOT NULL GROUP BY 1) SELECT DISTINCT chunk_id, list_filter(section_path, lambda x: list_contains(titles, x))[1] AS assigned FROM chunks JOIN t USING (textbook_slug)")
def chapter_assignment(spark, sf):
    """The first breadcrumb of a textbook chunk that is a chapter of the book."""
    c = table(spark, sf, "chunks")
    titles = c.where("chapter IS NOT NULL").groupBy("textbook_slug").agg(F.collect_set("chapter").alias("titles"))
    return c.join(titles, "textbook_slug").select("chunk_id", F.try_element_at(F.filter("section_path", lambda x: F.array_contains(F.col("titles"), x)), F.lit(1)).alias("assigned")).distinct()


@query("SELECT doc_id, length(CASE WHEN strlen(text) > 2048 THEN substring(text, 1, 1024) ELSE text END) AS kept, strlen(text) > 2048 AS truncated FROM documents WHERE text IS NOT NULL")
def byte_cap_body(spark, sf):
    big = F.octet_length("text") > 2048
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.length(F.when(big, F.substring("text", 1, 1024)).otherwise(F.col("text"))).cast("long").alias("kept"), big.alias("truncated"))


@query("WITH a AS (SELECT paper_id, theorem_label, row_number() OVER (PARTITION BY paper_id ORDER BY theorem_label) AS i FROM (SELECT DISTINCT paper_id, theorem_label FROM chunks WHERE theorem_label IS NOT NULL)), b AS (SELECT paper_id, printed_number, row_number() OVER (PARTITION BY paper_id ORDER BY printed_number) AS i FROM (SELECT DISTINCT paper_id, printed_number FROM chunks WHERE printed_number IS NOT NULL)) SELECT coalesce(a.paper_id, b.paper_id) AS paper_id, coalesce(a.i, b.i) AS place, theorem_label AS label, printed_number AS number FROM a FULL JOIN b ON a.paper_id = b.paper_id AND a.i = b.i")
def label_alignment(spark, sf):
    """Two lists of a paper aligned by ordinal; a list that is longer shows as nulls."""
    c = table(spark, sf, "chunks")

    def numbered(col, name):
        return c.where(F.col(col).isNotNull()).select("paper_id", F.col(col).alias(name)).distinct().withColumn("place", F.row_number().over(W.partitionBy("paper_id").orderBy(name)).cast("long"))

    return numbered("theorem_label", "label").join(numbered("printed_number", "number"), ["paper_id", "place"], "full_outer")


@query("SELECT version, lag(version) OVER (ORDER BY version) AS prior FROM (SELECT DISTINCT dayofyear(ts) AS version FROM events)")
def prior_report(spark, sf):
    v = table(spark, sf, "events").select(F.dayofyear("ts").cast("long").alias("version")).distinct()
    return v.withColumn("prior", F.lag("version").over(W.orderBy("version")))


@query("SELECT item_id, sha256(lpad(strlen(trim(text))::VARCHAR, 8, '0') || trim(text) || '00000002' || '10' || lpad(strlen(suite)::VARCHAR, 8, '0') || suite) AS key FROM eval_items")
def cache_keys(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", F.sha2(text.prefixed(F.trim("text"), F.lit(10), F.col("suite")), 256).alias("key"))


@query("SELECT DISTINCT paper_id, concat_ws(' ', nullif(primary_category, ''), nullif(year, 0)::VARCHAR, nullif(published, '')) AS ref FROM paper_metadata")
def journal_refs(spark, sf):
    """Parts that are there, joined by spaces."""
    return table(spark, sf, "paper_metadata").select("paper_id", F.concat_ws(" ", F.nullif("primary_category", F.lit("")), F.nullif("year", F.lit(0)).cast("string"), F.nullif("published", F.lit(""))).alias("ref")).distinct()


@query("SELECT o_orderkey, isoyear(o_orderdate)::BIGINT AS year, weekofyear(o_orderdate)::BIGINT AS week FROM orders")
def week_parse(spark, sf):
    """Week names ``YYYY-Www`` written and parsed."""
    name = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")), F.weekofyear("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("w")).select("o_orderkey", F.regexp_extract("w", r"^(\d{4})-W(\d{2})$", 1).cast("long").alias("year"), F.regexp_extract("w", r"^(\d{4})-W(\d{2})$", 2).cast("long").alias("week"))


@query("SELECT event_type, round(sum(json_extract(props, '$.k')::BIGINT * 1000 / 1e6 * CASE WHEN event_type = 'purchase' THEN 15 ELSE 3 END), 6) AS spend FROM events GROUP BY 1")
def spend(spark, sf):
    """Tokens over a million times the price of the role."""
    tokens = F.get_json_object("props", "$.k").cast("long") * 1000
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(tokens / F.lit(1e6) * F.when(F.col("event_type") == "purchase", 15).otherwise(3)), 6).alias("spend"))


@query("WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1) SELECT event_type, unnest(list_filter([CASE WHEN n < 1500 THEN 'few' END, CASE WHEN mean > 10 THEN 'slow' END, CASE WHEN p95 > 30 THEN 'tail' END], lambda x: x IS NOT NULL)) AS alert FROM m")
def alert_rules(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"))
    rules = {"few": F.col("n") >= 1500, "slow": F.col("mean") <= 10, "tail": F.col("p95") <= 30}
    return merge.violations(m, rules, "event_type").withColumnRenamed("rule", "alert")


@query("WITH c AS (SELECT paper_id, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1), m AS (SELECT work_id, count(DISTINCT section_no) AS k FROM documents GROUP BY 1) SELECT paper_id, CASE WHEN k IS NULL THEN 'no_marker' WHEN k < 1 THEN 'malformed_marker' WHEN k = n THEN 'ok' ELSE 'drift' END AS health FROM c LEFT JOIN m ON paper_id = work_id")
def notebook_health(spark, sf):
    c = table(spark, sf, "chunks").groupBy("paper_id").agg(F.countDistinct("chunk_id").alias("n"))
    m = table(spark, sf, "documents").groupBy(F.col("work_id").alias("paper_id")).agg(F.countDistinct("section_no").alias("k"))
    return c.join(m, "paper_id", "left").select("paper_id", F.when(F.col("k").isNull(), "no_marker").when(F.col("k") < 1, "malformed_marker").when(F.col("k") == F.col("n"), "ok").otherwise("drift").alias("health"))


@query("SELECT work_id, arxiv_version, status <> 'active' AS invalidated, CASE WHEN status <> 'active' THEN status END AS reason FROM (SELECT DISTINCT work_id, arxiv_version, status FROM documents)")
def revision_list(spark, sf):
    d = table(spark, sf, "documents").select("work_id", "arxiv_version", "status").distinct()
    return d.select("work_id", "arxiv_version", (F.col("status") != "active").alias("invalidated"), F.when(F.col("status") != "active", F.col("status")).alias("reason")).orderBy("work_id", "arxiv_version")


@query("SELECT count(*) AS total, count_if(status = 'active')::BIGINT AS active, count_if(status = 'withdrawn')::BIGINT AS withdrawn, count_if(status = 'superseded')::BIGINT AS superseded FROM documents")
def revision_digest(spark, sf):
    s = F.col("status")
    return reports.census(table(spark, sf, "documents"), [], {"active": s == "active", "withdrawn": s == "withdrawn", "superseded": s == "superseded"})


@query("WITH r AS (SELECT DISTINCT work_id, arxiv_version FROM documents), m AS (SELECT DISTINCT paper_id, CASE WHEN year % 2 = 0 THEN 'v1' ELSE '' END AS v FROM paper_metadata) SELECT paper_id, v FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.work_id = m.paper_id AND (m.v = '' OR m.v = r.arxiv_version))")
def registration_gate(spark, sf):
    """Papers not registered yet: with a revision that exact pair, without one any revision."""
    r = table(spark, sf, "documents").select("work_id", "arxiv_version").distinct()
    m = table(spark, sf, "paper_metadata").select("paper_id", F.when(F.col("year") % 2 == 0, "v1").otherwise("").alias("v")).distinct()
    exact = m.where("v <> ''").join(r, (F.col("paper_id") == F.col("work_id")) & (F.col("v") == F.col("arxiv_version")), "left_anti")
    return exact.unionByName(m.where("v = ''").join(r.select("work_id").distinct(), F.col("paper_id") == F.col("work_id"), "left_anti"))


@query("SELECT coalesce(a.p, b.p) AS work_id, CASE WHEN a.p IS NULL THEN 'only_second' WHEN b.p IS NULL THEN 'only_first' ELSE 'both' END AS bucket FROM (SELECT DISTINCT work_id AS p FROM documents) a FULL JOIN (SELECT DISTINCT paper_id AS p FROM chunks) b ON a.p = b.p")
def registry_repair(spark, sf):
    return merge.compare_keys(table(spark, sf, "documents").select("work_id"), table(spark, sf, "chunks").select(F.col("paper_id").alias("work_id")), "work_id")


@query("SELECT chunk_id, substring(body_text, 1, 4000) = body_text AS whole, CASE WHEN length(body_text) > 4000 THEN true END AS cut FROM (SELECT DISTINCT chunk_id, body_text FROM chunks)")
def referenced_shape(spark, sf):
    c = table(spark, sf, "chunks").select("chunk_id", "body_text").distinct()
    return c.select("chunk_id", (F.substring("body_text", 1, 4000) == F.col("body_text")).alias("whole"), F.when(F.length("body_text") > 4000, True).alias("cut"))


@query("SELECT chunk_id FROM theorem_names EXCEPT SELECT chunk_id FROM chunks")
def index_sync(spark, sf):
    """Ids of the name index that no live chunk has."""
    return table(spark, sf, "theorem_names").select("chunk_id").subtract(table(spark, sf, "chunks").select("chunk_id"))


@query("SELECT version, score, coalesce(lag(kind) OVER (ORDER BY version) = kind, false) AS comparable FROM (SELECT dayofyear(ts) AS version, round(avg(value), 6) AS score, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1)")
def comparable_versions(spark, sf):
    """Scores whose version before was made with the same model."""
    v = table(spark, sf, "events").groupBy(F.dayofyear("ts").cast("long").alias("version")).agg(F.round(F.avg("value"), 6).alias("score"), F.min_by("event_type", "event_id").alias("kind"))
    return v.select("version", "score", F.coalesce(F.lag("kind").over(W.orderBy("version")) == F.col("kind"), F.lit(False)).alias("comparable"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'theorem|lemma|corollary|proposition')) >= 2 AND NOT contains(text, 'ltx_theorem') AS missed FROM documents WHERE text IS NOT NULL")
def markup_miss(spark, sf):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("theorem|lemma|corollary|proposition"), F.lit(0)))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", ((n >= 2) & ~F.col("text").contains("ltx_theorem")).alias("missed"))


@query("SELECT id, CASE WHEN exit_code IS NULL THEN 'unfinished' WHEN exit_code <> 0 THEN 'exit ' || exit_code ELSE 'ok' END AS outcome FROM (SELECT DISTINCT id, exit_code FROM notebook_ingest_runs)")
def parse_success(spark, sf):
    r = table(spark, sf, "notebook_ingest_runs").select("id", "exit_code").distinct()
    return r.select("id", F.when(F.col("exit_code").isNull(), "unfinished").when(F.col("exit_code") != 0, F.concat(F.lit("exit "), F.col("exit_code").cast("string"))).otherwise("ok").alias("outcome"))


@query(r"SELECT DISTINCT paper_id, regexp_replace(paper_id, 'v\d+$', '') AS found FROM paper_metadata")
def url_to_paper(spark, sf):
    """Ids read from links of allowed hosts, revision and extension cut off."""
    link = table(spark, sf, "paper_metadata").select("paper_id", F.concat(F.lit("https://arxiv.org/pdf/"), F.col("paper_id"), F.lit(".pdf?x=1")).alias("u")).distinct()
    path = F.when(F.parse_url("u", F.lit("HOST")).isin("arxiv.org", "www.arxiv.org"), F.parse_url("u", F.lit("PATH")))
    return link.select("paper_id", text.strip_version(F.regexp_replace(F.regexp_extract(path, r"^/(?:abs|pdf)/(.+)$", 1), r"\.pdf$", "")).alias("found"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5")
def latest_versions(spark, sf):
    """The five newest rows of each key; older ones are evicted."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id", "value")


@query("SELECT event_id FROM events WHERE epoch_us(ts) + 3600 * 1000000::BIGINT > (SELECT max(epoch_us(ts)) FROM events)")
def unexpired(spark, sf):
    """Rows not older than an hour at the time of the last one."""
    e = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.crossJoin(F.broadcast(e.agg(F.max("us").alias("now")))).where("us + 3600 * 1000000L > now").select("event_id")


_HASHES = "WITH l0 AS (SELECT coalesce(source, '') AS source, doc_id AS k, coalesce(raw_source_sha256, '-') AS h FROM documents), l1 AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l0 GROUP BY source, k // 1000), l2 AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l1 GROUP BY source, k // 1000)"


@query(f"{_HASHES} SELECT source, sha256(string_agg(h, '' ORDER BY k)) AS tree FROM l2 GROUP BY 1")
def tree_hash(spark, sf):
    """A hash over the ordered hashes of each source's files, as a tree of a thousand children a node: no list is longer."""
    level = table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("k"), F.coalesce("raw_source_sha256", F.lit("-")).alias("h"))

    def up(df, group):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x.h)
        return df.groupBy("source", *group).agg(F.sha2(F.array_join(ordered, ""), 256).alias("h"))

    for _ in range(2):
        level = up(level.withColumn("g", F.floor(F.col("k") / 1000)), ["g"]).withColumnRenamed("g", "k")
    return up(level, []).select("source", F.col("h").alias("tree"))


@query("SELECT paper_id, count(*) AS unused FROM (SELECT DISTINCT c.paper_id, c.chunk_id FROM chunks c WHERE c.paper_id NOT IN (SELECT dst FROM cites WHERE dst IS NOT NULL)) GROUP BY 1")
def purge_plan(spark, sf):
    """Papers that nothing cites, with the number of chunks that would go."""
    c = table(spark, sf, "chunks").select("paper_id", "chunk_id").distinct()
    return c.join(table(spark, sf, "cites").select(F.col("dst").alias("paper_id")).distinct(), "paper_id", "left_anti").groupBy("paper_id").agg(F.count(F.lit(1)).alias("unused"))


@query("WITH s AS (SELECT DISTINCT paper_id, kind, chunker_version, sha256(body_text) AS h, embedder_version LIKE '%9a8b7c6d' AS staged FROM chunks), a AS (SELECT paper_id, kind, chunker_version, h FROM s WHERE staged), b AS (SELECT paper_id, kind, chunker_version, h FROM s WHERE NOT staged), d AS (SELECT paper_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION SELECT paper_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT DISTINCT paper_id, paper_id NOT IN (SELECT paper_id FROM d) AS same FROM s")
def resume_skip(spark, sf):
    """Papers whose staged rows have the same set of signatures as the active ones."""
    s = table(spark, sf, "chunks").select("paper_id", "kind", "chunker_version", F.sha2("body_text", 256).alias("h"), F.col("embedder_version").like("%9a8b7c6d").alias("staged")).distinct()
    sides = s.groupBy("paper_id", "kind", "chunker_version", "h").agg(F.countDistinct("staged").alias("n"))
    return sides.groupBy("paper_id").agg((F.min("n") == 2).alias("same"))


@query("SELECT identity, min(chunk_id) AS chunk_id FROM (SELECT chunk_id, sha256(body_text) AS identity FROM chunks WHERE embedding_stmt IS NOT NULL AND embed_input_policy_version IS NOT NULL) GROUP BY 1")
def reusable_vectors(spark, sf):
    c = table(spark, sf, "chunks").where("embedding_stmt IS NOT NULL AND embed_input_policy_version IS NOT NULL")
    return c.groupBy(F.sha2("body_text", 256).alias("identity")).agg(F.min("chunk_id").alias("chunk_id"))


@query("SELECT paper_id FROM chunks UNION SELECT paper_id FROM paper_metadata ORDER BY 1")
def work_list(spark, sf):
    return table(spark, sf, "chunks").select("paper_id").union(table(spark, sf, "paper_metadata").select("paper_id")).distinct().orderBy("paper_id")


@query("SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.name ELSE o.c_name END AS name FROM (SELECT * FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') o FULL JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 4000 THEN 'new' END AS name FROM customer WHERE c_mktsegment <> 'MACHINERY') n ON o.c_custkey = n.c_custkey")
def overwrite_merge(spark, sf):
    """New values replace old ones even where they are null."""
    c = table(spark, sf, "customer")
    old = c.where("c_mktsegment <> 'HOUSEHOLD'").select("c_custkey", F.col("c_name").alias("name"))
    return merge.upsert(old, c.where("c_mktsegment <> 'MACHINERY'").select("c_custkey", F.when(F.col("c_acctbal") > 4000, "new").alias("name")), ["c_custkey"])


@query("SELECT chunk_id, paper_id, substring(sha256('stmt' || body_text), 1, 16) AS identity FROM (SELECT DISTINCT chunk_id, paper_id, body_text FROM chunks WHERE embedding_stmt IS NULL AND embedding_proof IS NULL)")
def pending_embeddings(spark, sf):
    """Chunks without any vector, by identity: what is still to be embedded."""
    c = table(spark, sf, "chunks")
    without = c.where("embedding_stmt IS NULL AND embedding_proof IS NULL").select("chunk_id", "paper_id", F.substring(F.sha2(F.concat(F.lit("stmt"), "body_text"), 256), 1, 16).alias("identity")).distinct()
    have = c.where("coalesce(embedding_stmt, embedding_proof) IS NOT NULL").select(F.col("chunk_id"))
    return hooks.pending(without, have, ["chunk_id"])


@query()
def hashed_embeddings(spark, sf):
    """Every document embedded by the default encoder, three nearest test items each; one without text has nulls."""
    from quillon.plans.search import item_vectors

    d = hooks.embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    near = vectors.nearest_of(d, "doc_id", "embedding", item_vectors(spark, sf), 3)
    return near.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "score", "rank")


@query()
def rerank_overlap(spark, sf):
    """The lexical and dense lists of each test item fused and reranked by word overlap, the three best."""
    from quillon.plans.search import hybrid_search

    return hybrid_search(spark, sf, k=3)


@query("SELECT item_id, unnest(list_filter([CASE WHEN trim(text) = '' THEN 'text' END, CASE WHEN n > 1 THEN 'unique' END, CASE WHEN k < 5 THEN 'suite' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT item_id, text, count(*) OVER (PARTITION BY item_id) AS n, count(*) OVER (PARTITION BY suite) AS k FROM eval_items)")
def fixture_gates(spark, sf):
    """Test items that break a rule: no text, an id twice, a suite of under five items."""
    i = table(spark, sf, "eval_items").withColumns({"n": F.count(F.lit(1)).over(W.partitionBy("item_id")), "k": F.count(F.lit(1)).over(W.partitionBy("suite"))})
    return merge.violations(i, {"text": F.trim("text") != "", "unique": F.col("n") == 1, "suite": F.col("k") >= 5}, "item_id")


@query("SELECT 'chunks' AS name, count(DISTINCT chunk_id) AS rows FROM chunks UNION ALL SELECT 'names', count(DISTINCT (paper_id, theorem_name, section_path)) FROM chunks WHERE trim(theorem_name) <> '' UNION ALL SELECT 'terms', count(DISTINCT t) FROM (SELECT unnest(string_split(body_tokens, ' ')) AS t FROM chunks) WHERE t <> ''")
def derived_indexes(spark, sf):
    """Chunks published as a table, the indexes made from that version published beside it; their row counts from the manifest."""
    from quillon.operators.bm25 import Bm25
    from quillon.operators.extract import theorem_names
    from quillon.session import scratch
    from quillon.sources.catalog import Catalog

    c = Catalog(spark, scratch(spark, "catalog"))
    source = table(spark, sf, "chunks").select("chunk_id", "paper_id", "theorem_name", "section_path", "body_tokens")
    c.write("chunks", merge.latest(source, ["chunk_id"], [F.col("paper_id")]))
    rows = c.scan("chunks")
    c.write("names", theorem_names(rows).dropDuplicates(["dedup_key"]))
    c.write("terms", Bm25(rows.select(F.col("chunk_id").alias("id"), F.filter(F.split("body_tokens", " "), lambda x: x != "").alias("tokens"))).terms)
    return spark.createDataFrame([(n, m["rows"]) for n, m in c.manifest().items()], "name string, rows long")


@query("SELECT item_id, coalesce(t1, t2) AS entry, CASE WHEN t1 IS NOT NULL THEN 'exact' WHEN t2 IS NOT NULL THEN 'near' ELSE 'miss' END AS tier FROM (SELECT i.item_id, (SELECT min(b.item_id) FROM eval_items b WHERE b.text = i.text AND b.item_id <> i.item_id) AS t1, (SELECT min(b.item_id) FROM eval_items b WHERE b.suite = i.suite AND b.item_id <> i.item_id AND length(b.text) = length(i.text)) AS t2 FROM eval_items i)")
def cache_tiers(spark, sf):
    """Each item looked up among the others: an equal text first, else one of the same scope and length, else none."""
    i = table(spark, sf, "eval_items").select("item_id", "suite", "text", F.length("text").alias("n"))
    o = i.select(F.col("item_id").alias("entry"), "suite", "text", "n")
    exact = i.join(o.select("entry", "text"), "text").where("entry <> item_id").groupBy("item_id").agg(F.min("entry").alias("t1"))
    near = i.join(o.select("entry", "suite", "n"), ["suite", "n"]).where("entry <> item_id").groupBy("item_id").agg(F.min("entry").alias("t2"))
    both = i.select("item_id").join(exact, "item_id", "left").join(near, "item_id", "left")
    return both.select("item_id", F.coalesce("t1", "t2").alias("entry"), F.when(F.col("t1").isNotNull(), "exact").when(F.col("t2").isNotNull(), "near").otherwise("miss").alias("tier"))
