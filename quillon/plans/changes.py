"""Merges, set operations, reuse, gates and versions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import text
from quillon.operators import merge
from quillon.plans._read import table


def _items(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_quantity", "l_shipdate").groupBy("l_orderkey", "line").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").alias("quantity"), F.max("l_shipdate").alias("shipped"))


def _halves(spark, sf):
    i = _items(spark, sf)
    return i.where("shipped < '2000-01-01'").drop("shipped"), i.where("shipped >= '1999-06-01'").withColumn("quantity", F.col("quantity") + 1).drop("shipped")


def merge_upsert(spark, sf):
    return merge.upsert(*_halves(spark, sf), ["l_orderkey", "line"])


def merge_replace_group(spark, sf):
    return merge.replace_group(*_halves(spark, sf), ["l_orderkey", "line"], "l_orderkey")


def merge_insert_absent(spark, sf):
    return merge.insert_absent(*_halves(spark, sf), ["l_orderkey", "line"])


def delete_keys(spark, sf):
    old, new = _halves(spark, sf)
    return merge.delete(old, "l_orderkey", new.select("l_orderkey"))


def merge_coalesce(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_mktsegment <> 'HOUSEHOLD'").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("nation"))
    new = c.where("c_mktsegment <> 'MACHINERY'").select("c_custkey", F.when(F.col("c_acctbal") > 4000, F.upper("c_name")).alias("c_name"), (F.col("c_nationkey") + 1).cast("long").alias("nation"))
    return merge.coalesce_merge(old, new, "c_custkey")


def latest_wins(spark, sf):
    """Of repeated deliveries of a paper the last fetched one."""
    p = table(spark, sf, "paper_metadata").select("paper_id", "title", "abstract", "fetched_at")
    return merge.latest(p, ["paper_id"], [F.desc("fetched_at"), F.desc(F.length("abstract")), F.col("title"), F.col("abstract")])


def dedup_first_wins(spark, sf):
    """Of documents of the same white-space-collapsed text the one with the least id; and how many there are."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(text.collapsed(F.col("text")), 256).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def collision_gate(spark, sf):
    """Chunk ids that stand for more than one body: none if all repeats are exact."""
    return table(spark, sf, "chunks").groupBy("chunk_id").agg(F.countDistinct("body_text").alias("bodies")).where("bodies > 1")


def duplicate_keys(spark, sf):
    return table(spark, sf, "chunks").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def reuse_diff(spark, sf):
    """Chunks of the newer embedder and policy that may copy a vector of the older by identity, or must be embedded again."""
    c = table(spark, sf, "chunks").select("chunk_id", "embedder_version", F.col("embedding_stmt").alias("vector"), F.when(F.col("embed_input_policy_version").isNotNull(), F.sha2(text.prefixed(F.col("embed_input_policy_version"), F.col("kind"), text.collapsed(F.col("body_text"))), 256)).alias("identity")).distinct()
    plan = merge.reuse_plan(c.where("embedder_version LIKE '%9a8b7c6d'").drop("vector"), c.where("embedder_version LIKE '%1f2e3d4c'"), "identity", "chunk_id", "vector")
    return plan.select("chunk_id", "action", "source_key")


def set_unique(spark, sf):
    """Papers cited from textbooks' documents only, in one set, and in both."""
    d = table(spark, sf, "documents")
    return merge.compare_keys(d.where("source = 'arxiv'").select("work_id"), d.where("source = 'ar5iv'").select("work_id"), "work_id")


def set_shared(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("source = 'arxiv'").select("work_id").intersect(table(spark, sf, "paper_metadata").select(F.col("paper_id").alias("work_id")))


def set_difference(spark, sf):
    """Cited papers without metadata."""
    return table(spark, sf, "cites").select(F.col("dst").alias("paper")).union(table(spark, sf, "cites").select("src")).subtract(table(spark, sf, "paper_metadata").select("paper_id"))


def anti_join_discovery(spark, sf):
    """Papers known by metadata that no chunk comes from yet, version stripped."""
    have = table(spark, sf, "chunks").select(text.strip_version(F.col("paper_id")).alias("p")).distinct()
    meta = table(spark, sf, "paper_metadata").select("paper_id", text.strip_version(F.col("paper_id")).alias("p")).distinct()
    return meta.join(have, "p", "left_anti").select("paper_id")


def asof_version(spark, sf):
    """The revision of each order's customer that was current when a line was shipped: the last order before it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    left = lines.join(o, lines.l_orderkey == o.o_orderkey).groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "o_custkey").agg(F.max("l_shipdate").alias("shipped"))
    right = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("version"))
    return merge.as_of(left, right, "o_custkey", "shipped", "o_orderdate", "version").select("l_orderkey", "line", "version")


def quality_gates(spark, sf):
    """Chunk rows and the write rules they break."""
    from quillon.functions import vectors

    c = table(spark, sf, "chunks")
    vector = F.coalesce("embedding_stmt", "embedding_proof")
    rules = {
        "not_truncated": ~F.coalesce("truncated", F.lit(False)),
        "tokens": F.col("body_tokens").isNotNull() & (F.col("body_tokens") != ""),
        "prefix": F.when(F.col("source_kind") == "textbook", F.col("chunk_id").startswith("textbook:")).otherwise(F.col("chunk_id").startswith("arxiv:")),
        "one_vector": F.col("embedding_stmt").isNull() | F.col("embedding_proof").isNull(),
        "route": F.when(F.col("kind") == "proof", F.col("embedding_stmt").isNull()).otherwise(F.col("embedding_proof").isNull()),
        "unit": vector.isNull() | (F.abs(F.round(vectors.norm(vector), 6) - 1) <= 0.001),
        "parts": F.col("part_index").isNull() | F.col("part_index").between(1, F.col("part_count")),
    }
    return merge.violations(c.distinct(), rules, "chunk_id").distinct()


def corpus_validation(spark, sf):
    """One row of counts over all chunks: papers, embedder versions, policies, legacy rows, proofs without a vector."""
    c = table(spark, sf, "chunks")
    return c.agg(F.countDistinct("paper_id").alias("papers"), F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("rows"), F.countDistinct("embedder_version").alias("embedders"), F.count_if(F.col("embed_input_policy_version").isNull()).alias("legacy"), F.count_if((F.col("kind") == "proof") & F.col("embedding_proof").isNull()).alias("proofs_without"))


def version_mixing(spark, sf):
    """Papers whose chunks come from several embedder or chunker versions."""
    return table(spark, sf, "chunks").groupBy("paper_id").agg(F.countDistinct("embedder_version").alias("embedders"), F.countDistinct("chunker_version").alias("chunkers")).where("embedders > 1 OR chunkers > 1")


def prune_plan(spark, sf):
    """Ingest runs older than thirty days behind the last and not among the two newest of their slug."""
    r = table(spark, sf, "notebook_ingest_runs").groupBy("id").agg(F.max("slug").alias("slug"), F.max("started_at").alias("t"))
    n = r.withColumns({"n": F.row_number().over(W.partitionBy("slug").orderBy(F.desc("t"), F.desc("id"))), "last": F.max("t").over(W.partitionBy("slug"))})
    return n.where("n > 2 AND t < last - INTERVAL 1 HOURS").select("id", "slug")


def registry_backfill(spark, sf):
    """Chunks joined to the registry of documents by paper: exactly one registered revision resolves, else the reason why not."""
    d = table(spark, sf, "documents").groupBy("work_id").agg(F.countDistinct("arxiv_version").alias("n"), F.max("arxiv_version").alias("v"))
    c = table(spark, sf, "chunks").select("chunk_id", "paper_id").distinct()
    j = c.join(d, F.col("paper_id") == F.col("work_id"), "left")
    return j.select("chunk_id", F.when(F.col("n") == 1, F.when(F.col("v") != "", F.concat_ws("@", "paper_id", "v")).otherwise(F.col("paper_id"))).alias("revision"), F.when(F.col("n").isNull(), "unregistered").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("reason"))


_I = "i AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, max(l_partkey) AS part, max(l_quantity) AS quantity, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey, line, part, quantity FROM i WHERE shipped < '2000-01-01'), n AS (SELECT l_orderkey, line, part, quantity + 1 AS quantity FROM i WHERE shipped >= '1999-06-01')"
_COLL = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_PREF = "lpad(strlen({0})::VARCHAR, 8, '0') || {0}"

QUERIES = {f.__name__: f for f in (merge_upsert, merge_replace_group, merge_insert_absent, delete_keys, merge_coalesce, latest_wins, dedup_first_wins, collision_gate, duplicate_keys, reuse_diff, set_unique, set_shared, set_difference, anti_join_discovery, asof_version, quality_gates, corpus_validation, version_mixing, prune_plan, registry_backfill)}
ORACLE_SQL = {
    "merge_upsert": f"WITH {_I} SELECT * FROM n UNION ALL SELECT * FROM o WHERE (l_orderkey, line) NOT IN (SELECT (l_orderkey, line) FROM n)",
    "merge_replace_group": f"WITH {_I} SELECT * FROM n UNION ALL SELECT * FROM o WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n)",
    "merge_insert_absent": f"WITH {_I} SELECT * FROM o UNION ALL SELECT * FROM n WHERE (l_orderkey, line) NOT IN (SELECT (l_orderkey, line) FROM o)",
    "delete_keys": f"WITH {_I} SELECT * FROM o WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n)",
    "merge_coalesce": "WITH o AS (SELECT c_custkey, c_name, c_nationkey::BIGINT AS nation FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'), n AS (SELECT c_custkey, CASE WHEN c_acctbal > 4000 THEN upper(c_name) END AS c_name, c_nationkey::BIGINT + 1 AS nation FROM customer WHERE c_mktsegment <> 'MACHINERY') SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.nation, o.nation) AS nation FROM o FULL JOIN n ON o.c_custkey = n.c_custkey",
    "latest_wins": "SELECT paper_id, title, abstract, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY fetched_at DESC, length(abstract) DESC, title, abstract) AS n FROM paper_metadata) WHERE n = 1",
    "dedup_first_wins": f"SELECT sha256({_COLL.format('text')}) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "collision_gate": "SELECT chunk_id, count(DISTINCT body_text) AS bodies FROM chunks GROUP BY 1 HAVING count(DISTINCT body_text) > 1",
    "duplicate_keys": "SELECT chunk_id, count(*) AS rows FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "reuse_diff": f"WITH c AS (SELECT DISTINCT chunk_id, embedder_version, embedding_stmt, CASE WHEN embed_input_policy_version IS NOT NULL THEN sha256({_PREF.format('embed_input_policy_version')} || {_PREF.format('kind')} || {_PREF.format(_COLL.format('body_text'))}) END AS identity FROM chunks), s AS (SELECT identity, min(chunk_id) AS source_key FROM c WHERE embedder_version LIKE '%1f2e3d4c' AND identity IS NOT NULL AND embedding_stmt IS NOT NULL GROUP BY 1) SELECT DISTINCT chunk_id, CASE WHEN source_key IS NOT NULL THEN 'copy' ELSE 're_embed' END AS action, source_key FROM c LEFT JOIN s USING (identity) WHERE embedder_version LIKE '%9a8b7c6d'",
    "set_unique": "SELECT coalesce(a.work_id, b.work_id) AS work_id, CASE WHEN a.work_id IS NULL THEN 'only_second' WHEN b.work_id IS NULL THEN 'only_first' ELSE 'both' END AS bucket FROM (SELECT DISTINCT work_id FROM documents WHERE source = 'arxiv') a FULL JOIN (SELECT DISTINCT work_id FROM documents WHERE source = 'ar5iv') b ON a.work_id = b.work_id",
    "set_shared": "SELECT work_id FROM documents WHERE source = 'arxiv' INTERSECT SELECT paper_id FROM paper_metadata",
    "set_difference": "SELECT paper FROM (SELECT dst AS paper FROM cites UNION SELECT src FROM cites) EXCEPT SELECT paper_id FROM paper_metadata",
    "anti_join_discovery": r"SELECT DISTINCT paper_id FROM paper_metadata WHERE regexp_replace(paper_id, 'v\d+$', '') NOT IN (SELECT regexp_replace(paper_id, 'v\d+$', '') FROM chunks)",
    "asof_version": "WITH l AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, o_custkey, max(l_shipdate) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), r AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS version FROM orders GROUP BY 1, 2) SELECT l_orderkey, line, version FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.shipped >= r.o_orderdate",
    "quality_gates": "WITH c AS (SELECT *, coalesce(embedding_stmt, embedding_proof)::DOUBLE[] AS v FROM chunks), b AS (SELECT chunk_id, CASE WHEN coalesce(truncated, false) THEN 'not_truncated' END AS a1, CASE WHEN body_tokens IS NULL OR body_tokens = '' THEN 'tokens' END AS a2, CASE WHEN NOT starts_with(chunk_id, CASE WHEN source_kind = 'textbook' THEN 'textbook:' ELSE 'arxiv:' END) THEN 'prefix' END AS a3, CASE WHEN embedding_stmt IS NOT NULL AND embedding_proof IS NOT NULL THEN 'one_vector' END AS a4, CASE WHEN CASE WHEN kind = 'proof' THEN embedding_stmt ELSE embedding_proof END IS NOT NULL THEN 'route' END AS a5, CASE WHEN v IS NOT NULL AND abs(round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) - 1) > 0.001 THEN 'unit' END AS a6, CASE WHEN part_index IS NOT NULL AND NOT coalesce(part_index BETWEEN 1 AND part_count, false) THEN 'parts' END AS a7 FROM c) SELECT DISTINCT chunk_id, rule FROM (SELECT chunk_id, unnest([a1, a2, a3, a4, a5, a6, a7]) AS rule FROM b) WHERE rule IS NOT NULL",
    "corpus_validation": "SELECT count(DISTINCT paper_id) AS papers, count(DISTINCT chunk_id) AS chunks, count(*) AS rows, count(DISTINCT embedder_version) AS embedders, count_if(embed_input_policy_version IS NULL)::BIGINT AS legacy, count_if(kind = 'proof' AND embedding_proof IS NULL)::BIGINT AS proofs_without FROM chunks",
    "version_mixing": "SELECT paper_id, count(DISTINCT embedder_version) AS embedders, count(DISTINCT chunker_version) AS chunkers FROM chunks GROUP BY 1 HAVING count(DISTINCT embedder_version) > 1 OR count(DISTINCT chunker_version) > 1",
    "prune_plan": "WITH r AS (SELECT id, max(slug) AS slug, max(started_at) AS t FROM notebook_ingest_runs GROUP BY 1) SELECT id, slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY t DESC, id DESC) AS n, max(t) OVER (PARTITION BY slug) AS last FROM r) WHERE n > 2 AND t < last - INTERVAL 1 HOUR",
    "registry_backfill": "WITH d AS (SELECT work_id, count(DISTINCT arxiv_version) AS n, max(arxiv_version) AS v FROM documents GROUP BY 1) SELECT DISTINCT chunk_id, CASE WHEN n = 1 THEN CASE WHEN v <> '' THEN paper_id || '@' || v ELSE paper_id END END AS revision, CASE WHEN n IS NULL THEN 'unregistered' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS reason FROM chunks LEFT JOIN d ON paper_id = work_id",
}
