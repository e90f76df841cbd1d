"""Names, definitions, chunks with their linkage, papers, and the citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import text
from quillon.operators import graph, linkage
from quillon.operators.lookup import by_name, cascade
from quillon.plans._read import table


def name_cascade(spark, sf):
    """A few names looked up among the part names: exact, contained, misspelt, none, empty."""
    index = table(spark, sf, "part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))
    asked = spark.createDataFrame([(1, "small ring"), (2, "ring"), (3, "smal rng"), (4, "zz"), (5, ""), (6, "red widgets")], "query long, wanted string")
    return by_name(index, asked).select("query", "id", "mode", "score", F.col("rank").cast("long").alias("rank"))


def results_by_name(spark, sf):
    """Theorem names found for each registered result: exact, contained or similar, the ten best."""
    names = table(spark, sf, "theorem_names").groupBy(F.col("dedup_key").alias("id")).agg(F.min(text.name_key("display_name")).alias("key"))
    asked = table(spark, sf, "named_results").select(F.col("result_id").alias("query"), text.name_key("canonical_name").alias("wanted"))
    return by_name(names, asked).select("query", "id", "mode", "score", F.col("rank").cast("long").alias("rank"))


def scan_fallback(spark, sf):
    """Names that contain the word, those equal to it first, any case."""
    n = table(spark, sf, "theorem_names").where(F.lower("display_name").contains("lemma")).select("dedup_key", "display_name").distinct()
    return n.orderBy(F.when(F.lower("display_name") == "lemma", 0).otherwise(1), "dedup_key", "display_name").limit(50)


def term_cascade(spark, sf):
    """Definitions: equal brand, then equal type, then a prefix of the type in any case."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("raw"))
    asked = spark.createDataFrame([(1, "Brand#2"), (2, "ECONOMY"), (3, "eco"), (4, "nothing")], "query long, t string")
    steps = [("symbol", F.col("symbol") == F.col("t"), F.lit(1.0)), ("raw", F.col("raw") == F.col("t"), F.lit(1.0)), ("prefix", F.lower("raw").startswith(F.lower("t")), F.lit(1.0))]
    return cascade(p.crossJoin(F.broadcast(asked)), steps, "query", "id", 100).select("query", "id", "mode", F.col("rank").cast("long").alias("rank"))


def term_page(spark, sf):
    """The second page of a hundred, by symbol and id."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("id"))
    return p.orderBy("symbol", "id").offset(100).limit(100)


def chunk_lookup(spark, sf):
    """A request of ids in its order, each with its row or marked as not found."""
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    first = rows.orderBy("doc_id").limit(5).select("doc_id", (F.row_number().over(W.orderBy("doc_id")) * 2).cast("long").alias("place"))
    wanted = first.unionByName(spark.createDataFrame([(1, 1), (2, 3)], "doc_id long, place long"))
    return wanted.join(rows.withColumn("found", F.lit(True)), "doc_id", "left").select("place", "doc_id", "lang", F.coalesce("found", F.lit(False)).alias("found")).orderBy("place")


def _chunks(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", "paper_id", "kind", "theorem_label", "section_path").distinct()


def linkage_label(spark, sf):
    return linkage.by_label(_chunks(spark, sf))


def linkage_section_scope(spark, sf):
    return linkage.by_section(_chunks(spark, sf))


def linkage_outcomes(spark, sf):
    return linkage.outcomes(_chunks(spark, sf))


def paper_summary(spark, sf):
    """Chunks, distinct first sections (empty paths left out) and the least versions of each paper."""
    c = table(spark, sf, "chunks")
    return c.groupBy("paper_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct(F.try_element_at("section_path", F.lit(1))).alias("sections"), F.min("chunker_version").alias("chunker"), F.min("embedder_version").alias("embedder"))


def metadata_enrich(spark, sf):
    """Every paper of the chunks with its title and year, if they are known; year 0 isn't."""
    papers = table(spark, sf, "chunks").select("paper_id").distinct()
    w = W.partitionBy("p").orderBy(F.desc("fetched_at"), "title")
    meta = table(spark, sf, "paper_metadata").withColumn("p", text.strip_version(F.col("paper_id"))).withColumn("n", F.row_number().over(w)).where("n = 1").select("p", "title", "year")
    return papers.join(meta, text.strip_version(F.col("paper_id")) == F.col("p"), "left").select("paper_id", "title", F.when(F.col("year") > 0, F.col("year")).cast("long").alias("year"))


def _edges(spark, sf):
    return table(spark, sf, "cites").select("src", "dst", "source", F.col("confidence").cast("double").alias("confidence"))


def _walk(direction, depth):
    def run(spark, sf):
        """From every paper."""
        e = _edges(spark, sf)
        start = e.select("src").union(e.select("dst")).distinct()
        return graph.neighbours(e, start, direction, depth).select("start", "paper", F.col("hop").cast("long").alias("hop"), "source", F.round("confidence", 6).alias("confidence"), "edge_kind")

    return run


def representative_row(spark, sf):
    return graph.representatives(_chunks(spark, sf))


def _known(spark, sf):
    return table(spark, sf, "documents").where("raw_source_sha256 IS NOT NULL").select(F.col("work_id").alias("paper"), F.substring("raw_source_sha256", 1, 3).alias("work")).distinct()


def ref_resolution(spark, sf):
    """Work ids of cited papers resolved to the first paper that has them."""
    known = _known(spark, sf)
    refs = table(spark, sf, "cites").join(known.withColumnRenamed("paper", "dst"), "dst").groupBy(F.col("src").alias("paper")).agg(F.collect_set("work").alias("references"))
    return graph.resolve_references(refs, known)


def collision_report(spark, sf):
    return graph.collisions(_known(spark, sf)).withColumn("papers", F.col("papers").cast("long"))


def intra_paper_edges(spark, sf):
    """Labels mentioned in bodies as references, resolved within their paper."""
    c = table(spark, sf, "chunks").select("paper_id", F.explode(F.regexp_extract_all("theorem_label", F.lit(r"S\d+\.Thm\d+"), F.lit(0))).alias("label")).distinct()
    return graph.intra_edges(c, _chunks(spark, sf))


def edge_merge(spark, sf):
    """The openAlex edges merged into the others; ends must be known papers."""
    e = _edges(spark, sf).distinct()
    papers = table(spark, sf, "paper_metadata").select(F.col("paper_id").alias("paper"))
    return graph.merge_edges(e.where("source <> 'openAlex'"), e.where("source = 'openAlex'"), papers).withColumn("confidence", F.round("confidence", 6))


def _walk_sql(direction, depth):
    e = {"cites": "SELECT DISTINCT src AS a, dst AS b, source, confidence::DOUBLE AS confidence FROM cites WHERE source <> 'intra-paper'", "cited_by": "SELECT DISTINCT dst AS a, src AS b, source, confidence::DOUBLE AS confidence FROM cites WHERE source <> 'intra-paper'", "depends_on": "SELECT DISTINCT src AS a, dst AS b, source, confidence::DOUBLE AS confidence FROM cites"}[direction]
    kind = "'cited_by'" if direction == "cited_by" else "CASE WHEN source = 'intra-paper' THEN 'ref' ELSE 'cites' END"
    two = "UNION ALL SELECT DISTINCT h1.start, e.b AS paper, 2 AS hop, e.source, e.confidence FROM h1 JOIN e ON e.a = h1.paper" if depth > 1 else ""
    return f"""WITH e AS ({e}), s AS (SELECT DISTINCT p AS start FROM (SELECT src AS p FROM cites UNION SELECT dst FROM cites)),
 h1 AS (SELECT start, b AS paper, 1 AS hop, source, confidence FROM s JOIN e ON e.a = s.start), h AS (SELECT * FROM h1 {two})
 SELECT start, paper, hop::BIGINT AS hop, source, round(confidence, 6) AS confidence, {kind} AS edge_kind FROM (SELECT *, row_number() OVER (PARTITION BY start, paper ORDER BY hop, source, confidence DESC NULLS LAST) AS n FROM h {"" if direction == "depends_on" else "WHERE paper <> start"}) WHERE n = 1"""


_JAC = """g AS (SELECT id, key, list_distinct(list_transform(range(1, greatest(length(key) - 1, 2)), lambda i: substring(key, i, 3))) AS grams FROM idx), a AS (SELECT query, wanted, list_distinct(list_transform(range(1, greatest(length(wanted) - 1, 2)), lambda i: substring(wanted, i, 3))) AS asked FROM q WHERE wanted <> ''),
 p AS (SELECT query, id, key, wanted, round(len(list_intersect(grams, asked))::DOUBLE / len(list_distinct(list_concat(grams, asked))), 6) AS jac FROM g, a),
 s AS (SELECT query, id, CASE WHEN key = wanted THEN 0 WHEN length(wanted) >= 3 AND contains(key, wanted) THEN 1 WHEN jac >= 0.3 THEN 2 END AS step, CASE WHEN key = wanted THEN 1.0 WHEN length(wanted) >= 3 AND contains(key, wanted) THEN 0.5 ELSE jac END::DOUBLE AS score FROM p),
 f AS (SELECT *, min(step) OVER (PARTITION BY query) AS least FROM s WHERE step IS NOT NULL)
 SELECT * FROM (SELECT query, id, ['exact', 'contains', 'fuzzy'][step + 1] AS mode, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f WHERE step = least) WHERE rank <= 10"""
_C = "c AS (SELECT DISTINCT chunk_id, paper_id, kind, theorem_label, section_path::VARCHAR AS section FROM chunks)"
_ST = "('stmt', 'theorem', 'lemma', 'proposition', 'corollary', 'definition', 'remark')"
_K = "known AS (SELECT DISTINCT work_id AS paper, substring(raw_source_sha256, 1, 3) AS work FROM documents WHERE raw_source_sha256 IS NOT NULL)"

QUERIES = {f.__name__: f for f in (name_cascade, results_by_name, scan_fallback, term_cascade, term_page, chunk_lookup, linkage_label, linkage_section_scope, linkage_outcomes, paper_summary, metadata_enrich, representative_row, ref_resolution, collision_report, intra_paper_edges, edge_merge)}
QUERIES |= {"cites_depth1": _walk("cites", 1), "cites_depth2": _walk("cites", 2), "cited_by_depth2": _walk("cited_by", 2), "depends_on_depth2": _walk("depends_on", 2)}
ORACLE_SQL = {
    "name_cascade": f"WITH idx AS (SELECT p_name AS key, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT * FROM (VALUES (1::BIGINT, 'small ring'), (2, 'ring'), (3, 'smal rng'), (4, 'zz'), (5, ''), (6, 'red widgets')) v(query, wanted)), {_JAC}",
    "results_by_name": f"WITH idx AS (SELECT dedup_key AS id, min(regexp_replace(strip_accents(lower(display_name)), '[^a-z0-9]', '', 'g')) AS key FROM theorem_names GROUP BY 1), q AS (SELECT result_id AS query, regexp_replace(strip_accents(lower(canonical_name)), '[^a-z0-9]', '', 'g') AS wanted FROM named_results), {_JAC}",
    "scan_fallback": "SELECT DISTINCT dedup_key, display_name FROM theorem_names WHERE contains(lower(display_name), 'lemma') ORDER BY CASE WHEN lower(display_name) = 'lemma' THEN 0 ELSE 1 END, dedup_key, display_name LIMIT 50",
    "term_cascade": "WITH q AS (SELECT * FROM (VALUES (1::BIGINT, 'Brand#2'), (2, 'ECONOMY'), (3, 'eco'), (4, 'nothing')) v(query, t)), s AS (SELECT query, p_partkey AS id, CASE WHEN p_brand = t THEN 0 WHEN p_type = t THEN 1 WHEN starts_with(lower(p_type), lower(t)) THEN 2 END AS step FROM part, q), f AS (SELECT *, min(step) OVER (PARTITION BY query) AS least FROM s WHERE step IS NOT NULL) SELECT * FROM (SELECT query, id, ['symbol', 'raw', 'prefix'][step + 1] AS mode, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM f WHERE step = least) WHERE rank <= 100",
    "term_page": "SELECT p_brand AS symbol, p_partkey AS id FROM part ORDER BY symbol, id LIMIT 100 OFFSET 100",
    "chunk_lookup": "WITH w AS (SELECT doc_id, 2 * row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5) UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 3) SELECT place, w.doc_id, d.lang, d.doc_id IS NOT NULL AS found FROM w LEFT JOIN documents d ON w.doc_id = d.doc_id",
    "linkage_label": f"WITH {_C} SELECT chunk_id, referenced_id FROM (SELECT c.chunk_id, o.chunk_id AS referenced_id, row_number() OVER (PARTITION BY c.chunk_id ORDER BY o.chunk_id) AS n FROM c JOIN c o ON c.paper_id = o.paper_id AND c.theorem_label = o.theorem_label AND (c.kind = 'proof') <> (o.kind = 'proof')) WHERE n <= 8",
    "linkage_section_scope": f"WITH {_C}, u AS (SELECT * FROM c WHERE theorem_label IS NULL), s AS (SELECT paper_id, section, count(*) AS n, count_if(kind IN {_ST}) AS k, min(CASE WHEN kind IN {_ST} THEN chunk_id END) AS referenced_id FROM u GROUP BY 1, 2) SELECT chunk_id, referenced_id FROM u JOIN s USING (paper_id, section) WHERE kind = 'proof' AND k = 1 AND n <= 2000",
    "linkage_outcomes": f"WITH {_C}, l AS (SELECT DISTINCT paper_id, theorem_label FROM c WHERE kind <> 'proof' AND theorem_label IS NOT NULL), s AS (SELECT paper_id, section, count(*) AS k FROM c WHERE theorem_label IS NULL AND kind IN {_ST} GROUP BY 1, 2) SELECT chunk_id, CASE WHEN c.theorem_label IS NOT NULL THEN CASE WHEN l.paper_id IS NOT NULL THEN 'resolved' ELSE 'not-in-corpus' END WHEN section = '[]' THEN 'unsupported-by-provider' WHEN k = 1 THEN 'resolved' WHEN k > 1 THEN 'ambiguous' ELSE 'not-in-corpus' END AS outcome, CASE WHEN c.theorem_label IS NOT NULL THEN 'theorem_label' ELSE 'section_scope' END AS basis FROM c LEFT JOIN l USING (paper_id, theorem_label) LEFT JOIN s USING (paper_id, section) WHERE kind = 'proof'",
    "paper_summary": "SELECT paper_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT section_path[1]) AS sections, min(chunker_version) AS chunker, min(embedder_version) AS embedder FROM chunks GROUP BY 1",
    "metadata_enrich": r"WITH m AS (SELECT * FROM (SELECT regexp_replace(paper_id, 'v\d+$', '') AS p, title, year, row_number() OVER (PARTITION BY regexp_replace(paper_id, 'v\d+$', '') ORDER BY fetched_at DESC, title) AS n FROM paper_metadata) WHERE n = 1) SELECT c.paper_id, title, CASE WHEN year > 0 THEN year END::BIGINT AS year FROM (SELECT DISTINCT paper_id FROM chunks) c LEFT JOIN m ON regexp_replace(c.paper_id, 'v\d+$', '') = m.p",
    "representative_row": "SELECT paper_id, arg_min(chunk_id, list_position(['stmt', 'lemma', 'proposition', 'corollary', 'definition', 'remark'], kind)::VARCHAR || chunk_id) AS chunk_id FROM chunks WHERE kind IN ('stmt', 'lemma', 'proposition', 'corollary', 'definition', 'remark') GROUP BY 1",
    "ref_resolution": f"WITH {_K}, f AS (SELECT work, min(paper) AS dst FROM known GROUP BY 1) SELECT DISTINCT c.src, f.dst FROM cites c JOIN known k ON c.dst = k.paper JOIN f USING (work)",
    "collision_report": f"WITH {_K} SELECT work, count(DISTINCT paper) AS papers FROM known GROUP BY 1 HAVING count(DISTINCT paper) > 1",
    "intra_paper_edges": r"SELECT DISTINCT paper_id AS src, paper_id AS dst, 'intra-paper' AS source, 1.0::DOUBLE AS confidence FROM chunks WHERE regexp_full_match(theorem_label, 'S\d+\.Thm\d+')",
    "edge_merge": "WITH e AS (SELECT DISTINCT src, dst, source, confidence::DOUBLE AS confidence FROM cites), b AS (SELECT *, 0 AS age FROM e WHERE source <> 'openAlex' UNION ALL SELECT *, 1 FROM e WHERE source = 'openAlex' AND src IN (SELECT paper_id FROM paper_metadata) AND dst IN (SELECT paper_id FROM paper_metadata)) SELECT src, dst, source, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, source ORDER BY age, confidence DESC NULLS LAST) AS n FROM b) WHERE n = 1",
    "cites_depth1": _walk_sql("cites", 1), "cites_depth2": _walk_sql("cites", 2), "cited_by_depth2": _walk_sql("cited_by", 2), "depends_on_depth2": _walk_sql("depends_on", 2),
}
