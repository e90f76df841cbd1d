"""Dense, lexical and hybrid search over chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text, vectors
from quillon.operators import hooks
from quillon.operators.bm25 import Bm25
from quillon.operators.ranking import best_per, reciprocal_rank_fusion, top, top_per
from quillon.plans._read import table

OVERFETCH = 5


def query_vector(spark: SparkSession, sf: str):
    return table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").head()[0]


def scored(spark: SparkSession, sf: str, column: str = "embedding_stmt", where: str = "true") -> DataFrame:
    """Distinct chunks with their similarity to the fixed query; rows without a vector in the column can't match."""
    rows = table(spark, sf, "chunks").where(f"{column} IS NOT NULL").where(where)
    rows = rows.select(F.col("chunk_id").alias("id"), "paper_id", F.coalesce(F.try_element_at("section_path", F.lit(1)), F.lit("")).alias("section"), F.round(vectors.score(F.col(column), query_vector(spark, sf)), 6).alias("score"))
    return rows.groupBy("id").agg(F.max("paper_id").alias("paper_id"), F.max("section").alias("section"), F.max("score").alias("score"))


def dense_search_theorem(spark, sf):
    return top(scored(spark, sf), 10).select("id", "paper_id", "score")


def dense_search_group(spark, sf, k: int = 10):
    return top(best_per(top(scored(spark, sf), OVERFETCH * k), ["paper_id"]), k).select("id", "paper_id", "score")


def dense_search_section(spark, sf, k: int = 10):
    return top(best_per(top(scored(spark, sf), OVERFETCH * k), ["paper_id", "section"]), k).select("id", "paper_id", "section", "score")


def dense_search_filtered(spark, sf):
    """Proof route, one source, papers of a few years: filters come before the search and reach the scan."""
    where = "source_kind = 'arxiv' AND paper_id >= '15' AND paper_id < '20'"
    return top(scored(spark, sf, "embedding_proof", where), 20).select("id", "paper_id", "score")


def dual_column_knn_rrf(spark, sf):
    lists = [top_per(top(scored(spark, sf, c), 50).withColumn("g", F.lit(1)), ["g"], 50) for c in ("embedding_stmt", "embedding_proof")]
    return top(reciprocal_rank_fusion(lists).withColumn("score", F.round("score", 9)), 50).select("id", "score")


def batch_knn(spark, sf, k: int = 10):
    """The ten nearest vectors of every vector whose id is divisible by 100, among all."""
    all_ = table(spark, sf, "embeddings")
    queries = [(r[0], r[1]) for r in all_.where("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator()]
    out = []
    for at in range(0, len(queries), 1000):
        near = vectors.batch_scores(all_, "vec_id", "embedding", queries[at : at + 1000], 2 * k)
        out.append(top_per(near.withColumn("score", F.round("score", 6)), ["query"], k, key="key"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.select("query", F.col("key").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def semantic_cache_lookup(spark, sf):
    """Cached entries of the same scope (label) whose vectors are at least 0.25 similar to a query's, the best of each query."""
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), "label")
    pairs = e.join(queries, "label").where("vec_id <> query").withColumn("score", F.round(vectors.dot(F.col("embedding"), F.col("q")), 6)).where("score >= 0.25")
    return top_per(pairs, ["query"], 1, key="vec_id").select("query", "vec_id", "score")


def document_tokens(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), text.words(F.col("text")).alias("tokens"))


def item_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), text.words(F.col("text")).alias("tokens"))


def bm25_index_stats(spark, sf):
    return Bm25(document_tokens(spark, sf)).terms.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


def bm25_batch(spark, sf, k: int = 10):
    """The ten best documents of every test item."""
    found = Bm25(document_tokens(spark, sf)).search(item_queries(spark, sf), k)
    return found.select("query", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_ids(spark, sf):
    """Lexical search over the stored tokens of arXiv chunks, the query being the first test item; N and idf over all chunks."""
    chunks = table(spark, sf, "chunks").groupBy(F.col("chunk_id").alias("id")).agg(F.max("body_tokens").alias("t"))
    docs = chunks.select("id", F.filter(F.split("t", " "), lambda x: x != "").alias("tokens"))
    q = table(spark, sf, "eval_items").where("item_id = 7000").select(F.lit(0).alias("query"), text.words(F.col("text")).alias("tokens"))
    found = Bm25(docs).search(q, 1_000_000).where("id LIKE 'arxiv:%'")
    return top(found, 20).select("id", F.round("score", 6).alias("score"))


def hybrid_rrf(spark, sf, k: int = 10):
    """The lexical list of every test item fused with the same documents by length, as its SQL says; no vector is read.

    ``hybrid_search`` is the search that fuses lexical and dense lists.
    """
    lexical = Bm25(document_tokens(spark, sf)).search(item_queries(spark, sf), 50)
    length = document_tokens(spark, sf).select("id", F.size("tokens").alias("n")).where("n > 0")
    second = lexical.join(length, "id").withColumn("short", -F.col("n").cast("double"))
    second = top_per(second.drop("rank"), ["query"], 50, score="short")
    fused = reciprocal_rank_fusion([lexical, second], ["query"]).withColumn("score", F.round("score", 9))
    return top_per(fused, ["query"], k).select("query", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def item_vectors(spark, sf) -> list[tuple]:
    """(item_id, vector) of the test items, a fixed set, by the default encoder."""
    return [(r[0], r[1]) for r in hooks.embed(table(spark, sf, "eval_items").select("item_id", "text"), "text").select("item_id", "embedding").collect()]


def hybrid_lists(spark, sf, depth: int = 200) -> list[DataFrame]:
    """The lexical and the dense list (query, id, score, rank) of every test item, each over all documents.

    Documents and items are embedded by the same encoder: the stored vectors are of another one and belong to no document.
    A document has one text, so there is one dense list, not one for statements and one for proofs.
    """
    lexical = Bm25(document_tokens(spark, sf)).search(item_queries(spark, sf), depth)
    docs = hooks.embed(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "text")
    near = vectors.batch_scores(docs, "id", "embedding", item_vectors(spark, sf), depth, digits=6)
    dense = top_per(near.withColumnRenamed("key", "id"), ["query"], depth)
    return [lexical, dense]


def hybrid_search(spark, sf, fuse: int = 50, k: int = 10):
    """For every test item 200 documents by BM25 and 200 by vector, fused to 50, of which reranking by word overlap leaves ten."""
    fused = reciprocal_rank_fusion(hybrid_lists(spark, sf), ["query"]).withColumn("score", F.round("score", 9))
    fused = top_per(fused, ["query"], fuse).select("query", "id")
    items = table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), F.col("text").alias("q"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    judged = hooks.rerank(docs.join(fused, "id").join(F.broadcast(items), "query"), "q", "body", lambda: hooks.overlap_reranker)
    found = top_per(judged.withColumn("score", F.round("score", 6)), ["query"], k)
    return found.select("query", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def rerank_passthrough(spark, sf):
    """Rerank off: the fused list cut, its scores kept, ids that are no live chunk dropped."""
    fused = dual_column_knn_rrf(spark, sf)
    live = table(spark, sf, "chunks").select(F.col("chunk_id").alias("id")).distinct()
    return top(fused.join(live, "id", "left_semi"), 10)


def search_result_rows(spark, sf):
    """Search results with title and year of their paper (null where unknown, version stripped), label and snippet."""
    hits = top(scored(spark, sf), 10)
    chunks = table(spark, sf, "chunks")
    rows = chunks.groupBy(F.col("chunk_id").alias("id")).agg(F.max("theorem_name").alias("name"), F.max("theorem_label").alias("mark"), F.max(F.coalesce("source_kind", F.lit("arxiv"))).alias("source_kind"), F.max("body_text").alias("body"))
    meta = table(spark, sf, "paper_metadata").groupBy(text.strip_version(F.col("paper_id")).alias("p")).agg(F.max("title").alias("title"), F.max(F.when(F.col("year") > 0, F.col("year"))).cast("long").alias("year"))
    out = hits.join(rows, "id").join(meta, text.strip_version(F.col("paper_id")) == F.col("p"), "left")
    return out.select("id", "score", "title", "year", text.label(F.col("name"), F.col("mark")).alias("label"), "source_kind", text.wrapped(F.substring("body", 1, 150), "chunk").alias("snippet"))


def target_rank(spark, sf):
    """The best rank of each paper in the first 200 results."""
    ranked = top_per(top(scored(spark, sf), 200).withColumn("g", F.lit(1)), ["g"], 200)
    return ranked.groupBy("paper_id").agg(F.min("rank").cast("long").alias("rank"))


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SCORED = """SELECT chunk_id AS id, max(paper_id) AS paper_id, max(coalesce(section_path[1], '')) AS section,
 max(round(greatest(0.0, list_dot_product({c}::DOUBLE[], {q})), 6)) AS score FROM chunks WHERE {c} IS NOT NULL AND {w} GROUP BY 1"""


def _s(column="embedding_stmt", where="true"):
    return SCORED.format(c=column, q=Q, w=where)


_RANKED = "SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM ({}) ORDER BY score DESC, id LIMIT 50)"
_RRF = f"""SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({_RANKED.format(_s())} UNION ALL {_RANKED.format(_s("embedding_proof"))}) GROUP BY id ORDER BY score DESC, id"""
_WORDS = r"regexp_extract_all({}, '\p{{L}}(?:(?:\p{{L}}|-)*\p{{L}})?')"
_INDEX = f"""docs AS (SELECT doc_id AS id, {_WORDS.format("text")} AS tokens FROM documents WHERE text IS NOT NULL),
sized AS (SELECT id, tokens, len(tokens) AS n FROM docs WHERE len(tokens) > 0), totals AS (SELECT count(*) AS cnt, avg(n) AS avgdl FROM sized),
post AS (SELECT term, id, count(*) AS tf, max(n) AS n FROM (SELECT id, n, unnest(tokens) AS term FROM sized) GROUP BY 1, 2),
raw AS (SELECT term, count(*) AS df, ln(max(cnt) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, totals GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BATCH = f"""{_INDEX}, asked AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({_WORDS.format("text")}) AS term FROM eval_items) GROUP BY 1, 2),
hits AS (SELECT query, id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))), 9) AS score FROM post JOIN terms USING (term) JOIN asked USING (term), totals GROUP BY 1, 2 HAVING sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))) > 0)"""

QUERIES = {f.__name__: f for f in (dense_search_theorem, dense_search_group, dense_search_section, dense_search_filtered, dual_column_knn_rrf, batch_knn, semantic_cache_lookup, bm25_index_stats, bm25_batch, bm25_ids, hybrid_rrf, hybrid_search, rerank_passthrough, search_result_rows, target_rank)}
ORACLE_SQL = {
    "dense_search_theorem": f"SELECT id, paper_id, score FROM ({_s()}) ORDER BY score DESC, id LIMIT 10",
    "dense_search_group": f"WITH t AS (SELECT * FROM ({_s()}) ORDER BY score DESC, id LIMIT 50) SELECT id, paper_id, score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, id) AS n FROM t) WHERE n = 1 ORDER BY score DESC, id LIMIT 10",
    "dense_search_section": f"WITH t AS (SELECT * FROM ({_s()}) ORDER BY score DESC, id LIMIT 50) SELECT id, paper_id, section, score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, section ORDER BY score DESC, id) AS n FROM t) WHERE n = 1 ORDER BY score DESC, id LIMIT 10",
    "dense_search_filtered": f"""SELECT id, paper_id, score FROM ({_s("embedding_proof", "source_kind = 'arxiv' AND paper_id >= '15' AND paper_id < '20'")}) ORDER BY score DESC, id LIMIT 20""",
    "dual_column_knn_rrf": f"SELECT * FROM ({_RRF}) LIMIT 50",
    "batch_knn": "SELECT * FROM (SELECT q.vec_id AS query, e.vec_id, round(greatest(0.0, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0.0, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 10",
    "semantic_cache_lookup": "SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) WHERE score >= 0.25) WHERE n = 1",
    "bm25_index_stats": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_batch": f"WITH {_BATCH} SELECT query, id AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 10",
    "hybrid_rrf": f"""WITH {_BATCH}, a AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 50),
 b AS (SELECT query, a.id, row_number() OVER (PARTITION BY query ORDER BY n, a.id) AS rank FROM a JOIN sized ON a.id = sized.id),
 f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
 SELECT query, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "bm25_ids": f"""WITH docs AS (SELECT chunk_id AS id, list_filter(string_split(max(body_tokens), ' '), lambda x: x <> '') AS tokens FROM chunks GROUP BY 1),
 sized AS (SELECT id, tokens, len(tokens) AS n FROM docs WHERE len(tokens) > 0), totals AS (SELECT count(*) AS cnt, avg(n) AS avgdl FROM sized),
 post AS (SELECT term, id, count(*) AS tf, max(n) AS n FROM (SELECT id, n, unnest(tokens) AS term FROM sized) GROUP BY 1, 2),
 raw AS (SELECT term, count(*) AS df, ln(max(cnt) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, totals GROUP BY term),
 terms AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
 asked AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_WORDS.format("text")}) AS term FROM eval_items WHERE item_id = 7000) GROUP BY 1)
 SELECT id, round(round(score, 9), 6) AS score FROM (SELECT id, sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))) AS score FROM post JOIN terms USING (term) JOIN asked USING (term), totals GROUP BY 1) WHERE score > 0 AND id LIKE 'arxiv:%' ORDER BY round(score, 9) DESC, id LIMIT 20""",
    "rerank_passthrough": f"SELECT * FROM (SELECT * FROM ({_RRF}) LIMIT 50) WHERE id IN (SELECT chunk_id FROM chunks) ORDER BY score DESC, id LIMIT 10",
    "search_result_rows": rf"""WITH h AS (SELECT * FROM ({_s()}) ORDER BY score DESC, id LIMIT 10),
 r AS (SELECT chunk_id AS id, max(theorem_name) AS name, max(theorem_label) AS mark, max(coalesce(source_kind, 'arxiv')) AS source_kind, max(body_text) AS body FROM chunks GROUP BY 1),
 m AS (SELECT regexp_replace(paper_id, 'v\d+$', '') AS p, max(title) AS title, max(CASE WHEN year > 0 THEN year END)::BIGINT AS year FROM paper_metadata GROUP BY 1)
 SELECT h.id, score, title, year, nullif(concat_ws(' ', nullif(name, ''), nullif(mark, '')), '') AS label, source_kind, CASE WHEN length(body) > 0 THEN '<chunk>' || replace(replace(substring(body, 1, 150), '</chunk>', '&lt;/chunk&gt;'), '<chunk>', '&lt;chunk&gt;') || '</chunk>' ELSE '' END AS snippet
 FROM h JOIN r USING (id) LEFT JOIN m ON regexp_replace(h.paper_id, 'v\d+$', '') = m.p""",
    "target_rank": f"SELECT paper_id, min(rank) AS rank FROM (SELECT paper_id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM ({_s()}) ORDER BY score DESC, id LIMIT 200)) GROUP BY 1",
}
