"""Equations: formulas of chunk bodies as trees, search with edit distance, formula comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import mathml, text, vectors
from quillon.operators import assign, equations
from quillon.plans._read import table

# A flat MathML of a formula's atoms: commands and letters are identifiers, digits numbers, the rest operators.
SPACES = "[\u00a0\u2000-\u200a\u202f\u205f\u3000]"
FORMULA = r"\$([^$]+)\$"
ATOM = r"\\[A-Za-z]+|[0-9]+|[A-Za-z]|[^\s{}]"


def _mathml(formula):
    def one(t):
        name = F.when(t.rlike(r"^\\?[A-Za-z]"), "mi").when(t.rlike("^[0-9]"), "mn").otherwise("mo")
        safe = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\\"), F.lit(""))
        return F.concat(F.lit("<"), name, F.lit(">"), safe, F.lit("</"), name, F.lit(">"))

    return F.concat(F.lit("<math><mrow>"), F.array_join(F.transform(F.regexp_extract_all(formula, F.lit(ATOM), F.lit(0)), one), ""), F.lit("</mrow></math>"))


def _formulas(spark, sf):
    c = table(spark, sf, "chunks").where("embedding_stmt IS NOT NULL").select("chunk_id", "embedding_stmt", F.regexp_extract("body_text", r"\$([^$]+)\$", 1).alias("f")).where("f <> ''")
    c = c.groupBy("chunk_id").agg(F.regexp_replace(F.max("f"), SPACES, " ").alias("f"), F.first("embedding_stmt").alias("v"))
    return c.select(F.col("chunk_id").alias("id"), "f", "v", _mathml(F.col("f")).alias("mathml"))


def equation_trees(spark, sf):
    """The first formula of each statement as a canonical tree, with its size; ``formula_trees`` has all."""
    f = _formulas(spark, sf).select("id", mathml.tree_json("mathml").alias("tree"))
    return f.select("id", F.length("tree").cast("long").alias("length"), mathml.tree_size("tree").cast("long").alias("nodes"))


def _all_formulas(spark, sf):
    """(id, place, f, v): every formula of every body, statements and proofs, with its 1-based place and the body's vector."""
    c = table(spark, sf, "chunks").select("chunk_id", "body_text", F.coalesce("embedding_stmt", "embedding_proof").alias("v")).where("v IS NOT NULL")
    c = c.groupBy("chunk_id").agg(F.max("body_text").alias("body"), F.first("v").alias("v"))
    f = F.regexp_extract_all("body", F.lit(FORMULA), F.lit(1))
    f = c.select(F.col("chunk_id").alias("id"), "v", F.posexplode(f).alias("place", "f"))
    return f.select("id", (F.col("place") + 1).cast("long").alias("place"), F.regexp_replace("f", SPACES, " ").alias("f"), "v")


def formula_trees(spark, sf):
    """Every formula of each chunk as a canonical tree, with its size."""
    f = _all_formulas(spark, sf).select("id", "place", mathml.tree_json(_mathml(F.col("f"))).alias("tree"))
    return f.select("id", "place", F.length("tree").cast("long").alias("length"), mathml.tree_size("tree").cast("long").alias("nodes"))


def find_equation(spark, sf):
    """The twenty formulas nearest to three query formulas by vector and tree: all formulas of the nearest 200 chunks that hold any."""
    q = spark.createDataFrame([(1, "x_{n} \\in \\mathbb{R}"), (2, "\\|h\\|_{p} < \\infty"), (3, "a = 1")], "query long, f string").select("query", mathml.tree_json(_mathml(F.col("f"))).alias("tree"))
    v = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").head()[0]
    f = _all_formulas(spark, sf).withColumn("cosine", F.round(vectors.score(F.col("v"), v), 6))
    near = f.groupBy("id").agg(F.max("cosine").alias("cosine"), F.array_sort(F.collect_list(F.struct("place", "f"))).alias("fs")).orderBy(F.desc("cosine"), "id").limit(equations.CANDIDATES)
    c = near.select("id", "cosine", F.explode("fs").alias("e")).select(F.struct("id", "e.place").alias("id"), "cosine", mathml.tree_json(_mathml(F.col("e.f"))).alias("tree"))
    found = equations.search(c.crossJoin(F.broadcast(q.select("query"))), q, 20, most=None, budget=None)
    return found.select("query", "id.id", "id.place", "cosine", "ted", "score", F.col("rank").cast("long").alias("rank"))


def formula_fidelity(spark, sf):
    """Agreement of each formula of each document with the next one by matched atoms; ``place`` is that of the first of both."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit(FORMULA), F.lit(1)).alias("f")).where("size(f) >= 2")
    pairs = d.select("doc_id", F.posexplode(F.arrays_zip(F.slice("f", 1, F.size("f") - 1).alias("a"), F.slice("f", 2, F.size("f") - 1).alias("b"))).alias("place", "p"))
    return pairs.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), F.round(assign.formula_f1(text.latex_atoms(F.col("p.a")), text.latex_atoms(F.col("p.b"))), 6).alias("f1"))


QUERIES = {f.__name__: f for f in (equation_trees, formula_trees, find_equation, formula_fidelity)}
_RX = r"\\[A-Za-z]+|[0-9]+|[A-Za-z]|[^\s{}]"
ORACLE_SQL = {
    # lengths of the compact JSON: 26 characters a node and its label, one a comma
    "equation_trees": rf"""WITH f AS (SELECT chunk_id AS id, max(nullif(regexp_extract(body_text, '\$([^$]+)\$', 1), '')) AS f FROM chunks WHERE embedding_stmt IS NOT NULL GROUP BY 1),
 a AS (SELECT id, list_transform(regexp_extract_all(regexp_replace(f, '{SPACES}', ' ', 'g'), '{_RX}'), lambda t: replace(t, '\', '')) AS a FROM f WHERE f IS NOT NULL),
 s AS (SELECT id, len(a) AS n, list_sum(list_transform(a, lambda t: length(t))) AS chars, len(list_filter(a, lambda t: t <> '')) AS full_ FROM a)
 SELECT id, (CASE WHEN n = 1 THEN 30 ELSE 60 END + 28 * n + 26 * full_ + chars + n - 1)::BIGINT AS length, (CASE WHEN n = 1 THEN 1 ELSE 2 END + n + full_)::BIGINT AS nodes FROM s""",
    "formula_trees": rf"""WITH c AS (SELECT chunk_id AS id, max(body_text) AS b FROM chunks WHERE coalesce(embedding_stmt, embedding_proof) IS NOT NULL GROUP BY 1),
 f AS (SELECT id, unnest(regexp_extract_all(b, '\$([^$]+)\$', 1)) AS f, generate_subscripts(regexp_extract_all(b, '\$([^$]+)\$', 1), 1) AS place FROM c),
 a AS (SELECT id, place, list_transform(regexp_extract_all(regexp_replace(f, '{SPACES}', ' ', 'g'), '{_RX}'), lambda t: replace(t, '\', '')) AS a FROM f),
 s AS (SELECT id, place, len(a) AS n, coalesce(list_sum(list_transform(a, lambda t: length(t))), 0) AS chars, len(list_filter(a, lambda t: t <> '')) AS full_ FROM a)
 SELECT id, place, (CASE WHEN n = 1 THEN 30 ELSE 60 END + 28 * n + 26 * full_ + chars + n - 1)::BIGINT AS length, (CASE WHEN n = 1 THEN 1 ELSE 2 END + n + full_)::BIGINT AS nodes FROM s""",
}
