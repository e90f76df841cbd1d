"""Bounded traversal of the citation graph, and how its edges come about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

INTRA = "intra-paper"


def _hop(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("_from"), F.col("dst").alias("paper"), "source", "confidence")


def neighbours(edges: DataFrame, start: DataFrame, direction: str = "cites", depth: int = 2) -> DataFrame:
    """(start, paper, hop, source, confidence, edge_kind): each paper at its least hop.

    ``direction``: ``cites`` goes along the edges, ``cited_by`` against them, both without intra-paper edges on the way;
    ``depends_on`` takes all. ``start``: one column of papers; these are no neighbours of themselves except in
    ``depends_on``. Among the edges of one hop the order is (source, confidence descending). Repeated edges count once, null ends drop out.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    if direction != "depends_on":
        e = e.where(F.col("source") != INTRA)
    if direction == "cited_by":
        e = e.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    step = _hop(e)
    now = start.toDF("start").distinct().withColumn("_at", F.col("start"))
    found = None
    for hop in range(1, depth + 1):
        walk = now.join(step, now["_at"] == step["_from"]).select("start", "paper", F.lit(hop).alias("hop"), "source", "confidence")
        # only one row a paper goes on: later hops see distinct papers, not distinct paths
        w = W.partitionBy("start", "paper").orderBy("source", F.desc_nulls_last("confidence"))
        walk = walk.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        found = walk if found is None else found.unionByName(walk)
        now = walk.select("start", F.col("paper").alias("_at"))
    if direction != "depends_on":
        found = found.where("paper <> start")
    w = W.partitionBy("start", "paper").orderBy("hop", "source", F.desc_nulls_last("confidence"))
    best = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kind = F.lit("cited_by") if direction == "cited_by" else F.when(F.col("source") == INTRA, "ref").otherwise("cites")
    return best.withColumn("edge_kind", kind)


# Kinds of chunk that stand for a paper, best first.
KIND_ORDER = ["stmt", "lemma", "proposition", "corollary", "definition", "remark"]


def representatives(chunks: DataFrame) -> DataFrame:
    """(paper_id, chunk_id): the chunk that stands for each paper, by kind and then id."""
    rank = F.array_position(F.lit(KIND_ORDER), F.col("kind"))
    return chunks.where(F.col("kind").isin(KIND_ORDER)).groupBy("paper_id").agg(F.min_by("chunk_id", F.struct(rank.alias("r"), F.col("chunk_id").alias("c"))).alias("chunk_id"))


def resolve_references(works: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst): referenced work ids resolved to papers; of papers with one work id the first by order wins, the rest drop out.

    ``works``: (paper, references), ``known``: (paper, work).
    """
    first = known.where("work IS NOT NULL").groupBy("work").agg(F.min("paper").alias("dst"))
    return works.select(F.col("paper").alias("src"), F.explode("references").alias("work")).join(first, "work").select("src", "dst").distinct()


def collisions(known: DataFrame) -> DataFrame:
    """(work, papers): work ids that several papers claim."""
    return known.groupBy("work").agg(F.countDistinct("paper").alias("papers")).where("papers > 1")


def intra_edges(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """One self-edge a paper if any of its local references (paper_id, label) names one of its labels."""
    labels = chunks.where("theorem_label IS NOT NULL").select("paper_id", F.col("theorem_label").alias("label")).distinct()
    return references.join(labels, ["paper_id", "label"], "left_semi").select(F.col("paper_id").alias("src"), F.col("paper_id").alias("dst")).distinct().withColumns({"source": F.lit(INTRA), "confidence": F.lit(1.0)})


def merge_edges(old: DataFrame, new: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges keyed (src, dst, source); new ones only if both ends are known papers; of repeats the first by confidence stays."""
    ends = papers.select("paper").distinct()
    ok = new.join(ends.toDF("src"), "src", "left_semi").join(ends.toDF("dst"), "dst", "left_semi")
    both = old.withColumn("_age", F.lit(0)).unionByName(ok.withColumn("_age", F.lit(1)))
    w = W.partitionBy("src", "dst", "source").orderBy("_age", F.desc_nulls_last("confidence"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_age")
