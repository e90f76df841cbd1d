"""Statements and their proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MOST_REFERENCES, MOST_SCANNED = 8, 2000


def by_label(chunks: DataFrame) -> DataFrame:
    """(chunk_id, referenced_id): the opposite kind under the same label of a paper, the eight least ids of each."""
    c = chunks.where("theorem_label IS NOT NULL").select("chunk_id", "paper_id", "theorem_label", (F.col("kind") == "proof").alias("proof"))
    o = c.toDF("referenced_id", "paper_id", "theorem_label", "_proof")
    found = c.join(o, ["paper_id", "theorem_label"]).where("proof <> _proof AND chunk_id <> referenced_id")
    w = W.partitionBy("chunk_id").orderBy("referenced_id")
    return found.withColumn("n", F.row_number().over(w)).where(f"n <= {MOST_REFERENCES}").select("chunk_id", "referenced_id")


def by_section(chunks: DataFrame) -> DataFrame:
    """(chunk_id, referenced_id): an unlabelled proof and the only unlabelled statement of its section.

    A section of more than 2000 unlabelled rows counts as ambiguous.
    """
    c = chunks.where("theorem_label IS NULL").select("chunk_id", "paper_id", F.to_json("section_path").alias("section"), "kind")
    stmt = F.col("kind").isin("stmt", "theorem", "lemma", "proposition", "corollary", "definition", "remark")
    scope = c.groupBy("paper_id", "section").agg(F.count(F.lit(1)).alias("rows"), F.count_if(stmt).alias("stmts"), F.min(F.when(stmt, F.col("chunk_id"))).alias("referenced_id"))
    single = scope.where(f"stmts = 1 AND rows <= {MOST_SCANNED}").select("paper_id", "section", "referenced_id")
    return c.where("kind = 'proof'").join(single, ["paper_id", "section"]).select("chunk_id", "referenced_id")


def outcomes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, outcome, basis) of every proof: resolved, not-in-corpus, ambiguous, or unsupported-by-provider."""
    proofs = chunks.where("kind = 'proof'").select("chunk_id", "paper_id", "theorem_label", F.to_json("section_path").alias("section"))
    labelled = by_label(chunks).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("hits"))
    c = chunks.where("theorem_label IS NULL AND kind IN ('stmt', 'theorem', 'lemma', 'proposition', 'corollary', 'definition', 'remark')")
    scope = c.groupBy("paper_id", F.to_json("section_path").alias("section")).agg(F.count(F.lit(1)).alias("stmts"))
    all_ = proofs.join(labelled, "chunk_id", "left").join(scope, ["paper_id", "section"], "left")
    label = F.col("theorem_label").isNotNull()
    outcome = (
        F.when(label & (F.col("hits") > 0), "resolved").when(label, "not-in-corpus").when(F.col("section") == "[]", "unsupported-by-provider")
        .when(F.col("stmts") == 1, "resolved").when(F.col("stmts") > 1, "ambiguous").otherwise("not-in-corpus")
    )
    return all_.select("chunk_id", outcome.alias("outcome"), F.when(label, "theorem_label").otherwise("section_scope").alias("basis"))
