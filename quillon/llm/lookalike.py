"""Problem 2: strings that look the same on the page but are spelled with different characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import charfold
from quillon.operators.pairs import grouped_pairs
from quillon.session import materialize


def _fold_batches(batches):
    for batch in batches:
        for part in charfold.slices(batch, 2):
            folded = charfold.fold_strings(part.column(2)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), folded], names=["key", "raw", "folded"])


def folded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, folded): the md5 of the text as it is, and the text in its one form. Rows of null text or key are left out."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("key", F.unhex(F.md5(F.col("text").cast("binary"))).alias("raw"), "text")
    return rows.mapInArrow(_fold_batches, "key string, raw binary, folded string")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) of different keys whose strings differ but have the same form.

    Repeated rows of a key count once (of several texts under one key the one with the least md5 counts). Null keys and
    texts take no part; an empty text looks like one of width-less characters only. Other columns are ignored.
    """
    seen = folded(df, key, text).select("key", F.struct("raw", F.unhex(F.md5(F.col("folded").cast("binary"))).alias("form")).alias("v"))
    rows = seen.groupBy("key").agg(F.min("v").alias("v")).select("key", "v.raw", "v.form")
    rows = materialize(rows)  # hashes only; without this the texts would be folded once for each use
    several = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    return grouped_pairs(rows.join(several, "form", "left_semi"), "form", "key", F.col("a.raw") != F.col("b.raw"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("chunks", "chunk_id", "body_text"), ("theorem_names", "dedup_key", "normalized_name")]
    found = [lookalike_pairs(spark.read.parquet(f"{sf}/{t}.parquet"), k, c).select(F.lit(t).alias("record_set"), "key_a", "key_b") for t, k, c in parts]
    return found[0].unionByName(found[1])


QUERIES = {"p2_found": p2_found}
