"""Shared by the tests of this folder."""

from pyspark.sql import functions as F


def crowded(df):
    """Columns whose names the operators use inside."""
    for c in ("raw", "folded", "form", "band", "hi", "lo", "blob", "size", "no", "at", "body", "slice", "words", "links", "code", "label", "score", "r", "v", "word", "known", "kind", "id"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
