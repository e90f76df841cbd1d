"""Documents to chunk rows over tables; a document that can't be read gives a row with its error instead of ending the job."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import markup

CHUNKERS = {"html": markup.html_chunks, "tex": markup.tex_chunks, "markdown": markup.markdown_chunks, "pages": markup.page_chunks}
_CHUNK = "key string, place int, kind string, label string, name string, number string, section_path array<string>, body string, page int, start int, end int, error string"
_ARROW = pa.schema([("key", pa.string()), ("place", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("name", pa.string()), ("number", pa.string()), ("section_path", pa.list_(pa.string())), ("body", pa.string()), ("page", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("error", pa.string())])


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")


def chunks(df: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """Chunk rows of each document in ``form`` (html, tex, markdown or pages), in order, with a content address.

    Null texts give none. ``error`` is set, and all else null, where a document fails.
    """
    split = CHUNKERS[form]

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [{"key": k, "place": i, **c} for i, c in enumerate(split(t))]
                except (ValueError, RecursionError) as e:
                    rows.append({"key": k, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    out = _source(df, key, text).mapInArrow(run, _CHUNK)
    where = F.concat_ws("\0", F.col("section_path"), F.coalesce(F.col("start").cast("string"), F.lit("")))
    return out.withColumn("address", F.when(F.col("error").isNull(), F.substring(F.sha2(F.concat(where, "body"), 256), 1, 16)))


def _lists(df: DataFrame, key: str, text: str, find, schema: str, fields: list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            keys, cols = [], [[] for _ in fields]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in find(t):
                    keys.append(k)
                    for c, f in zip(cols, fields):
                        c.append(r[f] if isinstance(r, dict) else r)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c, pa.string()) for c in cols)], names=["key", *fields])

    return _source(df, key, text).mapInArrow(run, schema)


def equations(df: DataFrame, key: str, html: str) -> DataFrame:
    return _lists(df, key, html, markup.equation_atoms, "key string, equation string, label string, latex string, mathml string, context string", ["equation", "label", "latex", "mathml", "context"])


def definitions(df: DataFrame, key: str, tex: str) -> DataFrame:
    """(key, symbol, expansion, definition): macros of each preamble with their content address."""
    out = _lists(df, key, tex, markup.macros, "key string, symbol string, expansion string", ["symbol", "expansion"])
    return out.withColumn("definition", F.substring(F.sha2(F.concat_ws(":", "key", "symbol", "expansion"), 256), 1, 16))


def references(df: DataFrame, key: str, html: str) -> DataFrame:
    return _lists(df, key, html, markup.local_references, "key string, label string", ["label"])


def theorem_names(rows: DataFrame) -> DataFrame:
    """(dedup_key, display_name, paper_id, chunk_id): rows of a name index from chunks with a name that isn't blank."""
    named = rows.where("theorem_name IS NOT NULL AND trim(theorem_name) <> ''")
    return named.select(F.substring(F.sha2(F.concat_ws("\0", "paper_id", "theorem_name", F.to_json("section_path")), 256), 1, 16).alias("dedup_key"), F.trim("theorem_name").alias("display_name"), "paper_id", "chunk_id").distinct()
