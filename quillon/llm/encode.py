"""Problem 7: token ids of every document by a public byte-level BPE vocabulary.

Pre-tokens are exploded with their positions, each distinct word is encoded once, ids are joined back and the
documents are put together by position. Repeats are folded before anything is shuffled: a slice of documents lists its
distinct words once, and positions point into that list, so a word that is a third of all pre-tokens moves once a slice.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import charfold
from quillon.session import materialize

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the pre-token pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def ranks(folder: str, name: str) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(folder: str, name: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(folder, name), special_tokens={})


@functools.cache
def splitter():
    import regex

    return regex.compile(PATTERN).findall


def _split(batches):
    """One row a slice: its keys, how many pre-tokens each has, their places in the list of distinct words, that list."""
    split, no = splitter(), TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in charfold.slices(batch, 1):
            known: dict[str, int] = {}
            sizes, places = [], []
            for text in part.column(1).to_pylist():
                tokens = split(text) if text else ()
                sizes.append(len(tokens))
                places += [known.setdefault(t, len(known)) for t in tokens]
            one = lambda v, t: pa.array([v], pa.list_(t))
            yield pa.RecordBatch.from_arrays([pa.array([no]), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), one(sizes, pa.int32()), one(places, pa.int32()), one(list(known), pa.string())], names=["slice", "keys", "sizes", "places", "words"])
            no += 1


def encode_words(words: DataFrame, folder: str, name: str) -> DataFrame:
    """(word, ids) of each distinct word."""

    def run(batches):
        piece = encoder(folder, name)._encode_single_piece
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([piece(w.encode()) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _assemble(batches):
    for batch in batches:
        for r in batch.to_pylist():
            order = sorted(r["found"], key=lambda x: x["place"]) if r["found"] else []
            size = np.array([len(x["ids"]) for x in order], np.int64)
            flat = np.concatenate([np.array(x["ids"], np.int32) for x in order]) if order else np.zeros(0, np.int32)
            start, places = np.cumsum(size) - size, np.array(r["places"], np.int64)
            n = size[places] if places.size else places
            ends = np.cumsum(n)
            ids = flat[np.repeat(start[places] - (ends - n), n) + np.arange(n.sum())] if places.size else flat
            bounds = np.concatenate(([0], np.cumsum(np.array(r["sizes"], np.int64))))
            offs = np.concatenate(([0], ends))[bounds]
            keys = pa.array(r["keys"], pa.int64())
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + 500_000, "right")) - 1)
                part = offs[at : to + 1]
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), pa.array(ids[part[0] : part[-1]]))], names=["doc_id", "ids"])
                at = to


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens.

    Null and empty texts have an empty list, blank text is encoded as it is; a null key and repeated rows stay. Other
    columns are ignored.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sliced = materialize(rows.mapInArrow(_split, "slice long, keys array<long>, sizes array<int>, places array<int>, words array<string>"))
    words = sliced.select("slice", F.posexplode("words").alias("place", "word"))
    ids = encode_words(words.select("word").distinct(), folder, name)
    found = words.join(ids, "word").groupBy("slice").agg(F.collect_list(F.struct("place", "ids")).alias("found"))
    return sliced.drop("words").join(found, "slice", "left").select("keys", "sizes", "places", "found").mapInArrow(_assemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id, bytes): the vocabulary, a table of fixed size."""
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks(folder, name).values()), pa.int32()), "bytes": pa.array([x.hex() for x in ranks(folder, name)], pa.string())}).to_pandas())


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the token-byte table joined to the exploded ids. An empty or null list gives the empty text.

    Keys must be unique; bytes that are no UTF-8 (of ids that don't come from a text) become replacement characters.
    """
    rows = encoded.select(F.col(key).alias("doc_id"), F.posexplode_outer(ids).alias("place", "id"))
    # 50,256 rows by definition of the vocabulary: small whatever the corpus
    joined = rows.join(F.broadcast(token_bytes(encoded.sparkSession, folder, name)), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "bytes"))))
    return joined.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x.bytes), "")), "utf-8").alias("text"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf}/documents.parquet"))


def p7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return decode(materialize(p7_ids(spark, sf)))


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}
ORACLE_SQL = {"p7_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
