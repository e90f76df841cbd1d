"""BM25 Okapi over a table of tokenised texts, for any number of queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranking import top_per
from quillon.session import broadcast_if_small

K1, B, EPS = 1.5, 0.75, 0.25
#: Cells of the matrix of query terms and queries up to which a query set goes to the documents; a larger one is joined.
MOST_CELLS = 4_000_000
#: Cells of the matrices of one step of a worker.
STEP_CELLS = 2_000_000


class Bm25:
    """Statistics of (id, tokens). Rows without tokens count nowhere.

    ``postings``: (term, id, tf, len); ``terms``: (term, df, idf). A negative idf becomes EPS times the average idf of all
    terms, those negative ones included.
    """

    def __init__(self, docs: DataFrame):
        self.sized = docs.select("id", "tokens", F.size("tokens").alias("len")).where("len > 0")
        self.totals = self.sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
        self.postings = self.sized.select("id", "len", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
        df = self.sized.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # one row of totals: broadcast whatever the corpus
        raw = df.crossJoin(F.broadcast(self.totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw").alias("mean"))
        self.terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", "avgdl", F.when(F.col("raw") < 0, EPS * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, id, score, rank): ``queries`` are (query, tokens); a repeated token counts again; scores of 0 drop out.

        A stated query set of usual size goes to the documents: each is read once, scored for all queries by a matrix
        product, and only what may be among the best leaves the worker. A larger set meets the postings in joins.
        """
        asked = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
        n, m = asked.agg(F.countDistinct("query"), F.countDistinct("term")).head()
        found = self._scan(asked, k) if n * m <= MOST_CELLS else self._join(asked)
        return top_per(found.withColumn("score", F.round("score", 9)), ["query"], k)

    def _join(self, asked: DataFrame) -> DataFrame:
        # a posting's weight doesn't depend on the query: it is worked out once, for the terms that are asked for
        wanted = broadcast_if_small(asked.select("term").distinct())
        part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        weighted = self.postings.join(wanted, "term").join(self.terms, "term").select("term", "id", part.alias("weight"))
        return weighted.join(asked, "term").groupBy("query", "id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score")).where("score > 0")

    def _scan(self, asked: DataFrame, k: int) -> DataFrame:
        spark, kind = asked.sparkSession, dict(self.sized.dtypes)["id"]
        rows = asked.join(self.terms, "term").select(F.col("query").cast("long"), "term", "qtf", "idf", "avgdl").collect()
        if not rows:
            return self._join(asked)
        terms, ids = sorted({r["term"] for r in rows}), sorted({r["query"] for r in rows})
        at, col = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
        weights, idf = np.zeros((len(terms), len(ids))), np.zeros(len(terms))
        for r in rows:
            weights[at[r["term"]], col[r["query"]]] = r["qtf"]
            idf[at[r["term"]]] = r["idf"]
        sent = spark.sparkContext.broadcast((pa.array(terms), np.array(ids, np.int64), weights, idf, rows[0]["avgdl"]))
        step = max(1, STEP_CELLS // max(len(terms), len(ids)))

        def run(batches):
            names, queries, w, idf_, avgdl = sent.value
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    b = whole.slice(lo, step)
                    lists = b.column(1)
                    term = pc.index_in(lists.flatten(), value_set=names)
                    hit = term.is_valid().to_numpy(zero_copy_only=False)
                    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
                    cell = doc * len(names) + term.filter(pa.array(hit)).to_numpy(zero_copy_only=False)
                    tf = np.bincount(cell, minlength=b.num_rows * len(names)).reshape(b.num_rows, len(names)).astype(np.float64)
                    size = b.column(2).to_numpy(zero_copy_only=False)[:, None]
                    score = np.round((idf_ * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size / avgdl))) @ w, 9)
                    least = np.partition(score, -k, axis=0)[-k] if k < len(score) else np.zeros(score.shape[1])
                    d, q = np.nonzero((score > 0) & (score >= least))
                    yield pa.RecordBatch.from_arrays([pa.array(queries[q]), b.column(0).take(pa.array(d)), pa.array(score[d, q])], names=["query", "id", "score"])

        return self.sized.select("id", "tokens", "len").mapInArrow(run, f"query long, id {kind}, score double")
