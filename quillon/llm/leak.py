"""Problem 8: wording of held-out test items inside training documents.

Training suffix arrays: each shard of documents gets an array of its suffixes, sorted by their first words; every
suffix of every test item is binary-searched in it. Matches are extended to the longest verbatim run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import charfold
from quillon.llm.words import words

#: Consecutive words that make a leak.
LEAST_WORDS = 13
#: Words of one suffix array (a longer document makes a larger one).
SHARD_WORDS = 1_000_000
#: Test words held by a worker at a time; more test items are searched in blocks.
BLOCK_WORDS = 2_000_000
#: Hits of test suffixes in a shard that are formed at a time.
HITS = 2_000_000


def suffix_array(h: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Places with at least ``depth`` words left in their row, sorted by their next ``depth`` word hashes.

    ``room``: words left in the row at each place. Prefix doubling: ranks of 1, 2, 4 ... words, the last step overlapping.
    """
    rank, have = np.unique(h, return_inverse=True)[1].astype(np.int64) + 1, 1
    while have < depth:
        step = min(have, depth - have)
        later = np.zeros_like(rank)
        later[: h.size - step] = rank[step:]
        later[room <= step] = 0
        rank = np.unique(rank * (h.size + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    order = np.argsort(rank, kind="stable")
    return order[room[order] >= depth]


def search(h: np.ndarray, array: np.ndarray, q: np.ndarray, at: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """For each query place: the left (or right) end of its range in the suffix array, all binary searches in step."""
    lo, hi, k = np.zeros(at.size, np.int64), np.full(at.size, array.size, np.int64), np.arange(depth)
    want = q[at[:, None] + k]
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        have, need = h[array[mid][:, None] + k], want[open_]
        differ = have != need
        first = differ.argmax(1)
        row = np.arange(open_.size)
        same = ~differ[row, first]
        below = np.where(same, right, have[row, first] < need[row, first])
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def _room(offs: np.ndarray) -> np.ndarray:
    return np.repeat(offs[1:], np.diff(offs)) - np.arange(offs[-1])


def matches(h, offs, q, q_offs, depth, array=None):
    """(row, item, words, place in row, place in item) of the longest match of each row and item.

    Only hits that can't be extended to the left grow, and hits are formed HITS at a time: a word repeated a million times
    in a row and hundreds of times in an item takes no more memory than others.
    """
    room, q_room = _room(offs), _room(q_offs)
    at = np.flatnonzero(q_room >= depth)
    at = at[np.isin(q[at], h)]
    if array is None:
        array = suffix_array(h, room, depth)
    lo, hi = (search(h, array, q, at, depth, right) for right in (False, True))
    at, lo, n = (x[hi > lo] for x in (at, lo, hi - lo))
    first, q_first = np.zeros(h.size + 1, bool), np.zeros(q.size + 1, bool)
    first[offs], q_first[q_offs] = True, True
    best = [np.zeros(0, np.int64)] * 5
    done, ends = 0, np.cumsum(n)
    while done < at.size:
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, "right")))
        k = n[done:to]
        hit = np.repeat(at[done:to], k)
        place = array[np.repeat(lo[done:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        done = to
        begins = first[place] | q_first[hit] | (h[place - 1] != q[hit - 1])
        hit, place = hit[begins], place[begins]
        size, grow = np.full(hit.size, depth), np.arange(hit.size)
        while grow.size:  # one more word for those that still match
            s = size[grow]
            ok = (room[place[grow]] > s) & (q_room[hit[grow]] > s)
            grow, s = grow[ok], s[ok]
            grow = grow[h[place[grow] + s] == q[hit[grow] + s]]
            size[grow] += 1
        row = np.searchsorted(offs, place, "right") - 1
        item = np.searchsorted(q_offs, hit, "right") - 1
        found = [np.concatenate(x) for x in zip(best, (row, item, size, place - offs[row], hit - q_offs[item]))]
        order = np.lexsort((found[4], found[3], -found[2], found[1], found[0]))
        found = [x[order] for x in found]
        keep = np.ones(order.size, bool)
        keep[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
        best = [x[keep] for x in found]
    return tuple(best)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): each document and the item whose wording it holds.

    A row for each document and item that share at least ``least`` consecutive words, with the longest shared run and
    its first place in either. Null and short texts match nothing; repeated rows count once; an item of fewer than
    ``least`` words can't leak. Test items go to the workers in blocks of BLOCK_WORDS words; the corpus is read
    once, each shard's array is built once and all blocks are searched in it.
    """
    spark = docs.sparkSession
    blocks, ids, hashes, offs = [], [], [], [0]

    def close():
        if ids:
            blocks.append((list(ids), np.concatenate(hashes), np.array(offs)))
            ids.clear(), hashes.clear()
            offs[:] = [0]

    for r in items.select(F.col(item_id).cast("long"), item_text).where(F.col(item_text).isNotNull()).distinct().toLocalIterator():
        w = words(pa.array([r[1]], pa.large_string())).hashes
        ids.append(r[0]), hashes.append(w), offs.append(offs[-1] + w.size)
        if offs[-1] > BLOCK_WORDS:
            close()
    close()
    schema = "doc_id long, item_id long, match_words int, doc_word int, item_word int"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")

    if not blocks:
        return spark.createDataFrame([], schema)
    sent = [spark.sparkContext.broadcast(b) for b in blocks]

    def scan(batches):
        def shard(keys, hs, sizes):
            h, o = np.concatenate(hs), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            if h.size < least:
                return
            array, keys = suffix_array(h, _room(o), least), pa.concat_arrays(keys)
            for block in sent:
                item_ids, q, q_offs = block.value
                row, item, size, dw, iw = matches(h, o, q, q_offs, least, array)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(np.array(item_ids, np.int64)[item]), *(pa.array(x.astype(np.int32)) for x in (size, dw, iw))], names=["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        keys, hs, sizes, have = [], [], [], 0
        for batch in batches:
            for part in charfold.slices(batch, 1):
                w = words(part.column(1))
                keys.append(part.column(0)), hs.append(w.hashes), sizes.append(np.diff(w.offs))
                have += w.hashes.size
                if have >= SHARD_WORDS:
                    yield from shard(keys, hs, sizes)
                    keys, hs, sizes, have = [], [], [], 0
        if keys:
            yield from shard(keys, hs, sizes)

    found = rows.mapInArrow(scan, schema)
    best = F.max(F.struct("match_words", -F.col("doc_word"), -F.col("item_word"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.match_words", *((-F.col(f"m.{c}")).cast("int").alias(n) for c, n in (("col2", "doc_word"), ("col3", "item_word"))))


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no test item's wording."""
    return docs.join(leaks.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    return without_leaks(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), _leaks(spark, sf))


QUERIES = {"p8_found": p8_found, "p8_matches": p8_matches, "p8_kept": p8_kept}
