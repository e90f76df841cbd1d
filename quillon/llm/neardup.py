"""Problem 1: texts that are nearly the same.

Each distinct set of word shingles gets fingerprints of 192 bits: 64 leading bits mixed of three min-hashes, in which no bit
may differ, then two bits of each of 64 min-hashes, so that the expected Hamming distance of two sets is 64 times one minus
their similarity. There are TRIES binary tries over all sets, each with three other min-hashes in front. Every trie is joined
with itself: from the root, pairs of nodes are walked together, differing bits add up, and a pair is given up when they
exceed the error budget. What comes out is checked exactly on the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import charfold
from quillon.llm.words import Words, distinct, mix, rows, shingles, words
from quillon.operators.components import components
from quillon.operators.pairs import grouped_pairs
from quillon.session import broadcast_if_small, materialize

#: Min-hashes, those in front of one trie, tries. Two sets of similarity s share no trie's leading bits with a probability of
#: about (1 - s^3)^28: 1e-5 at 0.70, 4e-7 at 0.75, 1e-9 at 0.80.
HASHES, LEAD, TRIES = 64, 3, 28
#: Standard deviations above the expected distance that the error budget leaves.
SLACK = 4.5
#: Members below one leading word that one task walks; more are cut into blocks that meet in pairs.
HOT = 8192
#: Node pairs that are walked in step; more are walked a part at a time, which bounds the memory.
AT_ONCE = 1_000_000
#: Bytes of a shingle's hash that the exact check keeps (a false match within a pair of texts: about 1e-8).
KEPT = 5


def error_budget(similarity: float) -> int:
    """Differing bits allowed of two sets of that similarity: mean plus SLACK deviations, two bits of one min-hash together."""
    miss = 1 - similarity
    return int(HASHES * miss + SLACK * np.sqrt(HASHES * (1.5 * miss - miss * miss)))


def leading(trie: int) -> list[int]:
    """The min-hashes in front of a trie: in one round all are used, in the next each with others."""
    per = HASHES // LEAD
    turn, at = divmod(trie, per)
    return [at * LEAD + k for k in range(LEAD)] if not turn else [(at + k * (turn + 6)) % per + k * per for k in range(LEAD)]


def min_hashes(s: Words) -> np.ndarray:
    """HASHES rows of min-hashes, a column for each text; every text has at least one shingle."""
    seeds = mix(np.arange(2 * HASHES, dtype=np.uint64))
    out = np.empty((HASHES, len(s.offs) - 1), np.uint64)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((s.hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), s.offs[:-1])
    return mix(out)


def _prepare(size: int, least_words: int, linked_words: int):
    names = ["scope", "key", "id", "hi", "lo", "size", "bands", "blob"]

    def run(batches):
        for batch in batches:
            for part in charfold.slices(batch, 2):
                w = words(part.column(2))
                n = np.diff(w.offs)
                wordless = _wordless(part.column(2), np.flatnonzero(n == 0)) if least_words <= 1 else {}
                long = np.flatnonzero(n >= max(least_words, 1))
                if wordless:
                    long = np.sort(np.concatenate((long, np.array([*wordless], np.int64))))
                if not long.size:
                    continue
                w = rows(w, long)
                s = distinct(_sets(w, size, [wordless[i] for i in sorted(wordless)]))
                scopes = part.column(0).dictionary_encode()  # few: hashed once each
                scope = mix(np.array([hash_text(x) for x in scopes.dictionary.to_pylist()] + [hash_text(None)], np.uint64))[scopes.indices.fill_null(-1).to_numpy(zero_copy_only=False)][long]
                m = min_hashes(s)
                own = mix(np.add.reduceat(mix(s.hashes), s.offs[:-1]) ^ scope)
                two = (m & np.uint64(3)).astype(np.uint64)
                hi, lo = (np.bitwise_or.reduce(two[h : h + 32] << (np.arange(32, dtype=np.uint64) * np.uint64(2))[:, None], axis=0) for h in (0, 32))
                linked = np.diff(w.offs) >= linked_words
                bands = np.empty((TRIES, long.size), np.uint64)
                for t in range(TRIES):
                    bands[t] = scope ^ np.uint64(t)
                    for k in leading(t):
                        bands[t] = mix(bands[t] ^ m[k])
                raw = np.ascontiguousarray(s.hashes.view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), long.size, [None, pa.py_buffer((s.offs * KEPT).astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
                take = pa.array(long)
                flat = pa.array(np.ascontiguousarray(bands.T[linked]).reshape(-1).view(np.int64))
                ends = np.concatenate(([0], np.cumsum(linked) * TRIES))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(x.view(np.int64)) for x in (own, hi, lo)), pa.array(np.diff(s.offs).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), blob], names=names)

    return run


def _wordless(texts: pa.Array, at: np.ndarray) -> dict[int, int]:
    """Row to a hash of its folded text, for those of the rows ``at`` that hold more than spaces."""
    folded = charfold.fold_strings(texts.take(pa.array(at))).to_pylist()
    squeezed = {int(i): " ".join(x.lower().split()) for i, x in zip(at, folded) if x is not None}
    return {i: hash_text(x) for i, x in squeezed.items() if x}


def _sets(w: Words, size: int, wordless: list[int]) -> Words:
    """The shingles of each row; one of fewer words has all its words, one without words its text as the only shingle.

    ``wordless``: the hashes of the texts of the rows without words, in order.
    """
    s, n = shingles(w, size), np.diff(w.offs)
    short = n < size
    if not short.any():
        return s
    whole = mix(n[short].astype(np.uint64) ^ np.uint64(0x5348_4F52_5400))  # a salt: no shingle of long texts is the same
    for k in range(size - 1):
        has = n[short] > k
        whole[has] = mix(whole[has] ^ w.hashes[w.offs[:-1][short][has] + k])
    whole[n[short] == 0] ^= np.array(wordless, np.uint64)
    return Words(np.insert(s.hashes, s.offs[:-1][short], whole), s.offs + np.concatenate(([0], np.cumsum(short))))


def hash_text(x: str | None) -> int:
    out = 14695981039346656037
    for c in (x or "").encode():
        out = ((out ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return out


class Walked:
    """Node pairs that a trie join visited and gave up."""

    visited = pruned = 0


def trie_join(words: list[np.ndarray], a: tuple, b: tuple, budgets: list[int], walked: Walked | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of fingerprints that differ in few bits, from pairs of tries.

    ``words``: the 64-bit words of the sorted fingerprints, first word first; ``budgets``: differing bits allowed up to the
    end of each. ``a`` and ``b``: (starts, ends) of the tries' ranges; the same range twice is a self-join (i < j). All node
    pairs of one depth are walked in step: each node is cut at its next bit, children that differ in it cost one more bit,
    pairs over the budget are given up, and so is a node with itself that has one member. Two single members are a leaf:
    the rest of their bits is counted at once.
    """
    alo, ahi, blo, bhi = (np.asarray(x, np.int64) for x in (*a, *b))
    depths, found, none = 64 * len(words), [], np.zeros(0, np.int64)
    zeros = {}
    todo = [(0, alo, ahi, blo, bhi, np.zeros(alo.size, np.int64))]
    while todo:
        depth, alo, ahi, blo, bhi, diff = todo.pop()
        if alo.size > AT_ONCE:  # a part of the node pairs at a time, to the end
            half = alo.size // 2
            todo += [(depth, *(x[part] for x in (alo, ahi, blo, bhi, diff))) for part in (slice(half, None), slice(half))]
            continue
        self_ = (alo == blo) & (ahi == bhi)
        if depth == depths:  # fingerprints that are equal, or near: all pairs of the two nodes
            n, wide = (ahi - alo) * (bhi - blo), bhi - blo
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(alo, n) + place // np.repeat(wide, n), np.repeat(blo, n) + place % np.repeat(wide, n)
            keep = ~np.repeat(self_, n) | (i < j)
            found.append((i[keep], j[keep]))
            continue
        w, bit = depth // 64, 63 - depth % 64
        leaf = ((ahi - alo) * (bhi - blo) == 1) & ~self_
        if leaf.any():
            i, j, sum_ = alo[leaf], blo[leaf], diff[leaf]
            ok = np.ones(i.size, bool)
            for k in range(w, len(words)):
                x = words[k][i] ^ words[k][j]
                sum_ = sum_ + np.bitwise_count(x & np.uint64((2 << bit) - 1) if k == w else x)
                ok &= sum_ <= budgets[k]
            found.append((i[ok], j[ok]))
            alo, ahi, blo, bhi, diff, self_ = (x[~leaf] for x in (alo, ahi, blo, bhi, diff, self_))
        if not alo.size:
            continue
        if depth not in zeros:
            zeros[depth] = np.concatenate(([0], np.cumsum((words[w] >> np.uint64(bit)) & np.uint64(1) == 0, dtype=np.int32)))
        z = zeros[depth]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        other = ~self_
        parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff)]
        if budgets[w]:
            parts += [(alo, amid, bmid, bhi, diff + 1), tuple(x[other] for x in (amid, ahi, blo, bmid, diff + 1))]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*parts))
        real = (ahi > alo) & (bhi > blo)
        keep = real & (diff <= budgets[w]) & ~((alo == blo) & (ahi == bhi) & (ahi - alo == 1))
        if walked:
            walked.visited += int(real.sum())
            walked.pruned += int((real & ~keep).sum())
        if keep.any():
            todo.append((depth + 1, *(x[keep] for x in (alo, ahi, blo, bhi, diff))))
    return (np.concatenate([x for x, _ in found] or [none]), np.concatenate([x for _, x in found] or [none]))


_OUT = "a long, b long, band long, hi long, lo long, size int, block int"


def _rows(a, b, band=None, hi=None, lo=None, size=None, block=None):
    n = len(a)
    fill = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *(fill(x, pa.int64()) for x in (b, band, hi, lo)), fill(size, pa.int32()), fill(block, pa.int32())], names=[x.split()[0] for x in _OUT.split(", ")])


def _candidates(i, j, ids, sizes, similarity: float):
    """Pairs of different sets whose sizes allow the similarity, the lesser id first, each once."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = (small >= similarity * large - 1e-9) & (ids[i] != ids[j])
    a, b = np.minimum(ids[i], ids[j])[keep], np.maximum(ids[i], ids[j])[keep]
    one = np.unique(np.stack([a, b], 1), axis=0)
    return one[:, 0], one[:, 1]


def _unsigned(x: np.ndarray) -> np.ndarray:
    """Words in the order in which signed numbers are sorted."""
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def _tries(budget: int, similarity: float):
    """One shard of the tries, sorted by (band, hi, lo), to candidate pairs; members below one leading word that are more
    than HOT come out as they are, with their block."""

    def finish(band, hi, lo, ids, sizes):
        cut = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True])))
        wide = np.diff(cut) > HOT
        for s, e in zip(cut[:-1][wide], cut[1:][wide]):
            yield _rows(ids[s:e], None, band[s:e], hi[s:e], lo[s:e], sizes[s:e], np.arange(e - s) // HOT)
        keep = ~np.repeat(wide, np.diff(cut))
        if keep.any():
            root = ([0], [int(keep.sum())])
            i, j = trie_join([_unsigned(x[keep]) for x in (band, hi, lo)], root, root, [0, budget, budget])
            yield _rows(*_candidates(i, j, ids[keep], sizes[keep], similarity))

    def run(batches):
        held, size, hot, seen = [], 0, None, 0
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)]
            if not len(cols[0]):
                continue
            if hot is not None:  # the rest of those below a leading word that has too many
                n = int(np.searchsorted(cols[0], hot, "right"))
                if n:
                    yield _rows(cols[3][:n], None, *(c[:n] for c in cols[:3]), cols[4][:n], (seen + np.arange(n)) // HOT)
                    seen += n
                if n == len(cols[0]):
                    continue
                cols, hot = [c[n:] for c in cols], None
            held.append(cols)
            size += len(cols[0])
            if size < 4 * HOT:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if size - last > HOT:
                hot, seen = cols[0][-1], size - last
                yield _rows(cols[3][last:], None, *(c[last:] for c in cols[:3]), cols[4][last:], np.arange(seen) // HOT)
            if last:
                yield from finish(*(c[:last] for c in cols))
            held = [] if hot is not None else [[c[last:] for c in cols]]
            size = 0 if hot is not None else size - last
        if held:
            yield from finish(*(np.concatenate(x) for x in zip(*held)))

    return run


def _blocks(budget: int, similarity: float):
    """One pair of blocks of a large trie: (band, x, y) with rows (hi, lo, a, size, block)."""

    def run(table: pa.Table) -> pa.Table:
        hi, lo, ids, sizes, block = (table.column(c).to_numpy() for c in ("hi", "lo", "a", "size", "block"))
        x = table.column("x")[0].as_py()
        order = np.lexsort((lo, hi, block != x))
        hi, lo = (_unsigned(c[order]) for c in (hi, lo))
        ids, sizes, n = ids[order], sizes[order], int((block == x).sum())
        one = ([0], [n])
        i, j = trie_join([hi, lo], one, one if n == len(ids) else ([n], [len(ids)]), [budget, budget])
        a, b = _candidates(i, j, ids, sizes, similarity)
        return pa.table({"a": a, "b": b})

    return run


def similar_sets(sets: DataFrame, budget: int, similarity: float = 0.0) -> DataFrame:
    """(a, b): ids of the candidate pairs, by binary trie self-joins. ``sets``: (id, hi, lo, size, bands), one row a set.

    ``bands`` are the leading words of a set in each trie. The budget is 0 there, so a trie falls apart into shards by them.
    """
    placed = sets.select(F.explode("bands").alias("band"), "hi", "lo", "id", "size").repartition("band").sortWithinPartitions("band", "hi", "lo")
    out = materialize(placed.mapInArrow(_tries(budget, similarity), _OUT))
    near = out.where("b IS NOT NULL").select("a", "b")
    hot = out.where("b IS NULL").select("a", "band", "hi", "lo", "size", "block")
    if not hot.isEmpty():
        count = hot.groupBy("band").agg((F.max("block") + 1).alias("n"))
        pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
        met = hot.join(count, "band").select("a", "band", "hi", "lo", "size", "block", F.explode(pair).alias("p")).select("a", "band", "hi", "lo", "size", "block", "p.x", "p.y")
        near = near.unionByName(met.groupBy("band", "x", "y").applyInArrow(_blocks(budget, similarity), "a long, b long"))
    return near.distinct()


def _overlaps(similarity: float):
    def values(raw):
        out = np.zeros((len(raw) // KEPT, 8), np.uint8)
        out[:, :KEPT] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT)
        return out.view(np.uint64)[:, 0]

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                    ok.append(False)
                    continue
                x, y = values(x), values(y)
                both = np.intersect1d(x, y, assume_unique=True).size
                ok.append(both >= similarity * (x.size + y.size - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


class NearDuplicates:
    """Near-duplicate texts of a table, each scope (record set) by itself.

    ``members``: (scope, key, id) of every key whose text has ``least_words`` words, with 1 also of texts of other characters
    only; equal sets share an id. A text with fewer words than a shingle is one shingle. Texts of fewer than
    ``linked_words`` words are linked to their copies only.
    ``links``: (a, b) ids of different sets whose similarity (shared shingles over all shingles of both) reaches the
    threshold. Null keys and texts and shorter texts take no part in pairs; repeated rows count once.
    """

    def __init__(self, df: DataFrame, scope: str, key: str, text: str, size: int = 5, similarity: float = 0.8, least_words: int = 1, linked_words: int = 1):
        keyed = df.select(F.col(scope).cast("string").alias("scope"), F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL")
        given = keyed.where("text IS NOT NULL")
        self.keys = keyed.select("scope", "key").distinct() if least_words <= 1 else None
        made = materialize(given.mapInArrow(_prepare(size, least_words, linked_words), "scope string, key string, id long, hi long, lo long, size int, bands array<long>, blob binary"))
        self.members = materialize(made.select("scope", "key", "id").distinct())
        sets = made.select("id", "hi", "lo", "size", "bands").groupBy("id").agg(*(F.first(c).alias(c) for c in ("hi", "lo", "size", "bands")))
        near = materialize(similar_sets(sets, error_budget(similarity), similarity))
        wanted = broadcast_if_small(materialize(near.select(F.col("a").alias("id")).union(near.select("b")).distinct()))
        blobs = made.select("id", "blob").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("blob").alias("blob"))
        blobs = materialize(blobs)
        both = near.join(blobs.toDF("a", "blob_a"), "a").join(blobs.toDF("b", "blob_b"), "b").select("a", "b", "blob_a", "blob_b")
        self.links = materialize(both.mapInArrow(_overlaps(similarity), "a long, b long"))

    def pairs(self) -> DataFrame:
        """(scope, key_a, key_b), key_a < key_b: every pair of keys, copies of the same text included."""
        m = self.members
        across = self.links.join(m.toDF("scope", "x", "a"), "a").join(m.toDF("scope_b", "y", "b"), "b").select("scope", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).where("key_a < key_b")
        copies = m.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        within = grouped_pairs(m.join(copies, "id", "left_semi").withColumn("k", F.struct("scope", "key")), "id", "k").select("key_a.scope", F.col("key_a.key").alias("key_a"), F.col("key_b.key").alias("key_b"))
        return across.unionByName(within).distinct()

    def classes(self) -> DataFrame:
        """(scope, key, class_id, links): one row a key; the class is the least key linked directly or over others.

        ``links``: other keys that are nearly the same text, copies included. With ``least_words`` 1 every key has a row: one
        of which all texts are null or blank is a class of its own with 0 links.
        """
        m = self.members
        sized = m.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        two = self.links.union(self.links.select("b", "a"))
        more = two.join(sized.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "id")
        part = components(self.links.union(m.select("id", "id"))).toDF("id", "part")
        all_ = m.join(part, "id").join(sized, "id").join(more, "id", "left")
        least = all_.groupBy("part").agg(F.min("key").alias("class_id"))
        out = all_.join(least, "part").select("scope", "key", "class_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
        if self.keys is None:
            return out
        same = F.col("m.scope").eqNullSafe(F.col("k.scope")) & (F.col("m.key") == F.col("k.key"))
        blank = self.keys.alias("k").join(m.alias("m"), same, "left_anti").select("scope", "key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("links"))
        return out.unionByName(blank)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("chunks", "chunk_id", "body_text"), ("documents", "doc_id", "text")]
    read = [spark.read.parquet(f"{sf}/{t}.parquet").select(F.lit(t).alias("record_set"), F.col(k).cast("string").alias("key"), F.col(c).alias("text")) for t, k, c in parts]
    return read[0].unionByName(read[1])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return NearDuplicates(_texts(spark, sf), "record_set", "key", "text", size=3, similarity=0.70, least_words=40).pairs().withColumnRenamed("scope", "record_set")


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a key: its class and links by the pairs of ``p1_found``. Texts of fewer than 40 words have only their copies."""
    return NearDuplicates(_texts(spark, sf), "record_set", "key", "text", size=3, similarity=0.70, least_words=1, linked_words=40).classes().withColumnRenamed("scope", "record_set")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
