"""Problem 3: the most similar vectors of every vector.

NN-descent on Spark. The start is sparse: the nearest of one hash bucket. In every round the vectors that are neighbours of
one vector, or have it for a neighbour, meet there, and pairs of which one is new there are compared; and all vectors meet in
the cells of rotations drawn for this round, which is how groups that no link leads to find each other, however many there
are. Better links take the place of worse ones, until next to no link is new. New vectors are answered by greedy search on
the graph.
"""

from __future__ import annotations

import gc
import time
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.session import broadcast_if_small, materialize

#: Neighbours kept of each vector while the graph is built, and vectors sampled of those that have it for a neighbour.
KEEP, REVERSE = 16, 16
#: Rotations of each round, and vectors of a cell that they aim at.
ROTATIONS, CELL = 3, 2048
#: Vectors that have one for a neighbour from which on only so many of them, chosen by a hash, are told to meet there; found on
#: one link in PROBE.
HUB, PROBE = 1024, 16
#: Vectors of a bucket that the hash aims at, vectors of a bucket compared at once, vectors of a block of one round.
BUCKET, WINDOW, BLOCK = 32, 512, 8192
#: Better links of one vector that one block of a round sends on; what it finds beyond them is found again later.
SENT = 12
#: The rounds end when fewer than this share of all links is new, or after so many.
SETTLED, MOST_ROUNDS = 0.001, 15
#: The same for a graph of links of a least cosine only: nothing but what is asked for is new there.
SETTLED_FOUND = 0.0001
#: Vectors are kept as unit vectors of 16-bit numbers: cosines are exact to about 1e-5, equal vectors stay equal.
SCALE = 32767
#: Cosines of 32-bit floats are at most so far off.
NEAR = 1e-5


def unit(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector (``dim`` finite numbers, not all zero), and those vectors as 16-bit unit vectors."""
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    if not rows.size:
        return rows, np.zeros((0, dim), np.int16)
    x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    big = np.abs(x).max(1)
    ok = np.isfinite(x).all(1) & (big > 0)
    x = x[ok] / big[ok, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return rows[ok], np.rint(x * SCALE).astype(np.int16)


class Hasher:
    """A cross-polytope hash: the nearest of the signed axes after a random rotation, digit by digit."""

    def __init__(self, dim: int, rows: int, seed: int = 7, bucket: int = BUCKET):
        rng = np.random.default_rng(seed)
        need, digits = max(2 if bucket == BUCKET else 1, rows // bucket), []
        while need > 1:
            digits.append(min(dim, max(1, -(-need // 2))))
            need //= 2 * digits[-1]
        self.turns = [(np.linalg.qr(rng.standard_normal((dim, dim)))[0], width) for width in digits]
        self.line = rng.standard_normal(dim)

    def codes(self, q: np.ndarray, space: np.ndarray) -> np.ndarray:
        """A number for each vector: space, digits; then a place in the bucket, 16 bits."""
        x, digits = q / SCALE, np.zeros(len(q), np.int64)
        for turn, width in self.turns:
            y = x @ turn[:, :width]
            at = np.abs(y).argmax(1)
            digits = digits * (2 * width) + 2 * at + (y[np.arange(len(q)), at] > 0)
        place = np.clip((x @ self.line) * 8000 + 32768, 0, 65535).astype(np.int64)
        return (((space << 32) | (digits & 0xFFFFFFFF)) << 16) | place


def _binary(q: np.ndarray) -> pa.Array:
    n, width = q.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * q.itemsize * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(q).tobytes())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Exact integers in doubles: their products sum exactly, in whatever order."""
    return _whole(column, dim).astype(np.float64)


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(how many values each row holds, all values) of a binary column of values of ``kind``; null rows have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.dtype(kind)
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    if column.null_count:
        column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if offs[0] == offs[-1]:
        return np.zeros(len(column), np.int64), np.zeros(0, kind)
    return np.diff(offs) // kind.itemsize, np.frombuffer(column.buffers()[2], kind, offset=int(offs[0]), count=int(offs[-1] - offs[0]) // kind.itemsize)


def _blobs(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column; row i holds the next ``counts[i]`` values."""
    offs = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    return _flat(column, np.int16)[1].reshape(-1, dim)


def _units(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1)[:, None]


def _exact(q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, the same wherever a pair meets."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), 50_000):
        x, y = q[i[lo : lo + 50_000]].astype(np.float64), q[j[lo : lo + 50_000]].astype(np.float64)
        out[lo : lo + 50_000] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return out


#: A link in the row of a vector: to v, which lives in block pv. Rows of a graph: best links first.
LINK = np.dtype([("v", "<i8"), ("sim", "<f8"), ("pv", "<i4"), ("fresh", "<i4")])
_GRAPH = "u long, pu int, space int, q binary, links binary, size long, fresh long"


class Links(NamedTuple):
    """Columns of found links: of u, which lives in block pu, to v, which lives in block pv."""

    u: np.ndarray
    pu: np.ndarray
    v: np.ndarray
    pv: np.ndarray
    sim: np.ndarray

    def table(self):
        return pa.RecordBatch.from_arrays([pa.array(self.u, pa.int64()), pa.array(self.pu, pa.int32()), pa.array(self.v, pa.int64()), pa.array(self.pv, pa.int32()), pa.array(self.sim, pa.float64())], names=["u", "pu", "v", "pv", "sim"])


_LINK = "u long, pu int, v long, pv int, sim double"
_NONE = Links(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))


def best(links: Links, keep: int) -> Links:
    """The ``keep`` most similar links of each u, each v once."""
    order = np.lexsort((links.v, links.u))
    u, v = links.u[order], links.v[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    links = Links(*(c[order][once] for c in links))
    order = np.lexsort((links.v, -links.sim, links.u))
    u = links.u[order]
    top = order[np.arange(len(u)) - np.searchsorted(u, u) < keep]
    return Links(*(c[top] for c in links))


def _mark(ids: np.ndarray, no: int) -> np.ndarray:
    """16 bits of an id that tell in round ``no`` which links a vector has; other ids fall together in other rounds."""
    salt = np.uint64(0x9E3779B97F4A7C15 * (no + 1) & 0xFFFFFFFFFFFFFFFF)
    return (((ids.astype(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _least(counts: np.ndarray, links: np.ndarray, keep: int, floor: float) -> np.ndarray:
    """The cosine from which on a link is better than the last of a full row, or counts at all."""
    out = np.full(len(counts), floor)
    full = np.flatnonzero(counts >= keep)
    out[full] = np.maximum(floor, links["sim"][np.cumsum(counts)[full] - 1])
    return out


def _known(counts: np.ndarray, marks: np.ndarray, keep: int) -> np.ndarray:
    known = np.full((len(counts), keep), 1 << 20)
    row = np.repeat(np.arange(len(counts)), counts)
    known[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = marks
    return known


_CELL = "code long, u long, pu int, q binary, least double, known binary"


def _visit(dim: int, hashers: list[Hasher], keep: int, no: int, floor: float):
    """Rows of the graph to one row for each rotation, with the vector's cell there."""

    def run(batches):
        for b in batches:
            q, (counts, links) = _whole(b.column("q"), dim), _flat(b.column("links"), LINK)
            least, known = pa.array(_least(counts, links, keep, floor)), _blobs(counts, _mark(links["v"], no))
            space = b.column("space").to_numpy().astype(np.int64)
            for t, hasher in enumerate(hashers):
                code = hasher.codes(q, space * len(hashers) + t)
                yield pa.RecordBatch.from_arrays([pa.array(code), b.column("u"), b.column("pu"), b.column("q"), least, known], names=[x.split()[0] for x in _CELL.split(", ")])

    return run


def _cell_links(dim: int, keep: int, window: int, sent: int, no: int = 0):
    """Batches sorted by code to links of the vectors of each cell; one over ``window`` in overlapping windows of its order."""

    def links(code, ids, p, q, least, known):
        cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
        x, tag, near, out = _units(q), _mark(ids, no), (least - NEAR).astype(np.float32), []
        for a, b in zip(cut[:-1], cut[1:]):
            for lo in range(a, max(a + 1, b - window // 2), window // 2) if b - a > window else (a,):
                hi = min(b, lo + window)
                if hi - lo < 2:
                    continue
                for at in range(lo, hi, 512):
                    to = min(hi, at + 512)
                    s = x[at:to] @ x[lo:hi].T
                    s[np.arange(to - at), np.arange(at - lo, to - lo)] = -2
                    flat = np.flatnonzero(s >= near[at:to, None])
                    if flat.size > 2 * (keep + sent) * (to - at):
                        k = min(keep + sent, hi - lo - 1)
                        j = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        flat = (j + np.arange(to - at)[:, None] * (hi - lo)).ravel()
                        flat = flat[s.ravel()[flat] >= np.repeat(near[at:to], k)]
                    i, j = np.divmod(flat, hi - lo)
                    i, j = i + at, j + lo
                    new = ~(known[i] == tag[j, None]).any(1)
                    i, j = i[new], j[new]
                    out.append(best(Links(i, p[i], j, p[j], s.ravel()[flat[new]]), sent))
        if not out:
            return _NONE
        i, _, j, _, _ = (np.concatenate(c) for c in zip(*out))
        sim = _exact(q, i, j)
        ok = sim >= least[i]
        i, j, sim = i[ok], j[ok], sim[ok]
        return best(Links(ids[i], p[i], ids[j], p[j], sim), sent)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                counts, marks = _flat(b.column(5), np.int16)
                held.append((b.column(0).to_numpy() >> 16, b.column(1).to_numpy(), b.column(2).to_numpy(), _whole(b.column(3), dim), b.column(4).to_numpy(), _known(counts, marks, keep)))
                size += b.num_rows
            if size >= 20_000:
                cols = [np.concatenate(c) for c in zip(*held)]
                # the last cell waits for its rest; one that is larger than that goes on from its last window
                last = int(np.searchsorted(cols[0], cols[0][-1]))
                upto = last if size - last <= 10_000 else size
                last = last if upto < size else size - window // 2
                yield links(*(c[:upto] for c in cols)).table()
                held, size = [tuple(c[last:] for c in cols)], size - last
        if held:
            yield links(*(np.concatenate(c) for c in zip(*held))).table()

    return run


#: Marks of a vector at a centre: new there; one of the centre's own neighbours (all of those meet, of the others a sample).
_NEW, _OWN = 1, 2
_SENT = "p int, u long, pu int, q binary, least double, centres binary, marks binary, known binary"
_TOLD = "pv int, v long, u long, pu int, fresh int"


def _tell(batches):
    """Rows of the graph to one row for each link, for the vector that it leads to."""
    for b in batches:
        counts, links = _flat(b.column("links"), LINK)
        at = pa.array(np.repeat(np.arange(b.num_rows), counts))
        yield pa.RecordBatch.from_arrays([pa.array(links["pv"]), pa.array(links["v"]), b.column("u").take(at), b.column("pu").take(at), pa.array(links["fresh"])], names=[x.split()[0] for x in _TOLD.split(", ")])


def _named(schema: str, *columns) -> pa.Table:
    return pa.Table.from_arrays(list(columns), names=[x.split()[0] for x in schema.split(", ")])


def _send(keep: int, no: int, floor: float):
    """A block of the graph, and what its vectors are told, to one row for each block where a vector has to be.

    A vector meets at itself, at its neighbours, and at those that have it for a neighbour. One without new links, that no
    other newly has, is there all the same: another pair may be new at the centre.
    """

    def run(graph: pa.Table, told: pa.Table) -> pa.Table:
        u, pu = graph["u"].to_numpy(), graph["pu"].to_numpy()
        n, (counts, links) = len(u), _flat(graph["links"], LINK)
        order = np.argsort(u)
        v = told["v"].to_numpy()
        brow = order[np.searchsorted(u[order], v)] if n else np.zeros(0, np.int64)
        row, every = np.repeat(np.arange(n), counts), np.flatnonzero((counts > 0) | (np.bincount(brow, minlength=n) > 0))
        rows = np.concatenate([every, row, brow])
        p = np.concatenate([pu[every], links["pv"], told["pu"].to_numpy()]).astype(np.int64)
        centre = np.concatenate([u[every], links["v"], told["u"].to_numpy()])
        mark = np.concatenate([np.full(len(every), _OWN), links["fresh"] * _NEW, told["fresh"].to_numpy() * _NEW + _OWN]).astype(np.int8)
        order = np.lexsort((p, rows))
        rows, p, centre, mark = rows[order], p[order], centre[order], mark[order]
        cut = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (p[1:] != p[:-1])))) if len(rows) else np.zeros(0, np.int64)
        size, at = np.diff(np.append(cut, len(rows))), pa.array(rows[cut])
        least, known = pa.array(_least(counts, links, keep, floor)), _blobs(counts, _mark(links["v"], no))
        return _named(_SENT, pa.array(p[cut], pa.int32()), *(graph[c].combine_chunks().take(at) for c in ("u", "pu", "q")), least.take(at), _blobs(size, centre), _blobs(size, mark), known.take(at))

    return run


def _seats(table: pa.Table, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, member, new) of the centres of a block: members of one centre stand together."""
    count, centre = _flat(table["centres"], np.int64)
    member, mark = np.repeat(np.arange(len(ids)), count), _flat(table["marks"], np.int8)[1]
    if not len(member):
        return centre, member, np.zeros(0, bool)
    order = np.lexsort((member, centre))
    member, centre, mark = member[order], centre[order], mark[order]
    first = np.flatnonzero(np.concatenate(([True], (centre[1:] != centre[:-1]) | (member[1:] != member[:-1]))))
    mark = np.bitwise_or.reduceat(mark, first)
    member, centre = member[first], centre[first]
    owned, new = mark & _OWN > 0, mark & _NEW > 0
    lot = (ids[member] ^ centre) * 0x5851F42D4C957F2D
    order = np.lexsort((lot, ~new, ~owned, centre))
    member, centre, owned, new = member[order], centre[order], owned[order], new[order]
    start = np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1])))
    size = np.diff(np.append(start, len(centre)))
    place = np.arange(len(centre)) - np.repeat(start + np.add.reduceat(owned, start, dtype=np.int64), size)
    keep = owned | (place < REVERSE)
    return centre[keep], member[keep], new[keep]


def _meet(dim: int, keep: int, no: int):
    """One block of a round: the vectors that belong to each centre of the block are compared, pairs of two old ones aside.

    Rows: what ``_send`` sends. Links that a vector has already aren't sent again. Memory: the vectors of the block and those
    sent to it, which sampling and HUB bound.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, own, least = (table[c].to_numpy() for c in ("u", "pu", "least"))
        q = _whole(table["q"], dim)
        x, near = _units(q), (least - NEAR).astype(np.float32)
        known, tag = _known(*_flat(table["known"], np.int16), keep), _mark(ids, no)
        centre, member, fresh = _seats(table, ids)
        start = np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1]))) if len(centre) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(centre)))
        live = (np.add.reduceat(fresh, start, dtype=np.int64) > 0) & (size > 1) if len(start) else np.zeros(0, bool)
        start, size = start[live], size[live]
        order = np.argsort(size, kind="stable")
        start, size, found, at = start[order], size[order], [], 0
        while at < len(start):  # centres of about the same number of members at once
            to = at + 1
            while to < len(start) and (to - at + 1) * int(size[to]) ** 2 <= 4_000_000 and (size[to] <= size[at] + 4 or to - at < 64):
                to += 1
            wide = int(size[to - 1])
            real = np.arange(wide) < size[at:to, None]
            slot = np.where(real, start[at:to, None] + np.arange(wide), start[at:to, None])
            m, new = member[slot], fresh[slot] & real
            y = x[m]
            s = np.matmul(y, y.transpose(0, 2, 1))
            c, i, j = np.nonzero((s >= near[m][:, :, None]) & (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :])
            u, v = m[c, i], m[c, j]
            other = np.flatnonzero(u != v)
            other = other[~(known[u[other]] == tag[v[other], None]).any(1)]
            found.append(Links(u[other], own[u[other]], v[other], own[v[other]], s[c[other], i[other], j[other]]))
            if sum(len(f.u) for f in found) > 2_000_000:
                found = [best(Links(*(np.concatenate(c) for c in zip(*found))), min(keep, SENT))]
            at = to
        got = best(Links(*(np.concatenate(c) for c in zip(*found))), min(keep, SENT)) if found else _NONE
        sim = _exact(q, got.u, got.v)
        ok = sim >= least[got.u]
        return pa.Table.from_batches([Links(ids[got.u[ok]], got.pu[ok], ids[got.v[ok]], got.pv[ok], sim[ok]).table()])

    return run


def _merge(keep: int):
    """A block of the graph and the links found for its vectors to the graph after the round.

    What is there was met in this round, or left out by its sample, and is old from now on.
    """

    def run(graph: pa.Table, found: pa.Table) -> pa.Table:
        u = graph["u"].to_numpy()
        counts, old = _flat(graph["links"], LINK)
        order = np.argsort(u)
        more = np.zeros(found.num_rows, LINK)
        for c in ("v", "pv", "sim"):
            more[c] = found[c].to_numpy()
        more["fresh"] = 1
        row = np.concatenate([np.repeat(np.arange(len(u)), counts), order[np.searchsorted(u[order], found["u"].to_numpy())] if len(u) else np.zeros(0, np.int64)])
        links = np.concatenate([old, more])
        links["fresh"][: len(old)] = 0
        by = np.lexsort((links["fresh"], links["v"], row))
        row, links = row[by], links[by]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (links["v"][1:] != links["v"][:-1])
        row, links = row[once], links[once]
        by = np.lexsort((links["v"], -links["sim"], row))
        row, links = row[by], links[by]
        top = np.arange(len(row)) - np.searchsorted(row, row) < keep
        row, links = row[top], links[top]
        size = np.bincount(row, minlength=len(u))
        return _named(_GRAPH, *(graph[c].combine_chunks() for c in ("u", "pu", "space", "q")), _blobs(size, links), pa.array(size, pa.int64()), pa.array(np.bincount(row, links["fresh"], minlength=len(u)).astype(np.int64)))

    return run


def _forget(old: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more, and let the driver drop the shuffles behind it."""
    spark = old.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    time.sleep(1.5)  # until the driver has heard that the plans are gone
    spark._jvm.java.lang.System.gc()


class NeighbourGraph:
    """The neighbour graph of a table of vectors, built by NN-descent.

    ``vectors``: (id, p, q, code, space) distinct vectors; ``members``: (id, key) the rows that hold each; ``first``: (id, keys)
    the least KEEP of them; ``graph``: (u, pu, space, q, links) with links as LINK, best first. ``shares``: the share of new
    links of each round. ``floor``: links of a lower cosine are not wanted, and are neither kept nor sent.

    Null, zero, not finite and wrong-length vectors and null keys take no part; ``dim`` None takes the most frequent length.
    Repeated rows count once, equal vectors are one node. ``space``: a column that keeps tables apart (vectors of different
    spaces are never linked). The rounds go on until the graph stands still; at a vector all its neighbours meet, and a sample of
    those that have it for one (new ones first), and a bucket over WINDOW begins with links within windows: no vector is left out,
    the links that miss are found over other neighbours, or in a cell of another round.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, space: str | None = None, keep: int = KEEP, dim: int | None = None, rounds: int = MOST_ROUNDS, floor: float = -2.0):
        rows = df.select(F.col(key).cast("string").alias("key"), (F.col(space).cast("int") if space else F.lit(0)).alias("space"), F.col(vector).cast("array<float>").alias("vector")).where("key IS NOT NULL AND vector IS NOT NULL")
        sizes = rows.groupBy(F.size("vector").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").limit(1).collect() if dim is None else []
        self.dim, self.keep, self.floor = dim or (sizes[0]["n"] if sizes else 1), keep, floor
        count = sizes[0]["count"] if sizes else rows.count()
        self.count, self.hasher, self.blocks = count, Hasher(self.dim, count), max(8, -(-count // BLOCK))
        dim_, hasher = self.dim, self.hasher

        def prepare(batches):
            for b in batches:
                at, q = unit(b.column(2), dim_)
                if not at.size:
                    continue
                take = pa.array(at)
                space_ = b.column(1).take(take)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), space_, _binary(q), pa.array(hasher.codes(q, space_.to_numpy().astype(np.int64)))], names=["key", "space", "q", "code"])

        made = materialize(rows.mapInArrow(prepare, "key string, space int, q binary, code long").withColumn("id", F.xxhash64("space", "q")))
        self.members = materialize(made.select("id", "key").distinct())
        distinct = made.groupBy("id").agg(*(F.first(c).alias(c) for c in ("q", "space", "code")))
        # a block is a set of whole buckets; a bucket of more than a block is spread
        bucket = F.shiftright("code", 16)
        hot = made.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(f"n > {BLOCK}")
        split = F.when(F.col("n").isNotNull(), F.pmod("id", F.ceil(F.col("n") / BLOCK))).otherwise(0)
        placed = distinct.withColumn("bucket", bucket).join(hot, "bucket", "left")
        self.vectors = materialize(placed.select("id", F.pmod(F.xxhash64("bucket", split), F.lit(self.blocks)).cast("int").alias("p"), "q", "space", "code"))
        _forget(made)
        first = self.members.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("key"))).where(f"n <= {keep}")
        self.first = first.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        self.shares: list[float] = []
        self.graph = self._descend(self._initial(), rounds)

    def _merged(self, graph: DataFrame, found: DataFrame) -> DataFrame:
        return materialize(graph.groupBy("pu").cogroup(found.groupBy("pu")).applyInArrow(_merge(self.keep), _GRAPH))

    def _initial(self) -> DataFrame:
        placed = self.vectors.select("code", F.col("id").alias("u"), F.col("p").alias("pu"), "q", F.lit(self.floor).alias("least"), F.lit(b"").alias("known"))
        links = placed.repartitionByRange("code").sortWithinPartitions("code").mapInArrow(_cell_links(self.dim, self.keep, WINDOW, self.keep), _LINK)
        empty = self.vectors.select(F.col("id").alias("u"), F.col("p").alias("pu"), "space", "q", F.lit(b"").alias("links"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("fresh"))
        return self._merged(empty, links)

    def _round(self, graph: DataFrame, no: int) -> DataFrame:
        told = graph.mapInArrow(_tell, _TOLD)
        hubs = materialize(told.where(F.pmod(F.xxhash64("u", "v"), F.lit(PROBE)) == 0).groupBy("v").agg((F.count(F.lit(1)) * PROBE).alias("n")).where(f"n > {HUB}"))
        if not hubs.isEmpty():
            told = told.join(broadcast_if_small(hubs), "v", "left").where(f"n IS NULL OR pmod(xxhash64(v, u), n) < {HUB}").select("pv", "v", "u", "pu", "fresh")
        sent = graph.groupBy("pu").cogroup(told.groupBy("pv")).applyInArrow(_send(self.keep, no, self.floor), _SENT)
        met = sent.groupBy("p").applyInArrow(_meet(self.dim, self.keep, no), _LINK)
        hashers = [Hasher(self.dim, self.count, 1000 + no * ROTATIONS + t, CELL) for t in range(ROTATIONS)]
        cells = graph.mapInArrow(_visit(self.dim, hashers, self.keep, no, self.floor), _CELL).repartition(F.shiftright("code", 16)).sortWithinPartitions("code")
        return self._merged(graph, met.unionByName(cells.mapInArrow(_cell_links(self.dim, self.keep, 2 * CELL, min(self.keep, SENT), no), _LINK)))

    def _descend(self, graph: DataFrame, rounds: int) -> DataFrame:
        for no in range(rounds):
            after = self._round(graph, no)
            r = after.agg(F.sum("fresh").alias("new"), F.sum("size").alias("all")).head()
            _forget(graph)
            graph = after
            self.shares.append((r["new"] or 0) / max(1, r["all"] or 0))
            if self.shares[-1] < (SETTLED if self.floor < -1 else SETTLED_FOUND):
                break
        return graph

    def _all_links(self) -> DataFrame:
        """(u, v, sim): the links of the graph."""

        def run(batches):
            for b in batches:
                counts, links = _flat(b.column("links"), LINK)
                yield pa.RecordBatch.from_arrays([b.column("u").take(pa.array(np.repeat(np.arange(b.num_rows), counts))), pa.array(links["v"]), pa.array(links["sim"])], names=["u", "v", "sim"])

        return self.graph.select("u", "links").mapInArrow(run, "u long, v long, sim double")

    def links(self, least: float) -> DataFrame:
        """(u, v, sim): the links of the graph of at least that cosine."""
        return self._all_links().where(F.col("sim") >= least)

    def neighbours(self, k: int, least: float) -> DataFrame:
        """(key, neighbour, sim): up to ``k`` other rows of each, by cosine, equal ones by key."""
        links = self.links(least).union(self.members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "id", F.lit(1.0)))
        named = links.join(self.first.toDF("v", "keys"), "v").select("u", (-F.col("sim")).alias("far"), F.explode("keys").alias("key"))
        ranked = named.groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "key"))), 1, k + 1).alias("near"))
        each = self.members.join(ranked.withColumnRenamed("u", "id"), "id").select(F.col("key").alias("own"), "near")
        each = each.select(F.col("own").alias("key"), F.explode(F.slice(F.filter("near", lambda x: x.key != F.col("own")), 1, k)).alias("n"))
        return each.select("key", F.col("n.key").alias("neighbour"), (-F.col("n.far")).alias("sim"))

    def search(self, queries: DataFrame, key: str, vector: str, space: str | None = None, k: int = 10, beam: int = 48, most_rounds: int = 20) -> DataFrame:
        """(key, neighbour, sim): greedy graph search for vectors, each in its ``space`` (0 without that column).

        Enters the graph at vectors of the query's hash bucket and at vectors drawn from its whole space, ``beam`` of each
        at most, then goes to the neighbours of the best ``beam`` found until those stay the same. Queries of unusable
        vectors have no row, repeated ones count once.
        """
        dim, hasher = self.dim, self.hasher

        def prepare(batches):
            for b in batches:
                at, q = unit(b.column(2), dim)
                if at.size:
                    space_ = b.column(1).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), space_, _binary(q), pa.array(hasher.codes(q, space_.to_numpy().astype(np.int64)))], names=["key", "space", "qq", "code"])

        def score(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_cosines(b.column(2), b.column(3), dim))], names=["key", "v", "sim"])

        asked = queries.select(F.col(key).cast("string").alias("key"), (F.col(space).cast("int") if space else F.lit(0)).alias("space"), F.col(vector).cast("array<float>").alias("v")).where("key IS NOT NULL AND space IS NOT NULL AND v IS NOT NULL")
        asked = asked.groupBy("key", "space").agg(F.min("v").alias("v"))
        asked = materialize(asked.mapInArrow(prepare, "key string, space int, qq binary, code long"))
        bucketed = self.vectors.select("id", "space", F.shiftright("code", 16).alias("bucket"))
        near = bucketed.withColumn("n", F.row_number().over(W.partitionBy("bucket").orderBy("id"))).where(f"n <= {beam}").select("bucket", F.col("id").alias("v"))
        far = bucketed.withColumn("n", F.row_number().over(W.partitionBy("space").orderBy(F.xxhash64("id", F.lit(5))))).where(f"n <= {beam}").select("space", F.col("id").alias("v"))
        open_ = asked.withColumn("bucket", F.shiftright("code", 16)).join(near, "bucket").select("key", "space", "v").union(asked.join(F.broadcast(far), "space").select("key", "space", "v")).distinct()
        vectors, state = self.vectors.select(F.col("id").alias("v"), "q"), None
        links = self._all_links().groupBy("u").agg(F.collect_list("v").alias("vs")).withColumnRenamed("u", "v")
        back = links.select("v", F.explode("vs").alias("u")).withColumn("n", F.row_number().over(W.partitionBy("u").orderBy(F.xxhash64("u", "v")))).where(f"n <= {REVERSE}")
        back = back.groupBy("u").agg(F.collect_list("v").alias("back")).withColumnRenamed("u", "v")
        ways_of = materialize(links.join(back, "v", "full").select("v", F.array_union(F.coalesce("vs", F.array()), F.coalesce("back", F.array())).alias("vs")))
        w = W.partitionBy("key", "space").orderBy(F.desc("sim"), "v")
        ask = asked.select(F.struct("key", "space").alias("who"), "qq")
        for _ in range(most_rounds):
            new = open_.select(F.struct("key", "space").alias("who"), "v").join(ask, "who").join(vectors, "v").select("who", "v", "qq", "q").mapInArrow(score, "key struct<key string, space int>, v long, sim double")
            new = new.select("key.key", "key.space", "v", "sim", F.lit(True).alias("fresh"))
            all_ = new if state is None else state.withColumn("fresh", F.lit(False)).unionByName(new)
            state = materialize(all_.withColumn("n", F.row_number().over(w)).where(f"n <= {beam}").drop("n"))
            ways = state.where("fresh").join(ways_of, "v").select("key", "space", F.explode("vs").alias("v")).distinct()
            open_ = materialize(ways.join(state.select("key", "space", "v"), ["key", "space", "v"], "left_anti"))
            state = state.drop("fresh")
            if open_.isEmpty():
                break
        named = state.join(self.first.toDF("v", "keys"), "v").select("key", "space", "sim", F.explode("keys").alias("neighbour"))
        return named.withColumn("n", F.row_number().over(W.partitionBy("key", "space").orderBy(F.desc("sim"), "neighbour"))).where(f"n <= {k}").select("key", "space", "neighbour", "sim")


def _cosines(a: pa.Array, b: pa.Array, dim: int) -> np.ndarray:
    x, y = _matrix(a, dim), _matrix(b, dim)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) if len(x) else np.zeros(0)


def _chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, space, vector): space 0 for ``embedding_stmt``, 1 for ``embedding_proof``."""
    chunks = spark.read.parquet(f"{sf}/chunks.parquet")
    both = [chunks.select("chunk_id", F.lit(i).alias("space"), F.col(c).alias("vector")) for i, c in enumerate(("embedding_stmt", "embedding_proof"))]
    return both[0].unionByName(both[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    graph = NeighbourGraph(_chunk_vectors(spark, sf), "chunk_id", "vector", "space", floor=0.85)
    return graph.neighbours(5, 0.85).select(F.col("key").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"))


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, space, neighbour_id, sim): the ten most similar vectors of the same column, that of the chunk itself
    included, of every chunk whose id (the hexadecimal digits at its end) is divisible by 100, searched in the graph of all."""
    all_ = _chunk_vectors(spark, sf)
    number = F.conv(F.substring_index("chunk_id", ":", -1), 16, 10).cast("decimal(20,0)")
    graph = NeighbourGraph(all_, "chunk_id", "vector", "space")
    found = graph.search(all_.where(number % 100 == 0), "chunk_id", "vector", "space")
    return found.select(F.col("key").alias("chunk_id"), "space", F.col("neighbour").alias("neighbour_id"), F.round("sim", 4).alias("sim"))


QUERIES = {"p3_found": p3_found, "p3_search": p3_search}
