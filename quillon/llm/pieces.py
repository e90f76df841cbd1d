"""Problem 4: oversized texts cut into overlapping pieces at natural boundaries.

Every text is worked on in ranges, whatever its length. A range with halos on both sides tabulates its boundaries: for
every place where a piece may start, where that piece ends and the next one starts. Where the first piece of a range
starts, and whether an odd number of dollar signs precedes it, depends on the ranges before it; so the tables are
stitched: runs of FAN tables are composed to one, runs of those again, until one is left of a text, and then the starts,
the piece numbers and the offsets (prefix sums of lengths) go down the same way. Each range emits its pieces by offset.

``split_pieces`` takes texts of a table, ``split_files`` files of any size, in byte ranges that workers read by themselves.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import charfold
from quillon.session import materialize

LIMIT, LEAST, OVERLAP = 1200, 840, 100
#: Characters of a range of a text in a table; bytes of a range of a file; tables composed at a time.
RANGE, FILE_RANGE, FAN = 800, 1 << 20, 64
# The characters that count as white space, and the sentence marks.
BLANK, FEED, MARKS, DOLLAR = [9, 10, 12, 13, 32], 10, [33, 46, 63], 36


class Cutter:
    """The boundaries of one range and the cutting rule on them; places count from the start of the range.

    ``text``: the code points of the range with its halos; ``lead`` of them lie before it, ``width`` in it. The halo after
    it must reach ``limit`` + 1 characters, or the end of the text; the one before it ``limit``, and beyond any white space
    that stands there, or the start of the text. ``odd``: whether an odd number of dollar signs precedes the range.
    """

    def __init__(self, text: np.ndarray, lead: int, width: int, odd: int, limit: int, least: int, overlap: int):
        blank = np.isin(text, BLANK)
        start = np.zeros(text.size, bool)
        start[1:] = blank[:-1] & ~blank[1:]
        at = np.flatnonzero(start)
        # the white space in front of a word start is the run that ends there
        solid = np.flatnonzero(~blank)
        left = np.concatenate(([0], solid[:-1] + 1))[np.searchsorted(solid, at)] if at.size else at
        feeds = np.concatenate(([0], np.cumsum(text == FEED)))
        mark = np.where(left > 0, np.isin(text[np.maximum(left - 1, 0)], MARKS), False)
        kind = np.where(feeds[at] - feeds[left] >= 2, 2, np.where(mark, 1, 0))
        dollars = np.concatenate(([0], np.cumsum(text == DOLLAR)))
        even = (dollars[at] - dollars[lead] + odd) % 2 == 0
        self.starts = at - lead
        self.cuts = [self.starts[even], self.starts[even & (kind == 1)], self.starts[even & (kind == 2)]]
        self.lead, self.width, self.size = lead, width, text.size - lead
        self.odd = int(dollars[lead + width] - dollars[lead]) % 2
        self.limit, self.least, self.overlap = limit, least, overlap

    def _between(self, places: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether one of ``places`` lies from ``lo`` to ``hi``, both included."""
        return np.searchsorted(places, hi, "right") > np.searchsorted(places, lo)

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end of the piece that starts at each place, start of the next one, -1 after the last piece)."""
        end = at + self.limit
        for cuts in self.cuts:  # a better kind of boundary later in the list
            if cuts.size:
                i = np.searchsorted(cuts, at + self.limit, "right") - 1
                best = cuts[np.maximum(i, 0)]
                end = np.where((i >= 0) & (best >= at + self.least), best, end)
        if self.starts.size:
            i = np.searchsorted(self.starts, end - self.overlap)
            best = self.starts[np.minimum(i, self.starts.size - 1)]
            then = np.where((i < self.starts.size) & (best < end), best, end - self.overlap)
        else:
            then = end - self.overlap
        last = self.size - at <= self.limit
        return np.where(last, self.size, end), np.where(last, -1, then)

    def entries(self, stop: int, first: bool) -> np.ndarray:
        """All places before ``stop`` where a piece may start: word starts, ``overlap`` before an end without one, 0 in the first range."""
        stop = max(0, min(stop, self.width))
        inside = self.starts[(self.starts >= 0) & (self.starts < stop)]
        free = np.arange(stop)
        free = free[~self._between(self.starts, free, free + self.overlap - 1)]
        end = free + self.overlap
        at_cut = self._between(self.cuts[0], end, end)
        forced = ~self._between(self.cuts[0], end - self.limit + self.least, end)
        return np.union1d(np.concatenate((inside, np.zeros(int(first), np.int64))), free[at_cut | forced])

    def leave(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first start beyond the range, counted from its end, or -1 if the text is done; pieces up to there) from each place."""
        at, n = at.astype(np.int64), np.zeros(at.size, np.int64)
        while (go := np.flatnonzero((at >= 0) & (at < self.width))).size:
            at[go] = self.step(at[go])[1]
            n[go] += 1
        return np.where(at < 0, -1, at - self.width), n

    def pieces(self, at: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces from ``at`` on that start in the range."""
        out = []
        while 0 <= at < self.width:
            end, then = (int(x[0]) for x in self.step(np.array([at])))
            out.append((at, end))
            at = then
        return out


# ---- tables and their stitching ------------------------------------------------------------------------------
# A table: (key, no, width, odd, at0, to0, n0, at1, to1, n1), the lists for an even or odd number of dollars before it.

_TABLE = "no long, width long, odd int, " + ", ".join(f"at{q} array<long>, to{q} array<long>, n{q} array<long>" for q in (0, 1))
_FIELDS = [x.split()[0] for x in _TABLE.split(", ")]


def follow(tables: list[dict], at: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where pieces that start at ``at`` have come to after consecutive tables, how many they were, and the dollars' parity."""
    at, n = at.astype(np.int64), np.zeros(at.size, np.int64)
    for t in tables:
        have = np.asarray(t[f"at{odd}"], np.int64)
        on = at >= t["width"]
        here = np.flatnonzero((at >= 0) & ~on)
        if here.size:
            i = np.searchsorted(have, at[here])
            n[here] += np.asarray(t[f"n{odd}"], np.int64)[i]
            at[here] = np.asarray(t[f"to{odd}"], np.int64)[i]
        at[on] -= t["width"]
        odd ^= t["odd"]
    return at, n, odd


def compose(tables: list[dict], limit: int) -> dict:
    """One table that stands for consecutive ones: its places are those of them that one piece from before may reach."""
    out = {"width": sum(t["width"] for t in tables)}
    for q in (0, 1):
        places, base, odd = [], 0, q
        for t in tables:
            have = np.asarray(t[f"at{odd}"], np.int64) + base
            places.append(have[have <= limit])
            base, odd = base + t["width"], odd ^ t["odd"]
            if base > limit:
                break
        at = np.concatenate(places)
        to, n, end = follow(tables, at, q)
        out |= {f"at{q}": at.tolist(), f"to{q}": to.tolist(), f"n{q}": n.tolist(), "odd": end ^ q}
    return out


def descend(tables: list[dict], at: int, odd: int, first: int, offset: int):
    """(place in ``tables``, entry, parity, pieces before, characters before) of those in which a piece starts."""
    for i, t in enumerate(tables):
        if at < 0:
            return
        if at < t["width"]:
            yield i, at, odd, first, offset
        there, n, odd = follow([t], np.array([at]), odd)
        at, first, offset = int(there[0]), first + int(n[0]), offset + t["width"]


def _grouped(tables: DataFrame) -> DataFrame:
    """(key, no, tables): runs of FAN consecutive tables, in order."""
    runs = tables.withColumn("run", F.floor(F.col("no") / FAN))
    return runs.groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("tables")).withColumnRenamed("run", "no")


def stitch(tables: DataFrame, limit: int, most: int) -> DataFrame:
    """(key, no, entry, parity, first, offset) of each range of a text in which a piece starts; ``most``: the largest ``no``."""

    def up(batches):
        for b in batches:
            made = [compose(x, limit) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([m[f] for m in made], pa.int32() if f == "odd" else pa.int64() if f == "width" else pa.list_(pa.int64())) for f in _FIELDS[1:])], names=["key", *_FIELDS])

    def down(batches):
        for b in batches:
            cols = ([], [], [], [], [], [])
            for key, no, tables, entry, odd, first, offset in zip(*(b.column(i).to_pylist() for i in range(7))):
                for i, *state in descend(tables, entry, odd, first, offset):
                    for c, x in zip(cols, (key, no * FAN + i, *state)):
                        c.append(x)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "no", "entry", "parity", "first", "offset"])

    levels = [_grouped(tables)]
    while most >= FAN:
        levels[-1] = materialize(levels[-1])
        levels.append(_grouped(levels[-1].mapInArrow(up, "key string, " + _TABLE)))
        most //= FAN
    zero = F.lit(0).cast("long")
    state = levels.pop().select("key", "no", "tables", zero.alias("entry"), F.lit(0).alias("parity"), zero.alias("first"), zero.alias("offset"))
    out = "key string, no long, entry long, parity int, first long, offset long"
    state = state.mapInArrow(down, out)
    while levels:
        known = levels.pop().join(state, ["key", "no"]).select("key", "no", "tables", "entry", "parity", "first", "offset")
        state = known.mapInArrow(down, out)
    return state


def _tabulate(cut: Cutter, limit: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = cut.entries(limit + 1, first)
    return (at, *cut.leave(at))


# ---- texts of a table ----------------------------------------------------------------------------------------


def text_range(cps: np.ndarray, at: int, width: int, odd: int, limit: int, least: int, overlap: int) -> Cutter:
    """The cutter of one range of a text that is at hand: halos of one piece, the left one longer where it is all white space."""
    lo = max(0, at - limit)
    while lo and np.isin(cps[lo : lo + limit], BLANK).all():
        lo = max(0, lo - limit)
    return Cutter(cps[lo : at + width + limit + 1], at - lo, min(width, cps.size - at), odd, limit, least, overlap)


def split_pieces(df: DataFrame, key: str = "chunk_id", text: str = "body_text", limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, width: int = RANGE) -> DataFrame:
    """(chunk_id, piece_no, piece_start, piece_end) of every text of more than ``limit`` characters.

    Offsets count characters from 0, ends exclusive. A piece takes all that is left if that is at most ``limit``. Else it
    ends at a word start ``least`` to ``limit`` characters after its start with an even number of ``$`` before it: the
    last one after an empty line, or after ``.``, ``!`` or ``?``, or of all, or exactly at ``limit``. The next piece
    starts at the first word start among the ``overlap`` characters before that end, or ``overlap`` before it. Shorter and
    null texts and null keys give no row. Repeated rows of a key count once (of several texts the least md5 counts).

    Texts are never shuffled: one pass turns each range of ``width`` characters into its table of starts, ends and next
    starts, and everything after it works on those.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.length(text).alias("size")).where(f"key IS NOT NULL AND size > {int(limit)}")
    rows = rows.select("key", F.md5(F.col("text").cast("binary")).alias("sig"), "text")

    def tabulate(batches):
        for batch in batches:
            for part in charfold.slices(batch, 2):
                cps, offs = charfold.code_points(part.column(2))
                row, cols, lists = [], ([], [], []), {f: [] for f in ("at0", "to0", "n0", "ends", "nexts")}
                for i in range(part.num_rows):
                    body = cps[offs[i] : offs[i + 1]]
                    begins = np.arange(0, body.size, width)
                    dollars = np.cumsum(np.add.reduceat(body == DOLLAR, begins, dtype=np.int64))
                    for no, at in enumerate(begins.tolist()):
                        cut = text_range(body, at, width, int(dollars[no - 1]) % 2 if no else 0, limit, least, overlap)
                        starts = cut.entries(width, no == 0)
                        ends, nexts = cut.step(starts)
                        row.append(i)
                        for c, x in zip(cols, (no, cut.width, cut.odd)):
                            c.append(x)
                        for f, x in zip(lists, (starts, *cut.leave(starts), ends, nexts)):
                            lists[f].append(x)
                packed = {f: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x or [np.zeros(0)]), pa.int32())) for f, x in lists.items()}
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(c, pa.int32()) for c in cols), *packed.values()], names=["key", "sig", "no", "width", "odd", *packed])

    schema = "key string, sig string, no int, width int, odd int, at0 array<int>, to0 array<int>, n0 array<int>, ends array<int>, nexts array<int>"
    made = materialize(rows.mapInArrow(tabulate, schema))
    pick = made.where("no = 0").groupBy("key").agg(F.min("sig").alias("sig"))
    known = made.join(pick, ["key", "sig"]).dropDuplicates(["key", "no"])
    # the dollars before each range are counted, so the parity is known and its own table enough; it stands in both places
    lists = [F.col(f"{f}0").cast("array<long>").alias(f"{f}{q}") for q in (0, 1) for f in ("at", "to", "n")]
    most = made.agg(F.max("no")).head()[0] or 0
    entries = stitch(known.select("key", F.col("no").cast("long").alias("no"), F.col("width").cast("long").alias("width"), "odd", *lists), limit, most)

    def emit(batches):
        for b in batches:
            cols = ([], [], [], [])
            for i, (no, width_, starts, ends, nexts, at, first, offset) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 9)))):
                place = dict(zip(starts, zip(ends, nexts)))
                for n in itertools.count(first + 1):
                    if not 0 <= at < width_:
                        break
                    end, then = place[at]
                    for c, x in zip(cols, (i, n, offset + at, offset + end)):
                        c.append(x)
                    at = then
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["chunk_id", "piece_no", "piece_start", "piece_end"])

    ready = known.join(entries, ["key", "no"]).select("key", "no", "width", F.col("at0").alias("starts"), "ends", "nexts", "entry", "first", "offset")
    return ready.mapInArrow(emit, "chunk_id string, piece_no int, piece_start int, piece_end int")


# ---- files ---------------------------------------------------------------------------------------------------


def file_range(path: str, begin: int, end: int, size: int, limit: int) -> tuple[np.ndarray, int, int]:
    """(code points with halos, characters before the range, characters in it) of the characters that start in a byte range.

    Reads the range and one piece's bytes on either side, further back only over white space. A character belongs to the
    range that holds its first byte.
    """
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")
    halo = 4 * (limit + 1)
    with fs.open_input_file(name) as f:
        lo, hi = max(0, begin - halo), min(size, end + halo)
        f.seek(lo)
        raw = f.read(hi - lo)
        while lo and not raw[: begin - lo].strip(b" \t\n\r\f"):
            back = min(lo, halo)
            f.seek(lo - back)
            raw, lo = f.read(back) + raw, lo - back
    data = np.frombuffer(raw, np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    a, b = np.searchsorted(first, (begin - lo, end - lo))
    stop = data.size if hi == size else first[-1]  # the last character may be cut off
    raw = raw[first[0] : stop] if first.size else b""
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32), int(a), int(b - a)


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, width: int = FILE_RANGE) -> DataFrame:
    """(path, piece_no, piece_start, piece_end) of every UTF-8 file under ``path`` of more than ``limit`` characters.

    The rule is that of ``split_pieces``. Workers read byte ranges of ``width`` bytes with their halos, twice: for the
    tables, and to emit pieces; no file is read whole anywhere. A file of fewer characters or none has no row. Files must be
    valid UTF-8 (a wrong byte counts as one character if it stands alone).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    number = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / width))
    ranges = files.where("size > 0").select("path", "size", F.explode(number).alias("no"))
    most = ranges.agg(F.max("no")).head()[0] or 0
    ranges = ranges.repartition(max(1, min(most + 1, 10_000)), "path", "no")

    def tabulate(batches):
        for b in batches:
            for name, size, no in zip(*(c.to_pylist() for c in b.columns)):
                cps, lead, own = file_range(name, no * width, min(size, (no + 1) * width), size, limit)
                got = []
                for odd in (0, 1):
                    cut = Cutter(cps, lead, own, odd, limit, least, overlap)
                    got += _tabulate(cut, limit, no == 0)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([no], pa.int64()), pa.array([own], pa.int64()), pa.array([cut.odd], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in got)], names=["key", *_FIELDS])

    tables = materialize(ranges.mapInArrow(tabulate, "key string, " + _TABLE))
    long = tables.groupBy("key").agg(F.sum("width").alias("w")).where(F.col("w") > limit).select("key")
    entries = stitch(tables.join(long, "key"), limit, most)

    def emit(batches):
        for b in batches:
            for name, size, no, at, odd, n, offset in zip(*(c.to_pylist() for c in b.columns)):
                cps, lead, own = file_range(name, no * width, min(size, (no + 1) * width), size, limit)
                found = np.array(Cutter(cps, lead, own, odd, limit, least, overlap).pieces(at), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(np.arange(len(found)) + n + 1), pa.array(found[:, 0] + offset), pa.array(found[:, 1] + offset)], names=["path", "piece_no", "piece_start", "piece_end"])

    found = ranges.withColumnRenamed("path", "key").join(entries, ["key", "no"]).select("key", "size", "no", "entry", "parity", "first", "offset")
    return found.mapInArrow(emit, "path string, piece_no long, piece_start long, piece_end long")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    # ``truncated`` may be null, which is not true
    return split_pieces(spark.read.parquet(f"{sf}/chunks.parquet").where("truncated IS NOT TRUE"))


QUERIES = {"p4_found": p4_found}
