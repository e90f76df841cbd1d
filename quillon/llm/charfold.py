"""One character form for text that looks the same (problem 2), computed on whole Arrow columns.

The text of an Arrow string array is copied once into a numpy array of code points. Folding is a gather
from lookup tables with expansion offsets; combining marks are then reordered and composed on the whole
array. No string method is called per row.

The form: full-width and half-width characters become ordinary ones, every kind of space becomes U+0020
(line breaks and tabs stay), characters without width vanish, Cyrillic and Greek letters that have the
shape of a Latin letter become that letter, accents are composed (NFC). Null stays null, empty stays empty.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Cyrillic and Greek letters with the shape of a Latin letter, and the Latin letters.
SHAPES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
# Characters without width, as ranges of code points.
NO_WIDTH = [(0xAD, 0xAD), (0x34F, 0x34F), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
            (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
# Kinds of space that become U+0020.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
TOP = 0x110000
SLICE_BYTES = 1_000_000
#: Hangul syllables are composed by rule: first code points and counts of the three jamo sets.
HANGUL, JAMO_L, JAMO_V, JAMO_T = 0xAC00, 0x1100, 0x1161, 0x11A7


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point: replacement (first, rest), combining class, pair composition, lower case, word flag."""
    first, count = np.arange(TOP, dtype=np.uint32), np.ones(TOP, dtype=np.uint8)
    start, flat = np.zeros(TOP, dtype=np.int32), []
    ccc = np.zeros(TOP, dtype=np.uint8)
    shape = {ord(k): ord(v) for k, v in SHAPES.items()}
    pairs = {}
    lower, word = np.arange(TOP, dtype=np.uint32), np.zeros(TOP, dtype=bool)

    def spread(cp: int) -> list[int]:
        if HANGUL <= cp < HANGUL + 11172:
            return [cp]
        kind, _, rest = unicodedata.decomposition(chr(cp)).rpartition(">")
        if rest and kind in ("", "<wide", "<narrow"):
            return [y for x in rest.split() for y in spread(int(x, 16))]
        return [shape.get(cp, cp)]

    for cp in [*range(0x80), *range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]:
        ch = chr(cp)
        c = unicodedata.combining(ch)
        if c:
            ccc[cp] = c
        if (low := ch.lower()) != ch and len(low) == 1:
            lower[cp] = ord(low)
        word[cp] = ch.isalnum()
        out = spread(cp)
        if out != [cp]:
            first[cp], count[cp] = out[0], len(out)
            if len(out) > 1:
                start[cp] = len(flat)
                flat += out
        if cp >= 0x80 and (d := unicodedata.decomposition(ch)) and d[0] != "<" and " " in d:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                pairs[(a << 21) | b] = cp
    word[0x20000:0x32000] = True
    for ch in SPACES:
        first[ord(ch)], count[ord(ch)] = 32, 1
    for lo, hi in NO_WIDTH:
        count[lo : hi + 1] = 0
    # A mapped base letter composes like the Latin letter it became: those pairs are in the table already.
    keys = np.array(sorted(pairs), dtype=np.int64)
    second = np.zeros(TOP, dtype=bool)
    second[[k & 0x1FFFFF for k in pairs]] = True
    second[JAMO_V : JAMO_V + 21] = second[JAMO_T + 1 : JAMO_T + 28] = True
    return {"first": first, "count": count, "start": start, "flat": np.array(flat or [0], dtype=np.uint32), "ccc": ccc,
            "keys": keys, "values": np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32), "second": second,
            "lower": lower, "word": word}


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows in one array, and the offsets of the rows in it. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    if not data.size:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    seen = np.zeros(data.size + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), seen[offs - offs[0]]


def to_strings(cps: np.ndarray, offs: np.ndarray) -> pa.Array:
    """The inverse of code_points: one string array over one copy of the bytes."""
    size = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
    ends = np.zeros(cps.size + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    data = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends[offs].astype(np.int64).tobytes()), pa.py_buffer(data))


def _pair(a: np.ndarray, b: np.ndarray, t: dict) -> np.ndarray:
    """The composed character of each pair, 0 where there is none."""
    key = (a.astype(np.int64) << 21) | b
    at = np.minimum(np.searchsorted(t["keys"], key), t["keys"].size - 1)
    out = np.where(t["keys"][at] == key, t["values"][at], 0).astype(np.int64)
    lead, vowel = a.astype(np.int64) - JAMO_L, b.astype(np.int64) - JAMO_V
    out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), HANGUL + (lead * 21 + vowel) * 28, out)
    tail, syl = b.astype(np.int64) - JAMO_T, a.astype(np.int64) - HANGUL
    return np.where((syl >= 0) & (syl < 11172) & (syl % 28 == 0) & (tail > 0) & (tail < 28), a + tail, out)


def compose(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of the marks of all rows at once."""
    t = tables()
    if not (t["second"][cps] | (t["ccc"][cps] > 0)).any():
        return cps, offs
    cps = cps.copy()
    row_start = np.zeros(cps.size + 1, bool)
    row_start[offs[:-1]] = True
    row_start = row_start[:-1]
    ccc = t["ccc"][cps].astype(np.int64)
    marks = np.flatnonzero(ccc)
    if marks.size:
        runs = np.cumsum((ccc == 0) | row_start)[marks]
        cps[marks] = cps[marks][np.lexsort((ccc[marks], runs))]
        ccc = t["ccc"][cps].astype(np.int64)
    alive = np.ones(cps.size, bool)
    while True:
        live = np.flatnonzero(alive)
        c, k, head = cps[live], ccc[live], row_start[live].copy()
        # the head of a row may itself have been composed away only if it was a second character, which a head never is
        here = np.arange(live.size)
        starter = np.maximum.accumulate(np.where((k == 0) | head, here, 0))
        # a composable character that is itself no mark belongs to the character just before it
        adjacent = (k == 0) & t["second"][c] & ~head & (here > 0)
        base = np.where(adjacent, here - 1, starter)
        prev = np.concatenate(([0], k[:-1]))
        open_ = adjacent & (prev == 0) | (k > 0) & ~head & (base < here) & (k[base] == 0) & ((base == here - 1) | (prev < k) & (prev > 0))
        at = np.flatnonzero(open_ & t["second"][c])
        made = _pair(c[base[at]], c[at], t) if at.size else at
        at, made = at[made > 0], made[made > 0]
        if not at.size:
            break
        # the first of each base only; one that is itself a base now waits for the next pass
        _, one = np.unique(base[at], return_index=True)
        at, made = at[one], made[one]
        wait = np.isin(base[at], at)
        at, made = at[~wait], made[~wait]
        cps[live[base[at]]] = made
        alive[live[at]] = False
    kept = np.zeros(cps.size + 1, np.int64)
    np.cumsum(alive, out=kept[1:])
    return cps[alive], kept[offs]


def fold(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Look-up, expansion, composition: the one form of every row."""
    t = tables()
    if not cps.size or int(cps.max()) < 0x80:
        return cps, offs
    n = t["count"][cps]
    if (n == 1).all():
        return compose(t["first"][cps], offs)
    to = np.zeros(cps.size + 1, np.int64)
    np.cumsum(n, out=to[1:])
    out = np.repeat(t["first"][cps], n)
    wide = np.flatnonzero(n > 1)
    if wide.size:
        many = n[wide].astype(np.int64)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(to[wide], many) + step] = t["flat"][np.repeat(t["start"][cps[wide]], many) + step]
    return compose(out, to[offs])


def slices(batch: pa.RecordBatch, column: int | str):
    """Pieces of a batch of about SLICE_BYTES of text each (one row at least), so memory stays level."""
    texts = batch.column(column)
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def fold_strings(texts: pa.Array) -> pa.Array:
    """The one form of an Arrow string array; null stays null."""
    out = to_strings(*fold(*code_points(texts)))
    return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.large_string())) if texts.null_count else out
