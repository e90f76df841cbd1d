"""Words of whole Arrow columns as 64-bit hashes.

A word is a longest run of letters or digits, without regard to case, in the one character form of problem 2.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from quillon.llm import charfold


class Words(NamedTuple):
    """hashes: of all words of all rows; offs: row i has hashes[offs[i]:offs[i + 1]]."""

    hashes: np.ndarray
    offs: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 step)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> Words:
    """The words of each row, in order. Null and empty rows have none."""
    t = charfold.tables()
    cps, offs = charfold.fold(*charfold.code_points(texts))
    if not cps.size:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    cps = t["lower"][cps]
    inside = t["word"][cps]
    row_start = np.zeros(cps.size + 1, bool)
    row_start[offs[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | row_start[1:-1]
    at = np.flatnonzero(begin)
    if not at.size:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, at)
    size = np.diff(np.append(first, where.size))
    place = np.arange(where.size) - np.repeat(first, size)
    keys = mix(np.arange(int(size.max()), dtype=np.uint64)) | np.uint64(1)
    sums = np.add.reduceat((cps[where].astype(np.uint64) + np.uint64(1)) * keys[place], first)
    return Words(mix(sums ^ size.astype(np.uint64)), np.searchsorted(at, offs).astype(np.int64))


def shingles(w: Words, size: int) -> Words:
    """Hashes of the runs of ``size`` consecutive words of each row, repeats included."""
    n, count = w.hashes.size, np.maximum(np.diff(w.offs) - size + 1, 0)
    offs = np.concatenate(([0], np.cumsum(count)))
    if not offs[-1]:
        return Words(np.zeros(0, np.uint64), offs)
    whole = n - size + 1
    out = np.zeros(whole, np.uint64)
    for k in range(size):
        out = mix(out ^ w.hashes[k : k + whole]) if k else w.hashes[:whole]
    at = np.repeat(w.offs[:-1] - offs[:-1], count) + np.arange(offs[-1])
    return Words(out[at], offs)


def rows(w: Words, which: np.ndarray) -> Words:
    """The words of some rows only."""
    n = np.diff(w.offs)[which]
    offs = np.concatenate(([0], np.cumsum(n)))
    return Words(w.hashes[np.repeat(w.offs[which] - offs[:-1], n) + np.arange(offs[-1])], offs)


def distinct(w: Words) -> Words:
    """Each row's hashes sorted and without repeats."""
    row = np.repeat(np.arange(len(w.offs) - 1), np.diff(w.offs))
    order = np.lexsort((w.hashes, row))
    h, row = w.hashes[order], row[order]
    keep = np.ones(h.size, bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return Words(h[keep], np.searchsorted(row[keep], np.arange(len(w.offs))))
