"""Equation trees: MathML to a canonical tree, its JSON, its size, and tree edit distance."""

from __future__ import annotations

import json
import unicodedata
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Invisible operators, and elements that repeat the formula in another notation.
INVISIBLE = {"\u2061", "\u2062", "\u2063", "\u2064"}
ANNOTATIONS = {"annotation", "annotation-xml"}


def _leaf(text: str | None) -> list:
    t = unicodedata.normalize("NFKC", (text or "").strip())
    return [(t, [])] if t and t not in INVISIBLE else []


def _build(el) -> tuple | None:
    tag = el.tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower()
    if tag in ANNOTATIONS:
        return None
    if tag == "semantics":
        return next((n for n in map(_build, el) if n is not None), None)
    kids = _leaf(el.text)
    if tag == "mo" and not len(el) and not kids and (el.text or "").strip():
        return None
    for child in el:
        node = _build(child)
        kids += ([node] if node is not None else []) + _leaf(child.tail)
    return kids[0] if tag == "mrow" and len(kids) == 1 else (tag, kids)


def parse(mathml: str | None) -> tuple | None:
    """(label, children) of a formula: local lower-case tags, no attributes, text as leaves in compatibility form.

    Annotations and invisible operators are left out, ``semantics`` is its first remaining child, an ``mrow`` of one child
    is that child. None for what is no XML, declares entities, or leaves nothing.
    """
    if not isinstance(mathml, str) or not mathml.strip() or "<!ENTITY" in mathml or "<!DOCTYPE" in mathml:
        return None
    try:
        return _build(ET.fromstring(mathml))
    except (ET.ParseError, RecursionError):
        return None


def to_json(tree: tuple) -> str:
    return json.dumps(_plain(tree), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _plain(t):
    return {"label": t[0], "children": [_plain(c) for c in t[1]]}


def from_json(raw: str | None) -> tuple | None:
    try:
        return _tuple(json.loads(raw)) if raw else None
    except (ValueError, KeyError, TypeError, RecursionError):
        return None


def _tuple(d):
    return (str(d["label"]), [_tuple(c) for c in d["children"]])


def size(tree: tuple) -> int:
    n, stack = 0, [tree]
    while stack:
        n += 1
        stack += stack.pop()[1]
    return n


def _postorder(tree: tuple) -> tuple[list[str], list[int], list[int]]:
    """Labels in post-order, the left-most leaf below each, and the key roots."""
    labels, left, stack = [], [], [(tree, iter(tree[1]), None)]
    while stack:
        node, kids, first = stack[-1]
        child = next(kids, None)
        if child is not None:
            stack.append((child, iter(child[1]), None))
            continue
        stack.pop()
        at = len(labels)
        labels.append(node[0])
        left.append(at if first is None else first)
        if stack:
            above = stack[-1]
            if above[2] is None:
                stack[-1] = (above[0], above[1], left[at])
    last = {x: i for i, x in enumerate(left)}
    return labels, left, sorted(last.values())


def edit_distance(a: tuple, b: tuple) -> int:
    """Least number of nodes to insert, delete or relabel (Zhang and Shasha's algorithm on ordered trees)."""
    la, fa, ka = _postorder(a)
    lb, fb, kb = _postorder(b)
    d = [[0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            oi, oj = fa[i], fb[j]
            forest = [[0] * (j - oj + 2) for _ in range(i - oi + 2)]
            for x in range(1, i - oi + 2):
                forest[x][0] = x
            forest[0] = list(range(j - oj + 2))
            for x in range(1, i - oi + 2):
                p, row, above = oi + x - 1, forest[x], forest[x - 1]
                for y in range(1, j - oj + 2):
                    q = oj + y - 1
                    cost = min(above[y], row[y - 1]) + 1
                    if fa[p] == oi and fb[q] == oj:
                        cost = min(cost, above[y - 1] + (la[p] != lb[q]))
                        d[p][q] = cost
                    else:
                        cost = min(cost, forest[fa[p] - oi][fb[q] - oj] + d[p][q])
                    row[y] = cost
    return d[-1][-1]


def normalized(a: tuple, b: tuple) -> float:
    """Distance over the size of the larger tree, from 0 to 1."""
    return min(1.0, edit_distance(a, b) / max(size(a), size(b)))


@F.pandas_udf(T.StringType())
def tree_json(s: pd.Series) -> pd.Series:
    """Canonical tree of MathML as compact JSON with sorted keys; null where there is none."""
    trees = s.map(parse, na_action="ignore")
    return trees.map(lambda t: to_json(t) if isinstance(t, tuple) else None)


@F.pandas_udf(T.IntegerType())
def tree_size(s: pd.Series) -> pd.Series:
    return s.map(lambda x: size(t) if (t := from_json(x)) is not None else None).astype("Int32")


@F.pandas_udf(T.DoubleType())
def tree_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalised distance of two tree columns; 1 where either is missing or unreadable."""
    out = []
    for x, y in zip(a, b):
        s, t = from_json(x), from_json(y)
        out.append(1.0 if s is None or t is None else normalized(s, t))
    return pd.Series(out, dtype="float64")


def looks_like_mathml(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(<\?xml[^>]*>\s*)?<(\w+:)?math\b")


def fuse(distance: Column, cosine: Column, alpha: float = 0.5) -> Column:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    return alpha * (1 - distance) + (1 - alpha) * cosine
