"""Operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["lookalike", "encode", "leak", "pieces", "names", "neardup", "neighbours", "scan", "sentences"]


def _gathered(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{name}"), what, {})
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE_SQL")
