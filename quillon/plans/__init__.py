"""Named queries over the test tables and their oracle SQL, gathered from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil


def _gathered(what: str) -> dict:
    out: dict = {}
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        out |= getattr(importlib.import_module(f"{__name__}.{m.name}"), what, {})
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE_SQL")
