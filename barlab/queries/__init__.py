"""Registered queries: operators bound to the test tables, and the same results in SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE_SQL.
MODULES = ("bars", "windows", "folds", "outcomes", "statistics", "performance", "scoring", "text", "universe", "detectors", "pattern_sql", "session_sql", "streams", "path_sql")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"barlab.queries.{name}"), what))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE_SQL")
