"""Registered queries of the engine and their SQL twins."""

from __future__ import annotations

from . import corpus, editing, editions, layout, search

MODULES = [search, corpus, layout, editing, editions]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
