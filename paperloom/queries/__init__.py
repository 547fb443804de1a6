"""Registry of the core queries and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packed", "traffic", "invoices", "pages", "blocks", "streams", "files", "extraction")


def registry() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"paperloom.queries.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
