"""Registered queries: each module has QUERIES (name to function of session and folder) and SQL (name to DuckDB text)."""

from __future__ import annotations

from importlib import import_module

#: Modules in the order in which their queries are registered.
MODULES = ("data_quality", "survey", "stats", "feeds", "relational", "composites", "further", "reports", "cells")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"loomway.queries.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
