"""All registered queries and their SQL, gathered from the modules of :mod:`skyloom.plans`."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``, with its DuckDB SQL if there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
