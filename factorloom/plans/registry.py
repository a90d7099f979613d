"""The registered queries over the driver's tables and the same queries as DuckDB SQL."""

from __future__ import annotations

from . import base_queries, factor_queries, stat_queries

PARTS = (base_queries, factor_queries, stat_queries)


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.QUERIES.items()}


def oracles() -> dict:
    return {k: v for p in PARTS for k, v in p.ORACLES.items()}
