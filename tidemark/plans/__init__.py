"""The registered queries of the engine's own operators."""

from __future__ import annotations

from . import metric_queries, record_queries, search_queries, see_queries, source_queries, sql_queries, state_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
