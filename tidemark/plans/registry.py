"""Named queries over the bundled tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, longs: str = ""):
    """Register a function ``q_*(spark, sf_dir)`` by its name. ``longs``: columns that the SQL would make wider."""
    if sql is not None and longs:
        sql = f"select * replace ({', '.join(f'{c}::bigint as {c}' for c in longs.split())}) from ({sql})"

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add
