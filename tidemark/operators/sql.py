"""A typed SQL builder: conditions, nested children, keyset pages, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import RangeError


class Undefined:
    """A condition that was never given; using it is an error, not the lack of a filter."""


UNDEFINED = Undefined()


def where(conditions: dict) -> Column:
    """Equality; None is IS NULL; a list is IN; an empty list finds nothing; UNDEFINED is refused."""
    if not conditions:
        raise RangeError("no condition")
    parts = []
    for name, v in conditions.items():
        if v is UNDEFINED:
            raise RangeError(f"the condition for {name!r} is undefined")
        c = F.col(name)
        parts.append(c.isNull() if v is None else (c.isin(list(v)) if v else F.lit(False)) if isinstance(v, list | tuple | set) else c == v)
    return all_of(*parts)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def include(parents: DataFrame, children: DataFrame, on: tuple[str, str], order: list[Column], limit: int, fields: list[str], name: str) -> DataFrame:
    """Each parent with its first ``limit`` children as JSON text in ``name``; parents without children have ``[]``."""
    key, fk = on
    ranked = children.withColumn("_rn", F.row_number().over(Window.partitionBy(fk).orderBy(*order))).where(F.col("_rn") <= limit)
    packed = ranked.groupBy(F.col(fk).alias("_fk")).agg(F.array_sort(F.collect_list(F.struct("_rn", *fields))).alias("_c"))
    text = F.to_json(F.transform("_c", lambda c: F.struct(*(c[f].alias(f) for f in fields))))
    return parents.join(packed, parents[key] == F.col("_fk"), "left").withColumn(name, F.coalesce(text, F.lit("[]"))).drop("_fk", "_c")


def after(order: list[tuple[str, bool]], values: list) -> Column:
    """Rows past a keyset cursor; ``order``: (column, descending), ending in a unique column."""
    if len(order) != len(values):
        raise RangeError("the cursor is of another query")
    out, same = F.lit(False), F.lit(True)
    for (name, down), v in zip(order, values, strict=True):
        c = F.col(name)
        out = out | (same & ((c < v) if down else (c > v)))
        same = same & (c == v)
    return out


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, cursor: list | None = None) -> DataFrame:
    df = df if cursor is None else df.where(after(order, cursor))
    return df.orderBy(*(F.desc(n) if down else F.asc(n) for n, down in order)).limit(limit)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: rows whose keys change are replaced, new ones added."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def one(df: DataFrame):
    """The only row, or None; two rows are an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise RangeError("more than one row")
    return rows[0] if rows else None


def checked(df: DataFrame, cap: int) -> DataFrame:
    """At most ``cap + 1`` rows, by which a receiver sees that the answer is cut."""
    return df.limit(cap + 1)
