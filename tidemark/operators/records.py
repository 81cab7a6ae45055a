"""Events: conditions, search, pages, aggregates, and lines of other programs' logs.

Events are a DataFrame (us long, seq long, stream, name, level, message, fields string JSON, context string JSON,
trace_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.ranges import RangeError, bucket

# Levels in order.
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]


def level_number(level: Column) -> Column:
    """1 to 6, null for no or an unknown level."""
    n = F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(level))
    return F.when(n > 0, n)


def at_least(level: Column, least: str) -> Column:
    """Events without a level are not found."""
    if least not in LEVELS:
        raise RangeError(f"no level {least!r}")
    return F.coalesce(level_number(level) >= LEVELS.index(least) + 1, F.lit(False))


def raw_token(json: Column, key: str) -> Column:
    """A top-level value of a flat JSON object as it is spelled: ``42``, ``"42"`` and ``42.0`` differ."""
    quoted = key.replace("\\", "\\\\").replace('"', '\\"')
    import re

    return F.nullif(F.regexp_extract(json, r'[{,]\s*"' + re.escape(quoted) + r'"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}\s]+)', 1), F.lit(""))


def spelled(key: str, value: str, *maps: Column) -> Column:
    """Whether one of the JSON objects holds ``key`` with that spelling."""
    out = F.lit(False)
    for m in maps:
        out = out | F.coalesce(raw_token(m, key) == value, F.lit(False))
    return out


def json_values(json: Column) -> Column:
    """Text of the values of a JSON object at any depth, without keys."""
    return F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"\s*:', " "), r'[{}\[\],"]', " ")


def contains(phrase: str, *texts: Column) -> Column:
    if not phrase:
        raise RangeError("an empty phrase finds everything")
    return F.contains(F.lower(F.concat_ws("\n", *texts)), F.lit(phrase.lower()))


def page(events: DataFrame, limit: int, newest: bool = True) -> DataFrame:
    """The first ``limit`` events by time and write order; a time that the limit would split is left to the next page.

    ``limit + 1`` rows are taken first, so the ranking sees no more than that many.
    """
    order = [F.desc("us"), F.desc("seq")] if newest else [F.asc("us"), F.asc("seq")]
    some = events.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)  # over limit + 1 rows
    ranked = some.withColumn("_rn", F.row_number().over(w))
    edge = F.max(F.when(F.col("_rn") == limit + 1, F.col("us"))).over(Window.partitionBy(F.lit(0)))
    return ranked.withColumn("_edge", edge).where((F.col("_rn") <= limit) & (F.col("_edge").isNull() | (F.col("us") != F.col("_edge")))).drop("_rn", "_edge")


def top(events: DataFrame, value: Column, limit: int = 10) -> DataFrame:
    """Most frequent values; ties by the value."""
    if not 0 < limit <= 1000:
        raise RangeError("between 1 and 1000 values")
    return events.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null").orderBy(F.desc("n"), "value").limit(limit)


def aggregate(events: DataFrame, every: int | None, by: list[str], stats: dict[str, Column] | None = None, distinct: dict[str, Column] | None = None) -> DataFrame:
    """A row per span and keys: count, statistics over numeric values, numbers of different values. Sums are exact."""
    keys = ([bucket(F.col("us"), every).alias("at_us")] if every else []) + [F.col(b) for b in by]
    names = ["at_us"] * bool(every) + by
    values = {n: c.cast("double").alias(f"_s_{n}") for n, c in (stats or {}).items()}
    rows = events.select(*keys, *values.values(), *(c.alias(f"_d_{n}") for n, c in (distinct or {}).items()))
    others = {"n": (F.count(F.lit(1)), "sum")}
    for n in values:
        v = F.col(f"_s_{n}")
        others |= {f"{n}_samples": (F.count(v), "sum"), f"{n}_min": (F.min(v), "min"), f"{n}_max": (F.max(v), "max")}
    if values:
        out = exact.sums(rows, names, {f"{n}_sum": [F.col(f"_s_{n}")] for n in values}, others)
        out = out.withColumns({f"{n}_avg": F.round(F.col(f"{n}_sum") / F.nullif(f"{n}_samples", F.lit(0)), 6) for n in values})
        out = out.select(*names, "n", *(f"{n}_{x}" for n in values for x in ("samples", "sum", "min", "max", "avg")))
    else:
        out = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(f"_d_{n}").alias(f"{n}_distinct") for n in distinct or {}))
    if values and distinct:
        few = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in names)).agg(*(F.count_distinct(f"_d_{n}").alias(f"{n}_distinct") for n in distinct))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names), F.lit(True))
        out = out.join(few, same).drop(*(f"_{k}" for k in names))
    return out


def field_names(events: DataFrame, json: str) -> DataFrame:
    return events.select(F.explode(F.json_object_keys(json)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def missed(seen: DataFrame, stream: str = "stream") -> DataFrame:
    """How many events a lossy reader did not see before each that it saw, by gaps of the sequence."""
    gap = F.col("seq") - F.lag("seq").over(Window.partitionBy(stream).orderBy("seq")) - 1
    return seen.withColumn("missed", F.coalesce(gap, F.lit(0)))


def poll(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next events after a cursor, complete and in order."""
    return events.where(F.col("seq") > cursor).orderBy("seq").limit(limit)


#: A line that goes on with the event before it: white space, a closing bracket, or what stack traces repeat.
CONTINUES = r"^(\s|[}\])]|at |Caused by:|\.\.\. \d+ more|Traceback \(most)"


def multi_line(lines: DataFrame, keys: list[str], order: str, text: str = "line") -> DataFrame:
    """Lines joined to events: a running sum of the lines that begin one."""
    w = Window.partitionBy(*keys).orderBy(order)
    begins = (~F.col(text).rlike(CONTINUES)).cast("int")
    numbered = lines.withColumn("event", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return numbered.groupBy(*keys, "event").agg(F.count(F.lit(1)).alias("lines"), F.min(order).alias("first"), joined.alias("body"))


def detect_level(line: Column) -> Column:
    """The level of a line: JSON numbers or names, key=value, a leading letter, or the bare word."""
    number = F.nullif(F.regexp_extract(line, r'"level"\s*:\s*(\d+)', 1), F.lit("")).cast("int")
    named = F.lower(F.regexp_extract(line, r'(?i)(?:"?\b(?:level|lvl|severity)"?\s*[:=]\s*"?)([a-z]+)', 1))
    letter = F.regexp_extract(line, r"^([IWEFD])\d{4} ", 1)
    word = F.lower(F.regexp_extract(line, r"\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL|PANIC|LOG)\b", 1))
    found = F.when(named != "", named).when(letter != "", letter).otherwise(word)
    same = F.create_map(*[F.lit(x) for x in ("trace", "trace", "debug", "debug", "d", "debug", "info", "info", "i", "info", "notice", "info", "log", "info", "warn", "warn", "w", "warn", "warning", "warn", "error", "error", "e", "error", "err", "error", "fatal", "fatal", "f", "fatal", "critical", "fatal", "panic", "fatal")])
    by_number = F.when(number >= 60, "fatal").when(number >= 50, "error").when(number >= 40, "warn").when(number >= 30, "info").when(number >= 20, "debug").otherwise("trace")
    return F.when(number.isNotNull(), by_number).otherwise(F.try_element_at(same, F.lower(found)))


def logfmt(line: Column) -> Column:
    """key=value pairs as a map; quoted values may hold spaces."""
    pairs = F.regexp_extract_all(line, F.lit(r'[A-Za-z_][\w.]*=(?:"(?:[^"\\]|\\.)*"|[^\s"]*)'), F.lit(0))
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.regexp_extract(p, "(?s)=(.*)$", 1), '^"|"$', "").alias("value"))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, entry)))


SECRET = r"(?i)(password|passwd|secret|token|api_?key|authorization|cookie)"


def redact(json: Column) -> Column:
    """Values of secret keys at any depth of a flat spelling, and passwords in URLs."""
    keyed = F.regexp_replace(json, r'("[^"]*' + SECRET + r'[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}\]\s]+)', '$1"[redacted]"')
    return F.regexp_replace(keyed, r"://([^:/@\s]+):[^@/\s]+@", "://$1:[redacted]@")


def lines_of(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, no, line) of every line."""
    return texts.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))


def lines_with(texts: DataFrame, id_col: str, phrases: list[str], text_col: str = "text") -> DataFrame:
    """Lines that hold any of some phrases; only texts that hold one are cut into lines."""
    held = lambda c: reduce(lambda a, b: a | b, (contains(p, c) for p in phrases))
    return lines_of(texts.where(held(F.col(text_col))), id_col, text_col).where(held(F.col("line")))


def flatten_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, json) -> (id, path, value): every leaf of nested JSON, for searches at any depth."""
    import json

    def walk(path: str, x) -> Iterator[tuple[str, str]]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(f"{path}.{k}" if path else k, v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(f"{path}[]", v)
        else:
            yield path, x if isinstance(x, str) else json.dumps(x)

    for pdf in batches:
        out = [(i, p, v) for i, t in zip(pdf["id"], pdf["json"], strict=True) for p, v in walk("", json.loads(t))]
        yield pd.DataFrame(out, columns=["id", "path", "value"], dtype=object).astype({"id": "int64"})
