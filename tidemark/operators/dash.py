"""Dashboards: which instances a read runs on, typed parameters, messages of branches, how to draw a frame."""

from __future__ import annotations

import datetime as dt
import decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import RangeError


def selector(text: str, variables: dict[str, list[str]] | None = None, labels: str = "labels", name: str = "name") -> Column:
    """``site=kazan, env=prod``, ``site=@site``, ``name=pg-msk`` or ``all``; an empty selector is refused."""
    text = (text or "").strip()
    if not text:
        raise RangeError("an empty selector; write all")
    if text == "all":
        return F.lit(True)
    parts = []
    for part in text.split(","):
        key, eq, value = (x.strip() for x in part.partition("="))
        if not eq or not key or not value:
            raise RangeError(f"not a condition: {part!r}")
        if value.startswith("@"):
            if value[1:] not in (variables or {}):
                raise RangeError(f"no variable {value}")
            values = variables[value[1:]]
        else:
            values = [value]
        c = F.col(name) if key == "name" else F.col(labels)[key]
        parts.append(F.coalesce(c.isin(values), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def chosen(instances: DataFrame, text: str, variables: dict[str, list[str]] | None = None) -> DataFrame:
    """The instances of a selector; one that matches nothing says so."""
    out = instances.where(selector(text, variables))
    if out.isEmpty():
        raise RangeError(f"no instance matches {text}")
    return out


KINDS = {"text": str, "int": int, "float": float, "decimal": decimal.Decimal, "time": dt.datetime, "date": dt.date, "bool": bool}


def parameters(declared: dict[str, dict], given: dict) -> dict:
    """Values of declared, typed parameters for ``spark.sql(args=...)``: defaults filled, unknown names and wrong types
    refused; a value is never spliced into text."""
    if set(given) - set(declared):
        raise RangeError(f"unknown parameters {sorted(set(given) - set(declared))}")
    out = {}
    for name, d in declared.items():
        if name not in given and "default" not in d and not d.get("nullable"):
            raise RangeError(f"{name} is not given")
        v = given.get(name, d.get("default"))
        if v is None and not d.get("nullable"):
            raise RangeError(f"{name} is null")
        kind = KINDS[d["type"]]
        for x in v if d.get("list") and v is not None else [v]:
            if x is not None and (not isinstance(x, kind) or (kind in (int, float) and isinstance(x, bool))):
                raise RangeError(f"{name} is not {d['type']}")
        out[name] = v
    return out


def heard(messages: DataFrame, branch: list[str], recursive: bool = False) -> DataFrame:
    """Messages of ``branch array<string>`` that a subscription hears: its own branch, or all below it too."""
    own = F.array(*map(F.lit, branch)) if branch else F.array().cast("array<string>")
    return messages.where(F.slice("branch", 1, len(branch)) == own if recursive and branch else F.lit(True) if recursive else F.col("branch") == own)


# How what a store says of a series is shown.
KNOWN = {"gauge": "average", "counter": "rate", "histogram": "p95", "stream": "count per hour"}


def known_panels(sources: DataFrame) -> DataFrame:
    """Panels of sources that say what they are: (source, title, panel, guessed = false). sources(name, kind)."""
    panel = F.element_at(F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv)), F.col("kind"))
    return sources.select(F.col("name").alias("source"), F.col("name").alias("title"), panel.alias("panel"), F.lit(False).alias("guessed")).where("panel is not null")


def guessed_panels(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Panels of a table that says nothing but types: times are rows per day, numbers that are no keys sums; marked as
    guessed, and titled by the column's name, never by a meaning."""
    rows = [(table, c, "rows per day" if t.startswith(("timestamp", "date")) else "sum", True) for c, t in df.dtypes if t.startswith(("timestamp", "date", "decimal")) or (t in ("int", "bigint", "smallint", "float", "double") and c not in keys)]
    return df.sparkSession.createDataFrame(rows, "source string, title string, panel string, guessed boolean")


def confirmed(panels: DataFrame, meanings: DataFrame) -> DataFrame:
    """Panels with the titles that people confirmed; these are known from then on. meanings(source, title, meaning)."""
    out = panels.join(F.broadcast(meanings), ["source", "title"], "left")
    return out.select("source", F.coalesce("meaning", "title").alias("title"), "panel", (F.col("guessed") & F.col("meaning").isNull()).alias("guessed"))


def repeated(frame: DataFrame, variable: str, values: list | None = None) -> DataFrame:
    """A panel per value of a variable: the frame's rows with the name of their panel, in one plan for all panels."""
    rows = frame if values is None else frame.where(F.col(variable).isin(values))
    return rows.withColumn("panel", F.concat(F.lit(f"{variable} = "), F.col(variable).cast("string")))


def number_text(x: Column) -> Column:
    """A double as scripts write it: ``5``, ``0.1``, ``1e+21``, ``1e-7``; shortest digits that name it."""
    text = F.abs(x).cast("string")
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"\.(\d+)", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    # Digits without zeros at either end, and the power of ten before the first of them.
    lead = F.regexp_replace(F.concat(whole, F.when(part == "0", "").otherwise(part)), "^0+", "")
    zeros = F.length(F.concat(whole, part)) - F.length(F.regexp_replace(F.concat(whole, part), "^0+", ""))
    digits = F.regexp_replace(lead, "0+$", "")
    n, point = F.length(digits), F.length(whole) - zeros + power
    mantissa = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    plain = F.when(point >= n, F.rpad(digits, point, "0")).when(point > 0, F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    shown = F.when((point > 21) | (point < -5), F.concat(mantissa, F.when(point > 0, "e+").otherwise("e"), (point - 1).cast("string"))).otherwise(plain)
    return F.when(F.isnan(x), "NaN").when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.when(F.abs(x) == float("inf"), "Infinity").otherwise(shown)))


def commas(x: Column, digits: int = 0) -> Column:
    return F.format_number(x, digits)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """A share in percent; of nothing there is none."""
    return F.when(whole != 0, F.concat(F.format_number(100.0 * part / whole, digits), F.lit("%")))


def branch_log(messages: DataFrame, most: int = 1024, most_bytes: int = 4 << 20) -> DataFrame:
    """What a channel's branches still hold: the newest ``most`` messages of each, of ``most_bytes`` in all at most.
    messages(branch array<string>, seq, body)."""
    w = Window.partitionBy("branch").orderBy(F.desc("seq"))
    size = F.sum(F.octet_length("body")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumns({"_n": F.row_number().over(w), "_b": size}).where((F.col("_n") <= most) & (F.col("_b") <= most_bytes)).drop("_n", "_b")


def wire_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON that scripts read without loss: whole numbers past 2^53 and decimals as text, floats that are not
    finite by name."""

    def shown(f) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "bigint":  # text where a double would lose digits: two forms of one field, so it is written by hand
            return F.when(F.abs(c) > 2**53, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
        if kind.startswith("decimal"):
            return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
        if kind in ("double", "float"):
            d = c.cast("double")
            return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.concat(F.lit('"'), number_text(d), F.lit('"'))).otherwise(number_text(d))
        one = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.substring(one, F.lit(6), F.length(one) - 6)

    parts = [F.concat(F.to_json(F.array(F.lit(f.name))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(f.name)))) - 2), F.lit(":"), F.coalesce(shown(f), F.lit("null"))) for f in df.schema.fields]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias(name))


def base36(x: Column) -> Column:
    return F.lower(F.conv(x.cast("string"), 10, 36))


def suggestion(times: int, numbers: int, labels: int, rows: int) -> str:
    """How to draw a frame by its shape, the cheapest drawing first."""
    if rows == 1 and numbers == 1:
        return "number"
    if times == 1 and numbers:
        return "bar" if rows < 20 else "line"
    if labels == 1 and numbers == 1 and rows <= 30:
        return "bar"
    return "table"
