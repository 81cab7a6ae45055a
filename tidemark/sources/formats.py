"""Text formats of metrics and logs as DataFrames; lines are read by Spark, parsed in Arrow batches where escapes need it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = re.compile(r'([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?[\d.]+))?\s*(?:#.*)?$')
LABEL = re.compile(r'\s*([A-Za-z_]\w*)\s*=\s*"((?:[^"\\]|\\.)*)"\s*(?:,|$)')
ESCAPES = {"\\\\": "\\", '\\"': '"', "\\n": "\n"}


def labels_of(text: str) -> dict[str, str] | None:
    """Labels of a brace's inside; None if malformed or a name occurs twice."""
    out, at = {}, 0
    while at < len(text.rstrip()):
        m = LABEL.match(text, at)
        if not m or m[1] in out:
            return None
        out[m[1]] = re.sub(r'\\[\\"n]', lambda e: ESCAPES[e[0]], m[2])
        at = m.end()
    return out


def number(text: str) -> float | None:
    try:
        return float({"+Inf": "inf", "-Inf": "-inf"}.get(text, text))
    except ValueError:
        return None


def exposition(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Samples of Prometheus or OpenMetrics pages: (id, name, kind, labels, value, ms, skipped).

    A page is parsed as a whole, as ``# TYPE`` lines govern what follows. Quantiles of summaries and malformed samples
    become one row with a null name that counts what was skipped; ``_created`` lines of counters give a zero sample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                kinds: dict[str, str] = {}
                skipped = 0
                for line in (text or "").split("\n"):
                    if line.startswith("#"):
                        parts = line.split(None, 3)
                        if len(parts) >= 4 and parts[1] == "TYPE":
                            kinds[parts[2]] = parts[3].strip()
                        continue
                    if not line.strip():
                        continue
                    m = SAMPLE.match(line)
                    labels = labels_of(m[2] or "") if m else None
                    value = number(m[3]) if m else None
                    if labels is None or value is None:
                        skipped += 1
                        continue
                    name, base = m[1], re.sub(r"_(total|sum|count|bucket|created)$", "", m[1])
                    kind = kinds.get(name) or kinds.get(base, "gauge")
                    if kind == "summary" and "quantile" in labels:
                        skipped += 1
                        continue
                    ms = int(float(m[4]) * (1 if float(m[4]) > 1e11 else 1000)) if m[4] else None
                    if name.endswith("_created") and kind in ("counter", "histogram"):
                        out.append((i, base, "counter", labels, 0.0, int(value * 1000), 0))
                        continue
                    out.append((i, name, "counter" if kind in ("counter", "histogram") else "gauge", labels, value, ms, 0))
                if skipped:
                    out.append((i, None, None, {}, None, None, skipped))
            frame = pd.DataFrame(out, columns=["id", "name", "kind", "labels", "value", "ms", "skipped"], dtype=object)
            yield frame.astype({"value": "float64", "ms": "Int64", "skipped": "int64"})

    src = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, name string, kind string, labels map<string,string>, value double, ms long, skipped long")


def influx(lines: DataFrame, line: str = "value") -> DataFrame:
    """``measurement,tag=v field=1,other=2 ns`` as samples (name, labels, us, value), one row a field."""
    parts = F.split(line, " ")
    head = F.split(parts[0], ",", 2)
    tags = F.when(F.size(head) > 1, F.str_to_map(head[1], F.lit(","), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
    rows = lines.select(head[0].alias("measurement"), tags.alias("labels"), F.expr(f"cast(split(`{line}`, ' ')[2] as bigint) div 1000").alias("us"), F.explode(F.str_to_map(parts[1], F.lit(","), F.lit("="))).alias("field", "text"))
    return rows.select(F.concat_ws("_", "measurement", "field").alias("name"), "labels", "us", F.regexp_replace("text", "i$", "").cast("double").alias("value"))


def series_json(lines: DataFrame, line: str = "value") -> DataFrame:
    """``{"metric": {..}, "values": [..], "timestamps": [..]}`` as samples, one row a point."""
    j = F.from_json(line, "metric map<string,string>, values array<double>, timestamps array<long>")
    rows = lines.select(j.alias("j")).select(F.col("j.metric").alias("m"), F.explode(F.arrays_zip("j.timestamps", "j.values")).alias("p"))
    return rows.select(F.col("m")["__name__"].alias("name"), F.map_filter("m", lambda k, _: k != "__name__").alias("labels"), (F.col("p.timestamps") * 1000).alias("us"), F.col("p.values").alias("value"))


def docker_json(lines: DataFrame, line: str = "value") -> DataFrame:
    """The json-file log driver's lines: (at, stream, body)."""
    j = F.from_json(line, "log string, stream string, time timestamp")
    return lines.select(j.alias("j")).select(F.col("j.time").alias("at"), F.col("j.stream").alias("stream"), F.regexp_replace("j.log", "\n$", "").alias("body"))


def dated_lines(lines: DataFrame, pattern: str, form: str, line: str = "value") -> DataFrame:
    """Log lines that begin with a date: (at, body); ``pattern`` captures the date and the rest."""
    return lines.select(F.try_to_timestamp(F.regexp_extract(line, pattern, 1), F.lit(form)).alias("at"), F.regexp_extract(line, pattern, 2).alias("body"))
