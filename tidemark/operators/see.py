"""What a schema and its statistics say: profiles, roles, keys, questions, and bounded answers."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.ordered import running
from ..functions.ranges import RangeError
from ..functions.text import name_tokens, singular

ROWS_EXACT, SAMPLE_ROWS, SEED = 10_000, 7_000, 17
LEAST = {"bucket": 20, "group": 5, "whole": 30}


def profile(df: DataFrame, table: str) -> DataFrame:
    """(table, column, type, rows, nulls, distinct, width) of each column, in one pass over the table."""
    cols = [f for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint", "double", "string", "timestamp_ntz", "float")]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(cols):
        aggs += [F.count_if(F.col(f.name).isNull()).alias(f"z{i}"), F.count_distinct(F.col(f.name)).alias(f"d{i}"), F.round(F.avg(F.octet_length(F.col(f.name).cast("string"))), 3).alias(f"w{i}")]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("rows"), F.col(f"z{i}").alias("nulls"), F.col(f"d{i}").alias("distinct"), F.col(f"w{i}").alias("width")) for i, f in enumerate(cols)]
    return one.select(F.lit(table).alias("table"), F.explode(F.array(*parts)).alias("c")).select("table", "c.*")


def common_values(df: DataFrame, column: str, most: int = 30) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def histogram(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Bounds of ``parts`` parts of equal count, stored values at whole ranks: by counts of values, not of rows."""
    per = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    run = running(per, "_v", "_c", "_lo").withColumn("_hi", F.col("_lo") + F.col("_c")).join(F.broadcast(per.agg(F.sum("_c").alias("_n"))))
    ranks = df.sparkSession.range(0, parts + 1).select(F.col("id").alias("part"))
    need = F.greatest(F.lit(1), F.expr(f"(part * _n + {parts} - 1) div {parts}"))
    return run.join(F.broadcast(ranks)).where((need <= F.col("_hi")) & (need > F.col("_lo"))).select("part", F.col("_v").alias("bound"))


@dataclass(frozen=True)
class Columns:
    """What the driver knows of a table: names and types, and whether a column is unique."""

    table: str
    types: dict[str, str]
    key: str | None


# Words of names by the role that they suggest.
TIMES = {
    "created": {"created", "inserted", "registered", "signup", "joined"},
    "updated": {"updated", "modified", "changed"},
    "deleted": {"deleted", "removed", "archived"},
    "calendar": {"birth", "dob", "birthday", "year"},
    "period": {"from", "to", "start", "end"},
}
NUMBERS = {
    "money": {"amount", "price", "total", "subtotal", "cost", "fee", "charge", "paid", "salary", "wage", "revenue", "cents", "kopecks", "totalprice", "extendedprice", "retailprice", "acctbal"},
    "quantity": {"qty", "quantity", "count", "num", "units", "items", "seats", "size"},
    "level": {"balance", "stock", "inventory", "remaining", "level"},
    "ratio": {"percent", "pct", "rate", "ratio", "share", "discount", "tax"},
    "score": {"rating", "score", "stars", "rank", "priority"},
    "place": {"lat", "lng", "lon", "latitude", "longitude"},
}
TEXTS = {"code": {"zip", "postal", "phone", "code", "sku"}, "currency": {"currency", "ccy"}, "identifier": {"uuid", "guid", "hash", "token"}}
WORDY = {"name", "title", "description", "email", "url", "comment", "note", "body"}


def _named(words: list[str], by: dict[str, set[str]]) -> str | None:
    return next((r for r, own in by.items() if own & set(words)), None)


def evidence(column: str, kind: str, distinct: int, rows: int, declared: str | None = None, width: float | None = None) -> tuple[str, str]:
    """(role, tier): what a column is and what says so, declared before measured before named before typed."""
    words = name_tokens(column)
    if declared in ("pk", "fk", "enum"):
        return {"pk": "identifier", "fk": "reference", "enum": "category"}[declared], "declared"
    if distinct == rows and rows > 1 and kind in ("int", "bigint") and words and words[-1].endswith(("id", "key", "no")):
        return "identifier", "measured"
    if kind.startswith(("timestamp", "date")):
        named = _named(words, TIMES)
        return (named, "named") if named else ("event", "typed")
    if kind == "boolean":
        return ("deleted", "named") if _named(words, {"deleted": TIMES["deleted"]}) else ("category", "declared")
    if words and words[-1] in ("id", "key") or any(w.endswith("key") for w in words):
        return "reference", "named"
    if kind != "string":
        named = _named(words, NUMBERS) or _named(words, {"calendar": TIMES["calendar"]})
        return (named, "named") if named else ("money", "typed") if re.fullmatch(r"decimal\(\d+,[24]\)", kind) else ("number", "typed")
    if named := _named(words, TEXTS):
        return named, "named"
    if distinct <= 50 and not WORDY & set(words) and (width or 0) <= 40:
        return "category", "measured"
    return "text", "named" if WORDY & set(words) else "measured"


def role(column: str, kind: str, distinct: int, rows: int) -> str:
    """One of the column roles."""
    return evidence(column, kind, distinct, rows)[0]


def column_statistics(df: DataFrame, column: str, most: int = 30, parts: int = 10) -> dict[str, object]:
    """A column as a planner's catalog has it: null_frac, avg_width, n_distinct (negative: a share of the rows, where
    these are many), the commonest values with their shares, and bounds of equal counts of the others (numbers only)."""
    c = F.col(column)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("k"), F.count_distinct(c).alias("d"), F.avg(F.octet_length(c.cast("string"))).alias("w")).first()
    n, d = max(1, r["n"]), r["d"]
    common = [x for x in common_values(df.where(c.isNotNull()), column, most).collect() if x["n"] > 1] if d < r["k"] else []
    kind = dict(df.dtypes)[column]
    bounds = [x["bound"] for x in histogram(df.where(~F.coalesce(c.cast("string").isin([x["value"] for x in common]), F.lit(False))), column, parts).orderBy("part").collect()] if kind in ("int", "bigint", "double", "float") and d > len(common) else []
    return {"null_frac": (r["n"] - r["k"]) / n, "avg_width": r["w"] or 0.0, "n_distinct": -d / n if d > 0.1 * n else d, "common": [x["value"] for x in common], "shares": [x["n"] / n for x in common], "bounds": bounds}


def key_stem(column: str) -> str:
    """The thing that a key column names: ``o_custkey`` and ``cust_id`` are ``cust``."""
    last = name_tokens(column)
    text = "".join(last)
    for end in ("key", "id", "code", "no"):
        if text.endswith(end) and len(text) > len(end):
            return singular(text[: -len(end)])
    return ""


@dataclass(frozen=True)
class Feature:
    """A fact of a catalog with its state: present, absent, denied, stale or unsupported. Only ``present`` has a value:
    what is absent is not zero."""

    state: str
    value: object = None

    @classmethod
    def of(cls, value=None, supported: bool = True, allowed: bool = True, age: float = 0.0, oldest: float = float("inf")) -> Feature:
        if not supported:
            return cls("unsupported")
        if not allowed:
            return cls("denied")
        return cls("absent") if value is None else cls("stale") if age > oldest else cls("present", value)

    def get(self):
        if self.state != "present":
            raise RangeError(f"the fact is {self.state}")
        return self.value


def table_statistics(df: DataFrame, table: str) -> DataFrame:
    """(table, rows, files, bytes) of a stored table; files and bytes are absent (null) where it isn't one."""
    spark, sizes = df.sparkSession, []
    for f in df.inputFiles():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        sizes.append(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen())
    files, size = (len(sizes), sum(sizes)) if sizes else (None, None)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), "rows", F.lit(files).cast("long").alias("files"), F.lit(size).cast("long").alias("bytes"))


def table_role(table: Columns, roles: dict[str, str], keys: list[tuple[str, str, str, str]], rows: int, unique_pairs: tuple[tuple[str, str], ...] = ()) -> str:
    """fact, event, entity, snapshot, link, lookup or other, by its columns' roles and the keys out of it and into it."""
    out = {c for t, c, _, _ in keys if t == table.table}
    into = {(t, c) for t, c, p, _ in keys if p == table.table}
    times = {c for c, r in roles.items() if r in ("created", "event")}
    rest = [c for c in roles if c not in out and c not in times and c != table.key and roles[c] not in ("identifier", "reference")]
    if any(a in out and b in times or b in out and a in times for a, b in unique_pairs):
        return "snapshot"
    if len(out) >= 2 and not rest:
        return "link"
    if len(out) >= 2 and any(r in ("money", "quantity", "event") for r in roles.values()):
        return "fact"
    named = any(w in ("log", "event", "history", "audit", "activity") for w in map(singular, name_tokens(table.table)))
    if (times or named) and "updated" not in roles.values():
        return "event"
    if len(into) >= 2 and times:
        return "entity"
    if into and (len(roles) - (table.key in roles) <= 3 or rows < 100):
        return "lookup"
    return "other"


def subjects(rows: dict[str, int], keys: list[tuple[str, str, str, str]]) -> list[tuple[str, float]]:
    """Tables by activity: the sum of ln(1 + rows) of the tables that refer to each, and its own."""
    near = {t: {t} | {c for c, _, p, _ in keys if p == t} for t in rows}
    return sorted(((t, sum(math.log1p(rows[x]) for x in sorted(own))) for t, own in near.items()), key=lambda x: (-x[1], x[0]))


def key_scores(found: set, true: set, rounds: int = 1000, seed: int = SEED) -> dict[str, float]:
    """Precision, recall and F1 of guessed keys, and the middle 95 % of F1 over bootstrapped keys."""

    def f1(hits: int, extra: int, missed: int) -> float:
        return 2 * hits / max(1, 2 * hits + extra + missed)

    every = [(k in found, k in true) for k in sorted(found | true, key=str)]
    hits = sum(a and b for a, b in every)
    rnd, drawn = random.Random(seed), []
    for _ in range(rounds):
        some = rnd.choices(every, k=len(every)) if every else []
        h = sum(a and b for a, b in some)
        drawn.append(f1(h, sum(a and not b for a, b in some), sum(b and not a for a, b in some)))
    drawn.sort()
    return {"precision": hits / max(1, len(found)), "recall": hits / max(1, len(true)), "f1": f1(hits, len(found) - hits, len(true) - hits), "low": drawn[rounds // 40], "high": drawn[-1 - rounds // 40]}


def guess_keys(tables: list[Columns]) -> list[tuple[str, str, str, str]]:
    """(table, column, target table, target column): a column whose stem is the stem of another table's key, or a
    beginning of its name, and whose type is of the same family."""
    family = lambda t: "int" if t in ("int", "bigint") else t
    out = []
    for a in tables:
        for column, kind in a.types.items():
            stem = key_stem(column)
            if not stem or column == a.key:
                continue
            for b in tables:
                if b.table == a.table or b.key is None or family(b.types[b.key]) != family(kind):
                    continue
                if stem == key_stem(b.key) or (len(stem) >= 4 and singular(b.table).startswith(stem)):
                    out.append((a.table, column, b.table, b.key))
    return sorted(set(out))


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(distinct, found, containment, coverage) of a column's values in a key: both sides meet as distinct values."""
    c, p = child.select(F.col(column).alias("v")).where("v is not null").distinct(), parent.select(F.col(key).alias("v")).distinct().withColumn("hit", F.lit(1))
    j = c.withColumn("own", F.lit(1)).join(p, "v", "full")
    return j.agg(F.count("own").alias("distinct_values"), F.count_if(F.expr("own = 1 and hit = 1")).alias("found"), F.count("hit").alias("keys")).select("distinct_values", "found", F.round(F.col("found") / F.col("distinct_values"), 6).alias("containment"), F.round(F.col("found") / F.col("keys"), 6).alias("coverage"))


@dataclass(frozen=True)
class Question:
    table: str
    measure: str
    time: str | None = None
    by: str | None = None


def questions(roles: dict[str, dict[str, str]]) -> list[Question]:
    """Measures x times x breakdowns of each table with an event time; rows are a measure of every table."""
    out = []
    for t, cols in sorted(roles.items()):
        times = [c for c, r in cols.items() if r == "event"] or [None]
        for time in times:
            for measure in ["rows", *(c for c, r in cols.items() if r in ("money", "quantity"))]:
                out.append(Question(t, measure, time))
                out += [Question(t, measure, time, by) for by, r in cols.items() if r == "category"]
    return out


def vetoes(q: Question, distinct: dict[str, int], nulls: dict[str, int], rows: int) -> list[str]:
    """Why a question is not worth asking."""
    out = []
    if rows < LEAST["whole"]:
        out.append("too few rows")
    if q.by is not None and not 2 <= distinct[q.by] <= 50:
        out.append("a breakdown needs 2 to 50 values")
    if q.measure != "rows" and nulls[q.measure] * 2 > rows:
        out.append("mostly null")
    if q.measure != "rows" and distinct[q.measure] < 2:
        out.append("constant")
    return out


def choose(ranked: list[Question], most: int = 5, per_table: int = 2) -> list[Question]:
    """Greedy and diverse: at most so many per table, no two of one table, time and breakdown."""
    out: list[Question] = []
    for q in ranked:
        if len(out) < most and sum(o.table == q.table for o in out) < per_table and all((o.table, o.by) != (q.table, q.by) for o in out):
            out.append(q)
    return out


def compile(q: Question, df: DataFrame, unit: str = "month") -> DataFrame:
    """The question as a query: a value per span of time and breakdown. Sums are exact and rounded once."""
    keys = ([F.date_format(F.date_trunc(unit, q.time), "yyyy-MM-dd").alias("span")] if q.time else []) + ([F.col(q.by).alias("part")] if q.by else [])
    if q.measure == "rows":
        n = F.count(F.lit(1)).cast("double").alias("value")
        return df.groupBy(*keys).agg(n) if keys else df.agg(n)
    names = ["span"] * bool(q.time) + ["part"] * bool(q.by)
    if q.measure.startswith("distinct "):
        n = F.count_distinct(q.measure.removeprefix("distinct ")).cast("double").alias("value")
        return df.groupBy(*keys).agg(n) if keys else df.agg(n)
    return exact.sums(df.select(*keys, F.col(q.measure).alias("value")), names, {"value": [F.col("value")]})


def bounded(q: Question, df: DataFrame, rows: int) -> tuple[str, DataFrame]:
    """``exact`` for small tables, else a sample whose counts and sums are scaled; distinct counts are refused."""
    if rows <= ROWS_EXACT:
        return "exact", compile(q, df)
    if q.measure.startswith("distinct"):
        raise RangeError("a sample can't count different values")
    share = SAMPLE_ROWS / rows
    return "sampled", compile(q, df.sample(fraction=share, seed=SEED)).withColumn("value", F.col("value") / share)


def time_unit(seconds: DataFrame, value: str) -> tuple[str, float]:
    """The unit of a chart of durations, and its length in seconds: the finest in which the median is under 120."""
    median = seconds.agg(F.percentile(value, 0.5).alias("m")).first()["m"] or 0.0
    return next(((u, n) for u, n in (("seconds", 1.0), ("minutes", 60.0), ("hours", 3600.0)) if median / n < 120), ("days", 86400.0))


def auto_unit(days: float) -> str:
    """The bucket of a chart by the span of its data."""
    return "day" if days <= 90 else "week" if days <= 420 else "month" if days <= 6 * 366 else "year"


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, str]) -> list[Columns]:
    return [Columns(t, dict(df.dtypes), keys.get(t)) for t, df in tables.items()]


def drift(bounded_answer: DataFrame, whole: DataFrame, on: list[str]) -> DataFrame:
    """Relative error of each row of a bounded answer."""
    j = whole.withColumnRenamed("value", "w").join(bounded_answer.withColumnRenamed("value", "b"), on, "left")
    return j.select(*on, F.round(F.abs(F.coalesce("b", F.lit(0.0)) - F.col("w")) / F.col("w"), 6).alias("error"))
