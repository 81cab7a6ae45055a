"""Calculations over frames of several instances: exact reductions, completeness, known empty groups, units, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.ranges import RangeError

def calculate(frame: DataFrame, values: dict[str, dict], by: list[str], time: str | None = None) -> DataFrame:
    """``values``: column -> {op, as?}. first and last need the frame's one time column.

    Sums and means of doubles are exact and rounded once, those of decimals and whole numbers exact to the last digit.
    """
    kinds = dict(frame.dtypes)
    totals, others, final = {}, {}, []
    for i, (column, v) in enumerate(values.items()):
        name, op, own = v.get("as", column), v["op"], f"_v{i}"
        if name in by:
            raise RangeError(f"{name!r} is a value and a group")
        floats = kinds[column] in ("double", "float")
        if op in ("first", "last"):
            if time is None:
                raise RangeError(f"{op} needs exactly one time column")
            how = "min" if op == "first" else "max"
            others[own] = (getattr(F, how)(F.struct(F.col(time).alias("at"), F.col(column).alias("value"))), how)
            final.append(F.col(own)["value"].alias(name))
        elif op in ("sum", "avg"):
            if floats:
                totals[own] = [F.col(column)]
            else:
                others[own] = (F.sum(column), "sum")
            others[f"{own}_n"] = (F.count(column), "sum")
            total = F.col(own).cast("double") if op == "avg" or kinds[column].startswith("decimal") else F.col(own)
            final.append((total / F.nullif(f"{own}_n", F.lit(0)) if op == "avg" else total).alias(name))
        elif op in ("count", "min", "max"):
            others[own] = (getattr(F, op)(column), "sum" if op == "count" else op)
            final.append(F.col(own).alias(name))
        else:
            raise RangeError(f"no calculation {op!r}")
    if not totals:
        return frame.groupBy(*by).agg(*(a.alias(n) for n, (a, _) in others.items())).select(*by, *final)
    return exact.sums(frame, by, totals, others).select(*by, *final)


def one_unit(frame: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Fails at groups that would add two units; never adds them."""
    n = F.count_distinct(unit)
    return frame.groupBy(*by).agg(F.when(n > 1, F.raise_error(F.lit("a group holds several units")).cast("string")).otherwise(F.min(unit)).alias(unit))


def completeness(answers: DataFrame, group: list[str], instance: str, ok: str) -> DataFrame:
    """Per group whether every instance that it depends on answered, and which did not."""
    return answers.groupBy(*group).agg(F.bool_and(ok).alias("complete"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col(ok), F.col(instance)))), ",").alias("missing"))


def empty_zero(result: DataFrame, known: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Groups known from labels that had no rows get zero."""
    out = known.select(*by).distinct().join(result, by, "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})


def series_rule(frame: DataFrame, time: str) -> DataFrame:
    """A frame with one time column as series: each number column a name, other columns labels; nulls are skipped."""
    kinds = dict(frame.dtypes)
    if sum(t.startswith("timestamp") or t == "date" for t in kinds.values()) != 1:
        raise RangeError("exactly one time column is needed")
    numbers = [c for c, t in kinds.items() if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")]
    if not numbers:
        raise RangeError("no number column")
    labels = [c for c in kinds if c not in numbers and c != time]
    label = F.map_filter(F.create_map(*(x for c in labels for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull()) if labels else F.create_map().cast("map<string,string>")
    stacked = frame.select(time, label.alias("labels"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers))).alias("s"))
    return stacked.select("s.name", "labels", F.col(time).alias("ts"), "s.value").where("value is not null")


def thresholds(value: Column, warn: float, bad: float) -> Column:
    return F.when(value >= bad, "bad").when(value >= warn, "warn").otherwise("ok")


def alert_states(evaluations: DataFrame, keys: list[str], at: str, breach: str, hold: int) -> DataFrame:
    """The state of each evaluation: ok, pending, firing after ``hold`` of breach, resolved at the first good one after.

    ``breach`` null is an incomplete answer, which keeps the state: the last known value stands in.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    e = evaluations.withColumn("known", F.coalesce(F.last(breach, ignorenulls=True).over(rows), F.lit(False)))
    e = e.withColumn("change", F.when(F.coalesce(F.lag("known").over(w) != F.col("known"), F.lit(True)), 1).otherwise(0))
    e = e.withColumn("run", F.sum("change").over(rows))
    r = Window.partitionBy(*keys, "run").orderBy(at)
    e = e.withColumns({"since": F.min(at).over(r.rowsBetween(Window.unboundedPreceding, 0)), "no": F.row_number().over(r)})
    firing = F.col("known") & (F.col(at) - F.col("since") >= hold)
    e = e.withColumn("fires", firing)
    state = F.when(firing, "firing").when(F.col("known"), "pending").when((F.col("no") == 1) & F.coalesce(F.lag("fires").over(w), F.lit(False)), "resolved").otherwise("ok")
    return e.withColumn("state", state).drop("known", "change", "run", "no", "fires")


def transitions(states: DataFrame, keys: list[str], at: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at)
    return states.withColumn("was", F.lag("state").over(w)).where("was is null or was <> state")


def collector_windows(done: DataFrame, keys: list[str], end: str, due: int, cap: int) -> DataFrame:
    """The next window of each (read, instance): from its own last end to when the run was due, a gap beyond ``cap``."""
    begin = F.max(end)
    out = done.groupBy(*keys).agg(begin.alias("last_end"))
    return out.select(*keys, F.greatest("last_end", F.lit(due - cap)).alias("begin"), F.lit(due).alias("end"), (F.lit(due) - F.col("last_end") > cap).alias("gap"))
