"""Time series: ingest rules, label conditions, bucket aggregates by the step rule, percentiles, rollups, names.

Samples are a DataFrame (name, kind, labels map<string,string>, us long, value double, seq long); ``us`` is
microseconds since 1970. Sums of values are exact and rounded once (``functions.exact``): they do not depend on
partitioning, lose no digits, and are infinite past a double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.ranges import RangeError, bucket, within


def dedupe(samples: DataFrame) -> DataFrame:
    """Of samples with one time in one series, the last written."""
    w = Window.partitionBy("name", series_key(), "us").orderBy(F.desc("seq"))
    return samples.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def series_key() -> Column:
    return F.to_json(F.array_sort(F.map_entries("labels")))


def admission(us: Column, now: int, keep: int, ahead: int) -> Column:
    """Why a sample is refused, or null."""
    return F.when(us < now - keep, "too old").when(us > now + ahead, "too new")


def one_of(labels: Column, key: str, values: list[str]) -> Column:
    if not values or len(values) > 1000:
        raise RangeError("between 1 and 1000 values")
    return F.coalesce(labels[key].isin(values), F.lit(False))


def none_of(labels: Column, key: str, values: list[str]) -> Column:
    """True also where the label is absent."""
    return F.coalesce(~labels[key].isin(values), F.lit(True))


def starts(labels: Column, key: str, prefix: str) -> Column:
    if not prefix:
        raise RangeError("an empty prefix finds everything")
    return F.coalesce(F.startswith(labels[key], F.lit(prefix)), F.lit(False))


def where(labels: Column, conditions: dict) -> Column:
    """A conjunction: text, list of texts, {"prefix": ..} or {"not": ..}. Something must find, not only exclude."""
    parts, finds = [], False
    for key, c in conditions.items():
        if c is None:
            raise RangeError(f"no condition for {key!r}")
        if isinstance(c, dict) and "not" in c:
            parts.append(none_of(labels, key, c["not"] if isinstance(c["not"], list) else [c["not"]]))
            continue
        finds = True
        parts.append(starts(labels, key, c["prefix"]) if isinstance(c, dict) else one_of(labels, key, [str(x) for x in (c if isinstance(c, list) else [c])]))
    if not finds:
        raise RangeError("no equality, list or prefix to find by")
    return reduce(lambda a, b: a & b, parts)


def group_key(by: list[str] | None = None, without: list[str] | None = None) -> Column:
    """Canonical text of the labels that name a group; no ``by`` and no ``without``: one group."""
    if by is not None and without is not None:
        raise RangeError("by and without together")
    if by is None and without is None:
        return F.lit("[]")
    keep = (lambda k, _: k.isin(by)) if by is not None else (lambda k, _: ~k.isin(without)) if without else (lambda k, _: F.lit(True))
    return F.to_json(F.array_sort(F.map_entries(F.map_filter("labels", keep))))


def steps(samples: DataFrame, block: int | None = None) -> DataFrame:
    """The sample before each in its series: ``prev`` and ``before``, its value and time, and whether ``reset`` (0 or 1).

    With ``block``, a span of time, an enormous series is gone through in blocks, each with the last sample before it.
    """
    rows, keys = samples.withColumn("_guest", F.lit(False)), ["name", series_key()]
    if block is not None:
        rows, keys = rows.withColumn("_block", F.floor(F.col("us") / block)), [*keys, F.col("_block")]
        last = rows.groupBy("name", series_key().alias("_series"), "_block").agg(F.max_by(F.struct(*samples.columns), F.struct("us", "seq")).alias("_row"))
        after = F.lead("_block").over(Window.partitionBy("name", "_series").orderBy("_block"))
        guests = last.withColumn("_to", after).where("_to is not null").select("_row.*", F.lit(True).alias("_guest"), F.col("_to").alias("_block"))
        rows = rows.unionByName(guests)
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    out = rows.withColumns({"prev": F.lag("value").over(w), "before": F.lag("us").over(w)}).where("not _guest").select(*samples.columns, "prev", "before")
    return out.withColumn("reset", F.coalesce((F.col("value") < F.col("prev")).cast("long"), F.lit(0)))


def with_last(samples: DataFrame, begin: int, end: int, back: int | None = None) -> DataFrame:
    """The samples of the range, and of each series the newest one before it, at most ``back`` older.

    Older samples meet before the shuffle: one row per series and task, not the history.
    """
    old = samples.where(F.col("us") < begin)
    old = old if back is None else old.where(F.col("us") >= begin - back)
    row = F.struct(*samples.columns)
    newest = old.groupBy("name", series_key().alias("_series")).agg(F.max_by(row, F.struct("us", "seq")).alias("_row"))
    return samples.where(within(F.col("us"), begin, end)).unionByName(newest.select("_row.*"))


GAUGE = {
    "count": lambda: F.count(F.lit(1)),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "first": lambda: F.min_by("value", F.struct("us", "seq")),
    "last": lambda: F.max_by("value", F.struct("us", "seq")),
}


def aggregate(samples: DataFrame, op: str, begin: int, end: int, every: int | None = None, by: list[str] | None = None, without: list[str] | None = None, back: int | None = None, block: int | None = None) -> DataFrame:
    """(name, kind, grp, at, value, samples, resets, partial, gap); empty buckets are absent.

    Increase, rate and delta count each step in the bucket where it ends; the step before the range's first sample
    begins at the newest sample before the range (``back`` older at most: what retention keeps), so older samples are
    read for it, and only one per series goes on. Steps are not rounded: what is added are the values themselves.
    ``block`` (a span) spreads an enormous series over tasks.
    """
    every = every or 0
    at = bucket(F.col("us"), every) if every else F.lit(begin)
    keys, none = ["name", "kind", "grp", "at"], {"resets": F.lit(0).cast("long"), "gap": F.lit(False)}
    many = {"samples": (F.count(F.lit(1)), "sum")}
    value, prev = F.col("value"), F.col("prev")
    if op in ("increase", "rate", "delta", "resets"):
        s = steps(with_last(samples, begin, end, back), block).where(within(F.col("us"), begin, end)).withColumns({"at": at, "grp": group_key(by, without)})
        late = F.coalesce(bucket(F.col("before"), every) < F.col("at") - every, F.lit(False)) if every else F.lit(False)
        less = prev.isNotNull() if op == "delta" else value >= prev
        out = exact.sums(s, keys, {"value": [F.when(prev.isNotNull(), value), F.when(less, -prev)]}, many | {"resets": (F.sum("reset"), "sum"), "gap": (F.max(late), "max")})
        out = out.withColumn("value", F.coalesce("value", F.lit(0.0)))
        if op == "resets":
            out = out.withColumn("value", F.col("resets").cast("double"))
        if op == "rate":
            right = F.least(F.col("at") + every, F.lit(end)) if every else F.lit(end)
            out = out.withColumn("value", value / ((right - F.greatest(F.col("at"), F.lit(begin))) / 1e6))
    elif op in ("first", "last"):
        # Per series first; over a group the series' values add.
        s = samples.where(within(F.col("us"), begin, end)).withColumns({"at": at, "grp": group_key(by, without), "series": series_key()})
        own = s.groupBy("name", "kind", "grp", "series", "at").agg(GAUGE[op]().alias("value"), F.count(F.lit(1)).alias("n"))
        out = exact.sums(own, keys, {"value": [value]}, {"samples": (F.sum("n"), "sum")}).withColumns(none)
    elif op in ("sum", "avg"):
        s = samples.where(within(F.col("us"), begin, end)).withColumns({"at": at, "grp": group_key(by, without)})
        out = exact.sums(s, keys, {"value": [value]}, many | {"known": (F.count("value"), "sum")}).withColumns(none)
        out = out.withColumn("value", value / F.nullif("known", F.lit(0))) if op == "avg" else out
    elif op in GAUGE:
        s = samples.where(within(F.col("us"), begin, end)).withColumns({"at": at, "grp": group_key(by, without)})
        out = s.groupBy(*keys).agg(GAUGE[op]().alias("value"), F.count(F.lit(1)).alias("samples")).withColumns(none)
    else:
        raise RangeError(f"no aggregate {op!r}")
    cut = (F.col("at") < begin) | (F.col("at") + every > end) if every else F.lit(False)
    return out.withColumn("partial", cut).select("name", "kind", "grp", "at", "value", "samples", "resets", "partial", "gap")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, pct, value, samples): the stored value at rank ceil(num n / den) of each group, for every named (num, den).

    Equal values meet before the shuffle; ranks are whole numbers over counts of values, found once for all names.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    run = per.withColumns({"_hi": F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    need = lambda num, den: F.expr(f"greatest(1, ({num} * _n + {den} - 1) div {den})")
    hit = F.array(*(F.when((need(*r) <= F.col("_hi")) & (need(*r) > F.col("_hi") - F.col("_c")), F.lit(name)) for name, r in ranks.items()))
    return run.select(*keys, F.explode(F.array_compact(hit)).alias("pct"), F.col("_v").alias("value"), F.col("_n").alias("samples"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, num: int, den: int) -> DataFrame:
    return nearest_ranks(df, keys, value, {"": (num, den)}).drop("pct")


def exact_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Correctly rounded sums of doubles, whatever the partitioning."""
    return exact.sums(df, keys, {value: [F.col(value)]})


def cumulative(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """A timer's buckets: (keys, le, n), cumulative counts of values at or under each bound, +Inf last."""
    les = F.array(*(F.lit(float(b)) for b in [*bounds, float("inf")]))
    counted = df.groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"_c{i}") for i, b in enumerate([*bounds, float("inf")])))
    pairs = F.arrays_zip(les.alias("le"), F.array(*(F.col(f"_c{i}") for i in range(len(bounds) + 1))).alias("n"))
    return counted.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.le").alias("le"), F.col("p.n").alias("n"))


def bucket_percentile(buckets: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """(keys, lower, upper, estimate): the bounds that hold the rank, and a linear estimate between them.

    Past the last finite bound ``upper`` is infinite and the estimate that bound; groups without values are left out.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    b = buckets.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "under": F.coalesce(F.lag("n").over(w), F.lit(0)), "total": F.max("n").over(Window.partitionBy(*keys))}).where("total > 0")
    b = b.withColumn("need", F.expr(f"({num} * total + {den} - 1) div {den}"))
    hit = b.where((F.col("n") >= F.col("need")) & (F.col("under") < F.col("need")))
    rank = F.col("total") * num / den
    inner = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("under")) / (F.col("n") - F.col("under"))
    return hit.select(*keys, F.col("low").alias("lower"), F.col("le").alias("upper"), F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inner).alias("estimate"), F.col("total").alias("samples"))


def shared_bounds(buckets: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Buckets of a group of members: only bounds that every member with values has, counts added."""
    members = buckets.groupBy(*keys).agg(F.countDistinct(member).alias("members"))
    summed = buckets.groupBy(*keys, "le").agg(F.sum("n").alias("n"), F.countDistinct(member).alias("have"))
    return summed.join(members, keys).where("have = members").select(*keys, "le", "n")


def grid_bounds(spark, schema: int = 3, low: int = -80, high: int = 160) -> DataFrame:
    """(i, lower, upper) of the exponential grid: bounds 2^(i / 2^schema), from a table so that no rounding moves them."""
    n = 1 << schema
    return spark.createDataFrame([(i, 2.0 ** ((i - 1) / n), 2.0 ** (i / n)) for i in range(low, high + 1)], "i int, lower double, upper double")


def exponential(df: DataFrame, keys: list[str], value: str, schema: int = 3) -> DataFrame:
    """(keys, i, n): values counted per grid interval; the table of bounds is small and fixed."""
    grid = F.broadcast(grid_bounds(df.sparkSession, schema))
    return df.join(grid, (F.col(value) > F.col("lower")) & (F.col(value) <= F.col("upper"))).groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("n"))


def coarser(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The next coarser grid: interval i falls into ceil(i / 2), exactly."""
    return hist.withColumn("i", F.ceil(F.col("i") / 2).cast("int")).groupBy(*keys, "i").agg(F.sum("n").alias("n"))


def rollup(samples: DataFrame, every: int, keys: list[str]) -> DataFrame:
    """Per bucket what coarser buckets can be made of: ``total_parts`` hold the sum with all its digits."""
    order = F.struct("us", "seq", "value")
    others = {"n": (F.count(F.lit(1)), "sum"), "low": (F.min("value"), "min"), "high": (F.max("value"), "max"), "first": (F.min(order), "min"), "last": (F.max(order), "max")}
    out = exact.sums(samples.withColumn("at", bucket(F.col("us"), every)), [*keys, "at"], {"total": [F.col("value")]}, others, parts=True)
    return out.withColumns({"first": F.col("first.value"), "last": F.col("last.value")})


def roll_again(rolled: DataFrame, fine: int, coarse: int, keys: list[str]) -> DataFrame:
    if coarse % fine:
        raise RangeError("a coarser span must be a whole multiple of the finer one")
    others = {"n": (F.sum("n"), "sum"), "low": (F.min("low"), "min"), "high": (F.max("high"), "max"), "first": (F.min_by("first", "fine"), "min"), "last": (F.max_by("last", "fine"), "max")}
    return exact.again(rolled.withColumnRenamed("at", "fine").withColumn("at", bucket(F.col("fine"), coarse)), [*keys, "at"], "total", others)


def latest(samples: DataFrame, begin: int, end: int) -> DataFrame:
    """The newest sample of each series in the range."""
    order = F.struct("us", "seq")
    return samples.where(within(F.col("us"), begin, end)).groupBy("name", series_key().alias("series")).agg(F.max("us").alias("us"), F.max_by("value", order).alias("value"))


def page(samples: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The next ``limit`` samples in the order of (name, series, us, seq), after ``cursor``, the last of the page before."""
    if not 0 < limit <= 100_000:
        raise RangeError("between 1 and 100000 samples")
    s = samples.withColumn("series", series_key())
    order = ["name", "series", "us", "seq"]
    if cursor is not None:
        s = s.where(F.struct(*order) > F.struct(*(F.lit(v).cast(s.schema[c].dataType) for c, v in zip(order, cursor, strict=True))))
    return s.orderBy(*order).limit(limit)


def before_range(samples: DataFrame, begin: int) -> DataFrame:
    """The newest sample of each series before the range."""
    return latest(samples, -(2**62), begin)


def names(samples: DataFrame, prefix: str = "", after: str | None = None, limit: int | None = None) -> DataFrame:
    """(name, kind, series, newest) of metrics, a page of them in order of the name's bytes."""
    s = samples.where(F.startswith("name", F.lit(prefix))) if prefix else samples
    s = s if after is None else s.where(F.col("name") > after)
    out = s.groupBy("name", "kind").agg(F.count_distinct(series_key()).alias("series"), F.max("us").alias("newest"))
    return out if limit is None else out.orderBy("name").limit(limit)


def label_names(samples: DataFrame, name: str | None = None) -> DataFrame:
    s = samples if name is None else samples.where(F.col("name") == name)
    return s.select(F.explode(F.map_keys("labels")).alias("label")).distinct()


def label_values(samples: DataFrame, label: str, prefix: str = "", after: str | None = None, limit: int | None = None) -> DataFrame:
    """Different values of a label, a page of them in order of their bytes."""
    v = samples.select(F.col("labels")[label].alias("value")).where("value is not null")
    v = v.where(F.startswith("value", F.lit(prefix))) if prefix else v
    v = (v if after is None else v.where(F.col("value") > after)).distinct()
    return v if limit is None else v.orderBy("value").limit(limit)


def described(named: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Names with the unit and help that were last told of each; descriptions(name, unit, help, at)."""
    last = descriptions.groupBy("name").agg(F.max_by(F.struct("unit", "help"), "at").alias("d"))
    return named.join(last, "name", "left").select(*named.columns, F.coalesce("d.unit", F.lit("")).alias("unit"), F.coalesce("d.help", F.lit("")).alias("help"))


def refuse_unsound(samples: DataFrame) -> DataFrame:
    """Fails when a gauge is not finite or a counter is below zero; never drops it."""
    v = F.col("value")
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | ((F.col("kind") == "counter") & (v < 0))
    return samples.withColumn("value", F.when(bad, F.raise_error(F.lit("a value is not finite, or a counter is below zero")).cast("double")).otherwise(v))
