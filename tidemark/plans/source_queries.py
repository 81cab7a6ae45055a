"""Formats, selectors, ranges and schedules: texts are made of ``events`` and read back by the engine's own readers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cron, ranges
from ..operators import dash
from ..operators import metrics as m
from ..session import micros, table
from ..sources import formats, reads
from .metric_queries import BEGIN, DAY, END, HOUR, T0, G, gauges
from .registry import query


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("us", micros(F.col("ts")))


def joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(f"select cast(user_id as varchar) instance, event_type as type, us // 1000 * 1000 as us, value from {G}")
def q_exposition(spark, d):
    """A page per user and hour with a line per event."""
    line = joined('load{type="', F.col("event_type"), '"} ', F.col("value").cast("string"), " ", (F.col("us") / 1000).cast("long").cast("string"), "\n")
    e = events(spark, d)
    pages = e.groupBy(F.col("user_id").cast("string").alias("instance"), ranges.bucket(F.col("us"), HOUR).alias("us")).agg(F.concat_ws("", F.lit("# TYPE load gauge\n"), F.collect_list(line)).alias("body"))
    got = reads.scraped(pages.select("instance", "us", F.lit(200).alias("status"), "body"))
    return got.select("instance", F.col("labels")["type"].alias("type"), "us", "value")


@query(f"select 'load_value' as name, event_type as type, us, value from {G} union all select 'load_user', event_type, us, cast(user_id as double) from {G}")
def q_influx(spark, d):
    e = events(spark, d)
    line = joined("load,type=", F.col("event_type"), " value=", F.col("value").cast("string"), ",user=", F.col("user_id").cast("string"), "i ", F.col("us").cast("string"), "000")
    return formats.influx(e.select(line.alias("value"))).select("name", F.col("labels")["type"].alias("type"), "us", "value")


@query(f"select event_type as type, cast(user_id as varchar) user, us // 1000 * 1000 as us, value from {G}")
def q_series_json(spark, d):
    point = F.struct((F.col("us") / 1000).cast("long").alias("t"), F.col("value").alias("v"))
    s = events(spark, d).groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    metric = F.create_map(F.lit("__name__"), F.lit("load"), F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    line = F.to_json(F.struct(metric.alias("metric"), F.col("p.v").alias("values"), F.col("p.t").alias("timestamps")))
    return formats.series_json(s.select(line.alias("value"))).select(F.col("labels")["type"].alias("type"), F.col("labels")["user"].alias("user"), "us", "value")


@query(f"select event_type stream, us, 'user ' || user_id as body from {G}")
def q_docker_lines(spark, d):
    e = events(spark, d)
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = joined('{"log":"user ', F.col("user_id").cast("string"), '\\n","stream":"', F.col("event_type"), '","time":"', time, '"}')
    got = formats.docker_json(e.select(line.alias("value")))
    return got.select("stream", F.unix_micros("at").alias("us"), "body")


@query(f"select us // 1000000 * 1000000 as us, event_type || ' by ' || user_id as body from {G}")
def q_dated_lines(spark, d):
    line = joined(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " ", F.col("event_type"), " by ", F.col("user_id").cast("string"))
    got = formats.dated_lines(table(spark, d, "events").select(line.alias("value")), r"^(\S+ \S+) (.*)$", "yyyy-MM-dd HH:mm:ss")
    return got.select(F.unix_micros("at").alias("us"), "body")


@query(f"select event_id from {G} where starts_with(event_type, 'p') and us >= {BEGIN} and us < {END}")
def q_label_prefix(spark, d):
    g = gauges(spark, d).where(m.starts(F.col("labels"), "event_type", "p")).where(ranges.within(F.col("us"), BEGIN, END))
    return g.select(F.col("seq").alias("event_id"))


@query(f"select event_id from {G} where event_type in ('view', 'click') and user_id in (3, 5) and user_id <> 5")
def q_label_conditions(spark, d):
    found = m.where(F.col("labels"), {"event_type": ["view", "click"], "user_id": ["3", "5"]}) & m.where(F.col("labels"), {"event_type": ["view", "click"], "user_id": {"not": "5"}})
    return gauges(spark, d).where(found).select(F.col("seq").alias("event_id"))


@query(f"select event_type, count(*) n from {G} where event_type in ('view', 'error') and user_id = 8 group by all")
def q_selector(spark, d):
    e = events(spark, d).select(F.lit("x").alias("name"), "event_type", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("labels"))
    return dash.chosen(e, "kind=@kinds, user=8", {"kinds": ["view", "error"]}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"select count(*) n, min(us) >= {T0 + 4 * DAY} inside from {G} where us >= epoch_us(timestamp '2024-01-12 10:30:07' - interval 7 days) // {DAY} * {DAY} and us < epoch_us(timestamp '2024-01-12 10:30:07')")
def q_range_in_words(spark, d):
    now = T0 + 11 * DAY + 10 * HOUR + 1_807_250_000
    begin, end, _ = ranges.resolve("now-7d/d", "now", now)
    return events(spark, d).where(ranges.within(F.col("us"), begin, end)).agg(F.count(F.lit(1)).alias("n"), (F.min("us") >= T0 + 4 * DAY).alias("inside"))


@query(f"select us - us % {6 * HOUR} at_us, count(*) n from {G} where us >= {T0 + 20 * DAY - 15 * DAY} and us < {T0 + 20 * DAY} group by all")
def q_durations(spark, d):
    begin, end = ranges.span(T0 + 20 * DAY, since="15d")
    e = events(spark, d).where(ranges.within(F.col("us"), begin, end))
    return e.groupBy(ranges.bucket(F.col("us"), ranges.duration("6h")).alias("at_us")).agg(F.count(F.lit(1)).alias("n"))


@query("select epoch_us(t) run_at from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 15 minutes)) t) where hour(t) in (9, 17) and minute(t) in (0, 30) and isodow(t) between 1 and 5 and t < timestamp '2024-01-31'")
def q_cron(spark, d):
    at = cron.runs("0,30 9,17 * * 1-5", "UTC", dt.datetime(2024, 1, 1, tzinfo=dt.UTC), dt.datetime(2024, 1, 31, tzinfo=dt.UTC))
    return spark.createDataFrame([(round(x.timestamp()) * 1_000_000,) for x in at], "run_at long")


@query("select event_type, case when n_rows = 1 then 'number' when n_rows < 20 then 'bar' else 'line' end drawn from (select event_type, count(distinct date_trunc('week', ts)) n_rows from events group by all)")
def q_suggestion(spark, d):
    per = table(spark, d, "events").groupBy("event_type").agg(F.count_distinct(F.date_trunc("week", "ts")).alias("n")).collect()
    return spark.createDataFrame([(r["event_type"], dash.suggestion(1, 1, 0, r["n"])) for r in per], "event_type string, drawn string")


@query("select count(*) accepted from events where value >= 0 and isfinite(value)")
def q_refuse_unsound(spark, d):
    """Every gauge is finite: none is refused, none is dropped."""
    return m.refuse_unsound(gauges(spark, d)).where(F.col("value") >= 0).agg(F.count(F.lit(1)).alias("accepted"))
