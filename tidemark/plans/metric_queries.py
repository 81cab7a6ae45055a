"""Metrics over ``events``: gauge ``value``, a counter of its running sum, a timer of its bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.ranges import bucket, within
from ..operators import metrics as m
from ..session import micros, table
from .registry import query

HOUR, DAY, MINUTE = 3_600_000_000, 86_400_000_000, 60_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01
BEGIN, END = T0 + 3 * DAY + HOUR // 2, T0 + 10 * DAY + HOUR // 2
BOUNDS = [1, 5, 10, 25, 50, 100, 250]
G = "(select event_id, epoch_us(ts) us, user_id, event_type, value, cast(value as decimal(18,2)) v from events)"
C = f"(select event_id, us, user_id, event_type, case when event_id % 97 = 0 then 0 else sum(v) over (partition by event_type, user_id order by us, event_id rows unbounded preceding) end v from {G})"
S = f"(select *, lag(v) over w p, lag(us) over w b from {C} where us < {END} window w as (partition by event_type, user_id order by us, event_id))"
IN = f"us >= {BEGIN} and us < {END}"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("us", micros(F.col("ts")))


def gauges(spark: SparkSession, d: str) -> DataFrame:
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    return events(spark, d).select(F.lit("value").alias("name"), F.lit("gauge").alias("kind"), labels.alias("labels"), "us", "value", F.col("event_id").alias("seq"))


def counters(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d)
    run = F.sum(F.col("value").cast("decimal(18,2)")).over(Window.partitionBy(m.series_key()).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumns({"name": F.lit("total"), "kind": F.lit("counter"), "value": F.when(F.col("seq") % 97 == 0, 0.0).otherwise(run.cast("double"))})


def by_type(df: DataFrame) -> DataFrame:
    return df.withColumn("grp", F.regexp_extract("grp", '"event_type","value":"([a-z]+)"', 1))


@query(f"select event_type grp, us - us % {HOUR} at_us, round(fsum(value / 7), 6) total, count(*) samples from {G} where {IN} group by all")
def q_metric_sum_exact(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d).withColumn("value", F.col("value") / 7)
    return by_type(m.aggregate(g, "sum", BEGIN, END, HOUR, by=["event_type"])).select("grp", F.col("at").alias("at_us"), F.round("value", 6).alias("total"), "samples")


@query(f"select event_type grp, us - us % {DAY} at_us, round(fsum(value / 7) / count(*), 6) mean from {G} where {IN} group by all")
def q_metric_avg(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d).withColumn("value", F.col("value") / 7)
    return by_type(m.aggregate(g, "avg", BEGIN, END, DAY, by=["event_type"])).select("grp", F.col("at").alias("at_us"), F.round("value", 6).alias("mean"))


@query(f"select us - us % {HOUR} at_us, count(*) n from {G} where {IN} group by all")
def q_metric_count(spark: SparkSession, d: str) -> DataFrame:
    return m.aggregate(gauges(spark, d), "count", BEGIN, END, HOUR).select(F.col("at").alias("at_us"), F.col("value").alias("n"))


@query(f"select event_type grp, us - us % {HOUR} at_us, min(value) low, max(value) high from {G} where {IN} group by all")
def q_metric_minmax(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d).where(within(F.col("us"), BEGIN, END))
    return g.groupBy(F.col("labels")["event_type"].alias("grp"), bucket(F.col("us"), HOUR).alias("at_us")).agg(F.min("value").alias("low"), F.max("value").alias("high"))


STEP = "case when p is null then null when v >= p then v - p else v end"


@query(f"select event_type grp, us - us % {DAY} at_us, round(cast(coalesce(sum({STEP}), 0) as double), 6) added, count(*) samples from {S} where {IN} group by all")
def q_metric_increase(spark: SparkSession, d: str) -> DataFrame:
    return by_type(m.aggregate(counters(spark, d), "increase", BEGIN, END, DAY, by=["event_type"])).select("grp", F.col("at").alias("at_us"), F.round("value", 6).alias("added"), "samples")


@query(f"select event_type grp, count_if(v < p) resets from {S} where {IN} group by all", longs="resets")
def q_metric_resets(spark: SparkSession, d: str) -> DataFrame:
    return by_type(m.aggregate(counters(spark, d), "increase", BEGIN, END, None, by=["event_type"])).select("grp", "resets")


@query(f"""select event_type grp, us - us % {DAY} at_us, round(cast(coalesce(sum({STEP}), 0) as double) / ((least(us - us % {DAY} + {DAY}, {END}) - greatest(us - us % {DAY}, {BEGIN})) / 1e6), 9) per_second
from {S} where {IN} group by event_type, us - us % {DAY}""")
def q_metric_rate(spark: SparkSession, d: str) -> DataFrame:
    return by_type(m.aggregate(counters(spark, d), "rate", BEGIN, END, DAY, by=["event_type"])).select("grp", F.col("at").alias("at_us"), F.round("value", 9).alias("per_second"))


@query(f"select event_type grp, us - us % {DAY} at_us, round(cast(coalesce(sum(v - p), 0) as double), 6) delta from (select *, lag(v) over (partition by event_type, user_id order by us, event_id) p from {G} where us < {END}) where {IN} group by all")
def q_metric_delta(spark: SparkSession, d: str) -> DataFrame:
    return by_type(m.aggregate(gauges(spark, d), "delta", BEGIN, END, DAY, by=["event_type"])).select("grp", F.col("at").alias("at_us"), (F.round("value", 6) + 0.0).alias("delta"))


@query(f"select event_type grp, at_us, round(fsum(v), 6) last_sum from (select event_type, user_id, us - us % {DAY} at_us, arg_max(value / 7, us) v from {G} where {IN} group by all) group by all")
def q_metric_last_group(spark: SparkSession, d: str) -> DataFrame:
    return by_type(m.aggregate(gauges(spark, d).withColumn("value", F.col("value") / 7), "last", BEGIN, END, DAY, by=["event_type"])).select("grp", F.col("at").alias("at_us"), F.round("value", 6).alias("last_sum"))


@query(f"select event_type grp, round(fsum(v), 6) first_sum from (select event_type, user_id, arg_min(value / 7, us) v from {G} where {IN} group by all) group by all")
def q_metric_first_group(spark: SparkSession, d: str) -> DataFrame:
    return by_type(m.aggregate(gauges(spark, d).withColumn("value", F.col("value") / 7), "first", BEGIN, END, None, by=["event_type"])).select("grp", F.round("value", 6).alias("first_sum"))


@query(f"select event_type, pct, value from (select event_type, value, row_number() over (partition by event_type order by value) rn, count(*) over (partition by event_type) n from {G}), (values ('p50', 50, 100), ('p95', 95, 100), ('p99.9', 999, 1000)) t(pct, num, den) where rn = greatest(1, (num * n + den - 1) // den)")
def q_metric_percentile(spark: SparkSession, d: str) -> DataFrame:
    return m.nearest_ranks(events(spark, d), ["event_type"], "value", {"p50": (50, 100), "p95": (95, 100), "p99.9": (999, 1000)}).drop("samples")


LE = "(select unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::double]) le)"
CUM = f"(select event_type, le, count_if(value <= le) n from {G}, {LE} group by all)"
PCT = f"(select *, (95 * total + 99) // 100 need from (select event_type, le, n, coalesce(lag(le) over w, 0) low, coalesce(lag(n) over w, 0) under, max(n) over (partition by event_type) total from {CUM} window w as (partition by event_type order by le)) where total > 0)"


@query(f"select event_type, low lower_bound, case when le = 'inf' then -1 else le end upper_bound, total samples from {PCT} where n >= need and under < need", longs="samples")
def q_timer_percentile(spark: SparkSession, d: str) -> DataFrame:
    b = m.cumulative(events(spark, d), ["event_type"], "value", BOUNDS)
    return m.bucket_percentile(b, ["event_type"], 95, 100).select("event_type", F.col("lower").alias("lower_bound"), F.when(F.col("upper") == float("inf"), -1.0).otherwise(F.col("upper")).alias("upper_bound"), "samples")


@query(f"select event_type, round(case when le = 'inf' then low else low + (le - low) * (0.95 * total - under) / (n - under) end, 6) estimate from {PCT} where n >= need and under < need")
def q_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    b = m.cumulative(events(spark, d), ["event_type"], "value", BOUNDS)
    return m.bucket_percentile(b, ["event_type"], 95, 100).select("event_type", F.round("estimate", 6).alias("estimate"))


@query(f"select le_text, n from (select case when le = 'inf' then '+Inf' else cast(cast(le as bigint) as varchar) end le_text, count_if(value <= le) n from {G}, {LE} where event_type <> 'click' or le not in (25, 50) group by all) where le_text not in ('25', '50')", longs="n")
def q_timer_shared_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = m.cumulative(events(spark, d), ["event_type"], "value", BOUNDS).where("event_type <> 'click' or le not in (25, 50)").withColumn("timer", F.lit("t"))
    text = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("long").cast("string"))
    return m.shared_bounds(b, ["timer"], "event_type").select(text.alias("le_text"), "n")


@query(f"select event_type, i, count(*) n from {G}, (select i, pow(2, (i - 1) / 8.0) lo, pow(2, i / 8.0) hi from range(-80, 161) t(i)) where value > lo and value <= hi group by all")
def q_exp_histogram(spark: SparkSession, d: str) -> DataFrame:
    return m.exponential(events(spark, d), ["event_type"], "value").withColumn("i", F.col("i").cast("long"))


@query(f"select event_type, i, count(*) n from {G}, (select i, pow(2, (i - 1) / 4.0) lo, pow(2, i / 4.0) hi from range(-40, 81) t(i)) where value > lo and value <= hi group by all")
def q_exp_histogram_coarser(spark: SparkSession, d: str) -> DataFrame:
    return m.coarser(m.exponential(events(spark, d), ["event_type"], "value"), ["event_type"]).withColumn("i", F.col("i").cast("long"))


@query(f"select event_type, count(*) n, round(fsum(value / 7), 6) total, round(fsum(value / 7) / count(*), 6) mean, max(value) high from {G} group by all")
def q_timer_avg(spark: SparkSession, d: str) -> DataFrame:
    out = exact.sums(events(spark, d), ["event_type"], {"total": [F.col("value") / 7]}, {"n": (F.count(F.lit(1)), "sum"), "high": (F.max("value"), "max")})
    return out.select("event_type", "n", F.round("total", 6).alias("total"), F.round(F.col("total") / F.col("n"), 6).alias("mean"), "high")


@query(f"select us - us % {DAY} at_us, event_type, le, count_if(value <= le) n from (select * from {G}), (select unnest([1, 5, 10, 25, 50, 100, 250]::double[]) le) group by all", longs="n")
def q_heatmap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("at_us", bucket(F.col("us"), DAY))
    return m.cumulative(e, ["at_us", "event_type"], "value", BOUNDS).where(F.col("le") < float("inf"))


@query(f"select user_id, event_type, us, value from (select *, row_number() over (partition by user_id, event_type order by us desc) rn from {G} where {IN}) where rn = 1")
def q_metric_latest(spark: SparkSession, d: str) -> DataFrame:
    series = F.from_json("series", "array<struct<key:string,value:string>>")
    out = m.latest(gauges(spark, d), BEGIN, END).withColumn("l", F.map_from_entries(series))
    return out.select(F.col("l")["user_id"].cast("long").alias("user_id"), F.col("l")["event_type"].alias("event_type"), "us", "value")


@query(f"select user_id, event_type, us, value from (select *, row_number() over (partition by user_id, event_type order by us desc) rn from {G} where us < {BEGIN}) where rn = 1")
def q_asof_previous(spark: SparkSession, d: str) -> DataFrame:
    series = F.from_json("series", "array<struct<key:string,value:string>>")
    out = m.before_range(gauges(spark, d), BEGIN).withColumn("l", F.map_from_entries(series))
    return out.select(F.col("l")["user_id"].cast("long").alias("user_id"), F.col("l")["event_type"].alias("event_type"), "us", "value")


@query(f"select us - us % {DAY} at_us, count(*) n, round(fsum(value / 7), 6) total, min(value / 7) low, max(value / 7) high, arg_min(value / 7, us) first_value, arg_max(value / 7, us) last_value from {G} group by all")
def q_rollup_reaggregate(spark: SparkSession, d: str) -> DataFrame:
    r = m.roll_again(m.rollup(gauges(spark, d).withColumn("value", F.col("value") / 7), HOUR, ["name"]), HOUR, DAY, ["name"])
    return r.select(F.col("at").alias("at_us"), "n", F.round("total", 6).alias("total"), "low", "high", F.col("first").alias("first_value"), F.col("last").alias("last_value"))


@query(f"select event_type grp, count(*) samples, round(fsum(value), 6) total from {G} where {IN} and user_id in (1, 2, 3) group by all")
def q_metric_group_by(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d).where(m.where(F.col("labels"), {"user_id": ["1", "2", "3"]}))
    return by_type(m.aggregate(g, "sum", BEGIN, END, None, by=["event_type"])).select("grp", "samples", F.round("value", 6).alias("total"))


@query(f"select cast(user_id as varchar) grp, count(*) samples, max(value) high from {G} where {IN} group by all")
def q_metric_group_without(spark: SparkSession, d: str) -> DataFrame:
    out = m.aggregate(gauges(spark, d), "max", BEGIN, END, None, without=["event_type"])
    return out.select(F.regexp_extract("grp", '"user_id","value":"([0-9]+)"', 1).alias("grp"), "samples", F.col("value").alias("high"))


@query(f"select us - us % {DAY} at_us, (us - us % {DAY} < {BEGIN} or us - us % {DAY} + {DAY} > {END}) partial from {G} where {IN} group by all")
def q_metric_partial(spark: SparkSession, d: str) -> DataFrame:
    return m.aggregate(gauges(spark, d), "count", BEGIN, END, DAY).select(F.col("at").alias("at_us"), "partial")


@query(f"select event_type, user_id, us - us % {HOUR} at_us, coalesce(max(b - b % {HOUR} < us - us % {HOUR} - {HOUR}), false) gap from {S} where {IN} group by all")
def q_metric_gap(spark: SparkSession, d: str) -> DataFrame:
    l = F.map_from_entries(F.from_json("grp", "array<struct<key:string,value:string>>"))  # noqa: E741
    return m.aggregate(counters(spark, d), "increase", BEGIN, END, HOUR, without=[]).select(l["event_type"].alias("event_type"), l["user_id"].cast("long").alias("user_id"), F.col("at").alias("at_us"), "gap")


@query(f"select us, event_id, user_id, value from {G} where event_type not in ('view', 'click') and {IN}")
def q_label_none_of(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d).where(m.none_of(F.col("labels"), "event_type", ["view", "click"]) & m.none_of(F.col("labels"), "absent", ["x"])).where(within(F.col("us"), BEGIN, END))
    return g.select("us", F.col("seq").alias("event_id"), F.col("labels")["user_id"].cast("long").alias("user_id"), "value")


@query(f"select event_id, us from {G} where starts_with(event_type, 'si') and us >= {BEGIN} and us < {END}")
def q_range_half_open(spark: SparkSession, d: str) -> DataFrame:
    return gauges(spark, d).where(m.where(F.col("labels"), {"event_type": {"prefix": "si"}})).where(within(F.col("us"), BEGIN, END)).select(F.col("seq").alias("event_id"), "us")


@query(f"select event_id from {G} where event_type = 'view' and user_id in (3, 5, 7) intersect select event_id from {G} where value > 5")
def q_postings_intersect(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d)
    a = g.where(m.where(F.col("labels"), {"event_type": "view", "user_id": ["3", "5", "7"]})).select(F.col("seq").alias("event_id"))
    return a.intersect(g.where("value > 5").select(F.col("seq").alias("event_id")))


@query("select 'value' as name, 'gauge' as kind, count(distinct (event_type, user_id)) series, max(epoch_us(ts)) newest from events")
def q_metric_names(spark: SparkSession, d: str) -> DataFrame:
    return m.names(gauges(spark, d))


@query("select distinct event_type as value from events")
def q_label_values(spark: SparkSession, d: str) -> DataFrame:
    return m.label_values(gauges(spark, d), "event_type")


@query("select distinct user_id % 7 variable from events")
def q_variable_values(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select((F.col("user_id") % 7).alias("variable")).distinct()


@query(f"select user_id, at_us, event_id, value from (select *, us - us % {HOUR} at_us, row_number() over (partition by user_id, us - us % {HOUR} order by event_id desc) rn from {G}) where rn = 1")
def q_metrics_dedupe(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(spark, d).withColumns({"us": bucket(F.col("us"), HOUR), "labels": F.map_filter("labels", lambda k, _: k == "user_id")})
    return m.dedupe(g).select(F.col("labels")["user_id"].cast("long").alias("user_id"), F.col("us").alias("at_us"), F.col("seq").alias("event_id"), "value")


NOW = T0 + 20 * DAY


@query(f"select coalesce(case when us < {NOW - 10 * DAY} then 'too old' when us > {NOW + 10 * MINUTE} then 'too new' end, 'accepted') reason, count(*) n from {G} group by all")
def q_admission_split(spark: SparkSession, d: str) -> DataFrame:
    why = m.admission(F.col("us"), NOW, 10 * DAY, 10 * MINUTE)
    return gauges(spark, d).groupBy(F.coalesce(why, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select event_id from {G} where us >= {NOW - 7 * DAY} and us < {NOW}")
def q_retention_filter(spark: SparkSession, d: str) -> DataFrame:
    return gauges(spark, d).where(within(F.col("us"), NOW - 7 * DAY, NOW)).select(F.col("seq").alias("event_id"))


@query(f"select event_type, count(distinct user_id) series, count(*) samples, count(*) * 16 bytes, count(*) > 100000 exceeds from {G} where {IN} group by all")
def q_explain_cost(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).where(within(F.col("us"), BEGIN, END)).groupBy("event_type").agg(F.countDistinct("user_id").alias("series"), F.count(F.lit(1)).alias("samples"))
    return g.select("event_type", "series", "samples", (F.col("samples") * 16).alias("bytes"), (F.col("samples") > 100_000).alias("exceeds"))


# The benchmark shapes: an event type is a metric, a user a host.
@query(f"select us, value from {G} where event_type = 'view' and user_id = 8")
def q_tsbs_raw_1_host(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'view' and user_id = 8").select("us", "value")


@query(f"select event_type, user_id, us - us % {MINUTE} at_us, max(value) high from {G} where user_id < 8 and us >= {T0 + DAY} and us < {T0 + DAY + 12 * HOUR} group by all")
def q_tsbs_single_groupby(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where(F.col("user_id") < 8).where(within(F.col("us"), T0 + DAY, T0 + DAY + 12 * HOUR))
    return e.groupBy("event_type", "user_id", bucket(F.col("us"), MINUTE).alias("at_us")).agg(F.max("value").alias("high"))


@query(f"select event_type, us - us % {HOUR} at_us, max(value) high from {G} where user_id < 8 and us >= {T0 + DAY} and us < {T0 + DAY + 8 * HOUR} group by all")
def q_tsbs_cpu_max_all(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where(F.col("user_id") < 8).where(within(F.col("us"), T0 + DAY, T0 + DAY + 8 * HOUR))
    return e.groupBy("event_type", bucket(F.col("us"), HOUR).alias("at_us")).agg(F.max("value").alias("high"))


@query(f"select user_id, us - us % {HOUR} at_us, round(fsum(value) / count(*), 6) mean from {G} where us >= {T0 + DAY} and us < {T0 + DAY + 12 * HOUR} group by all")
def q_tsbs_double_groupby(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where(within(F.col("us"), T0 + DAY, T0 + DAY + 12 * HOUR))
    out = exact.sums(e.select("user_id", bucket(F.col("us"), HOUR).alias("at_us"), "value"), ["user_id", "at_us"], {"total": [F.col("value")]}, {"n": (F.count("value"), "sum")})
    return out.select("user_id", "at_us", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@query(f"select event_id, us, value from {G} where user_id = 8 and us >= {T0 + 2 * DAY} and us < {T0 + 9 * DAY}")
def q_series_hour(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("user_id = 8").where(within(F.col("us"), T0 + 2 * DAY, T0 + 9 * DAY)).select("event_id", "us", "value")


@query(f"select user_id, count(*) n from {G} where event_type = 'error' group by all")
def q_wide_read(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"select event_type stream, us - us % {10 * MINUTE} at_us, count(*) n from {G} group by all")
def q_stream_window_count(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.col("event_type").alias("stream"), bucket(F.col("us"), 10 * MINUTE).alias("at_us")).agg(F.count(F.lit(1)).alias("n"))


@query("select r_name, epoch_us(o_orderdate) // 2592000000000 * 2592000000000 at_us, round(fsum(o_totalprice), 4) total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def q_region_hour_sum(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = j.select("r_name", bucket(micros(F.col("o_orderdate")), 30 * DAY).alias("at_us"), "o_totalprice")
    return exact.sums(rows, ["r_name", "at_us"], {"total": [F.col("o_totalprice")]}).withColumn("total", F.round("total", 4))


@query(f"select event_type, sum((value / 7 * pow(2, 70))::hugeint)::double / pow(2, 70) total from {G} group by all")
def q_exact_sum(spark: SparkSession, d: str) -> DataFrame:
    return m.exact_sum(events(spark, d).select("event_type", (F.col("value") / 7).alias("total")), ["event_type"], "total")


@query("select event_type, user_id, us, event_id from (select event_type, user_id, epoch_us(ts) us, event_id, row_number() over (order by event_type, cast(user_id as varchar), epoch_us(ts), event_id) rn from events) where rn between 501 and 1000")
def q_metric_pages(spark: SparkSession, d: str) -> DataFrame:
    last = m.page(gauges(spark, d), 500).orderBy(F.desc("series"), F.desc("us"), F.desc("seq")).first()
    rows = m.page(gauges(spark, d), 500, (last["name"], last["series"], last["us"], last["seq"]))
    return rows.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].cast("long").alias("user_id"), "us", F.col("seq").alias("event_id"))
