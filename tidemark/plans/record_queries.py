"""Records over ``events``: stream and name are the event type, fields its props; log lines are the documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import bucket, within
from ..operators import records as r
from ..operators.dash import base36
from ..session import micros, table
from .metric_queries import DAY, HOUR, MINUTE, T0
from .registry import query

LEVEL = "case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'click' then null else 'info' end"
R = f"(select epoch_us(ts) us, event_id seq, event_type stream, event_type as name, {LEVEL} as level, 'user ' || user_id || ' did ' || event_type message, props fields, user_id, value, cast(json_extract_string(props, '$.k') as bigint) k from events)"


def records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_type")
    level = F.when(t == "error", "error").when(t == "purchase", "warn").when(t == "click", F.lit(None)).otherwise("info")
    return e.select(
        micros(F.col("ts")).alias("us"), F.col("event_id").alias("seq"), t.alias("stream"), t.alias("name"), level.alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), t).alias("message"), F.col("props").alias("fields"),
        F.to_json(F.struct("user_id")).alias("context"), F.sha2(F.concat(F.lit("t"), (F.col("event_id") % 500).cast("string")), 256).alias("trace_id"), "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


@query(f"select count(*) n from {R} where level in ('warn', 'error', 'fatal') and us >= {T0 + DAY} and us < {T0 + 9 * DAY}")
def q_events_count(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(r.at_least(F.col("level"), "warn")).where(within(F.col("us"), T0 + DAY, T0 + 9 * DAY)).agg(F.count(F.lit(1)).alias("n"))


@query(f"select seq, k from {R} where k = 42 or user_id = 42")
def q_events_where(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(r.spelled("k", "42", F.col("fields")) | r.spelled("user_id", "42", F.col("context"))).select("seq", "k")


@query(f"select seq from {R} where message ilike '%USER 12 did%' or cast(k as varchar) like '%USER 12 did%'")
def q_events_search(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(r.contains("USER 12 did", F.col("message"), F.col("name"), r.json_values(F.col("fields")))).select("seq")


@query(f"select us, seq from {R} order by us desc, seq desc limit 100")
def q_events_newest(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).orderBy(F.desc("us"), F.desc("seq")).limit(100).select("us", "seq")


@query(f"with x as (select us // {HOUR} * {HOUR} us, seq from {R}), p as (select *, row_number() over (order by us desc, seq desc) rn from x) select us, seq from p where rn <= 100 and us <> (select us from p where rn = 101)")
def q_events_page(spark: SparkSession, d: str) -> DataFrame:
    return r.page(records(spark, d).select(bucket(F.col("us"), HOUR).alias("us"), "seq"), 100)


@query(f"select k as value, count(*) n from {R} group by all order by n desc, value limit 10")
def q_events_top(spark: SparkSession, d: str) -> DataFrame:
    return r.top(records(spark, d), F.col("k"), 10)


@query(f"select us - us % {DAY} at_us, name, count(*) n from {R} group by all")
def q_events_hist(spark: SparkSession, d: str) -> DataFrame:
    return r.aggregate(records(spark, d), DAY, ["name"])


@query(f"select name, count(*) n, count(k) k_samples, cast(sum(k) as double) k_sum, cast(min(k) as double) k_min, cast(max(k) as double) k_max, round(cast(sum(k) as double) / count(k), 6) k_avg from {R} group by all")
def q_events_stats(spark: SparkSession, d: str) -> DataFrame:
    return r.aggregate(records(spark, d), None, ["name"], stats={"k": F.col("k")})


@query(f"select us - us % {DAY} at_us, name, count(*) n, count(distinct user_id) user_distinct from {R} group by all")
def q_events_distinct(spark: SparkSession, d: str) -> DataFrame:
    return r.aggregate(records(spark, d), DAY, ["name"], distinct={"user": F.col("user_id")})


@query("select field, count(*) n from (select unnest(json_keys(props)) field from events) group by all")
def q_field_names(spark: SparkSession, d: str) -> DataFrame:
    return r.field_names(records(spark, d), "fields")


@query(f"select stream, count(*) n, min(us) oldest, max(us) newest from {R} group by all")
def q_streams(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("oldest"), F.max("us").alias("newest"))


@query("select event_id seq, epoch_us(ts) us from events where event_id % 500 = 123")
def q_trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.sha2(F.lit("t123"), 256)
    return records(spark, d).where(F.col("trace_id") == wanted).select("seq", "us")


@query("select distinct event_id // 3 event_key from events")
def q_event_idempotent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("event_key")).dropDuplicates(["event_key"])


@query("select event_id seq from events where event_id > 1000 order by event_id limit 250")
def q_poll_batch(spark: SparkSession, d: str) -> DataFrame:
    return r.poll(records(spark, d), 1000, 250).select("seq")


@query("select event_type stream, event_id seq, coalesce(event_id - lag(event_id) over (partition by event_type order by event_id) - 1, 0) missed from events where event_id % 4 <> 1")
def q_tail_missed(spark: SparkSession, d: str) -> DataFrame:
    return r.missed(records(spark, d).where("seq % 4 <> 1").select("stream", "seq"))


@query(f"select us - us % 60000000 at_us, count(*) n from (select epoch_us(ts) us from events) where us >= {T0 + 12 * HOUR} and us < {T0 + 12 * HOUR + 30 * MINUTE} group by all")
def q_log_minute(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(within(F.col("us"), T0 + 12 * HOUR, T0 + 12 * HOUR + 30 * MINUTE)).groupBy(bucket(F.col("us"), MINUTE).alias("at_us")).agg(F.count(F.lit(1)).alias("n"))


LINES = "(select doc_id, unnest(str_split(text, chr(10))) line from documents)"


@query(f"select count(*) n from {LINES} where contains(lower(line), 'all rights reserved')")
def q_log_needle_count(spark: SparkSession, d: str) -> DataFrame:
    return r.lines_with(table(spark, d, "documents"), "doc_id", ["all rights reserved"]).agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, count(*) n from {LINES} where contains(lower(line), 'error') or contains(lower(line), 'token') group by all")
def q_log_error_count(spark: SparkSession, d: str) -> DataFrame:
    return r.lines_with(table(spark, d, "documents"), "doc_id", ["error", "token"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, n_chars from documents order by doc_id desc limit 100")
def q_log_newest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("doc_id")).limit(100)


@query("with l as (select doc_id, unnest(range(len(str_split(text, chr(10))))) no, unnest(str_split(text, chr(10))) line from documents), g as (select *, sum(case when regexp_matches(line, '^(\\s|[}\\])]|at |Caused by:|\\.\\.\\. \\d+ more|Traceback \\(most)') then 0 else 1 end) over (partition by doc_id order by no) event from l) select doc_id, event, count(*) as lines, sha256(string_agg(line, chr(10) order by no)) body_sha from g group by all", longs="event")
def q_log_lines_multiline(spark: SparkSession, d: str) -> DataFrame:
    out = r.multi_line(r.lines_of(table(spark, d, "documents"), "doc_id"), ["doc_id"], "no")
    return out.select("doc_id", "event", "lines", F.sha2("body", 256).alias("body_sha"))


@query("""select event_id, case event_id % 6 when 0 then 'info' when 1 then 'warn' when 2 then 'error' when 3 then 'fatal' when 4 then 'debug' end as level from events""")
def q_log_level_detect(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    forms = [F.concat(F.lit('{"level":30,"msg":"'), i, F.lit('"}')), F.concat(F.lit("ts=1 level=warning n="), i), F.concat(F.lit("E0203 12:00:00 file.cc:1] "), i), F.concat(F.lit("2024-01-01 FATAL "), i), F.concat(F.lit('{"level":"debug","n":'), i, F.lit("}")), F.concat(F.lit("plain line "), i)]
    line = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", r.detect_level(line).alias("level"))


@query("select event_id, event_type as type, cast(user_id as varchar) as user from events")
def q_logfmt(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("at="), F.col("event_id").cast("string"), F.lit(' type="'), F.col("event_type"), F.lit('" user='), F.col("user_id").cast("string"))
    m = r.logfmt(line)
    return table(spark, d, "events").select("event_id", m["type"].alias("type"), m["user"].alias("user"))


@query("""select event_id, '{"user":' || user_id || ',"api_key":"[redacted]","url":"http://u:[redacted]@h/"}' clean from events""")
def q_redact(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"api_key":"k'), F.col("event_id").cast("string"), F.lit('","url":"http://u:pw@h/"}'))
    return table(spark, d, "events").select("event_id", r.redact(raw).alias("clean"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k, json_exists(props, '$.k') has_k from events")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k"))


@query("select 'k' path, count(*) n from events")
def q_udtf_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("json"))
    return e.mapInPandas(r.flatten_values, "id long, path string, value string").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id folder, strlen(text) size, sha256(text) etag, lower(to_base(doc_id + 1000000, 36)) short from documents""")
def q_sha_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("folder"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("etag"), base36(F.col("doc_id") + 1_000_000).alias("short"))


@query("select source folder, count(*) files, sum(strlen(text)) bytes from documents group by all", longs="bytes")
def q_folder_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query("select user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) over w) // 1000000 idle_s, sum(case when lag is null or epoch_us(ts) - lag > 3600000000 then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) run from (select *, lag(epoch_us(ts)) over (partition by user_id order by ts) lag from events) window w as (partition by user_id order by ts)", longs="run")
def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us")
    e = table(spark, d, "events").withColumn("us", micros(F.col("ts"))).withColumn("idle", F.col("us") - F.lag("us").over(w))
    begins = F.when(F.col("idle").isNull() | (F.col("idle") > HOUR), 1).otherwise(0)
    return e.select("user_id", "event_id", F.floor(F.col("idle") / 1_000_000).alias("idle_s"), F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


@query(f"select at_us, event_type, count(*) n from (select us - us % {HOUR} + (i - 3) * {HOUR} at_us, us, event_type from (select epoch_us(ts) us, event_type from events), range(4) t(i)) where us >= at_us and us < at_us + {4 * HOUR} group by all")
def q_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window(F.col("ts"), "4 hours", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(micros(F.col("window.start")).alias("at_us"), "event_type", "n")


@query("select strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d') zone_day, count(*) n from events group by all")
def q_zone_calendar_day(spark: SparkSession, d: str) -> DataFrame:
    local = F.col("ts") + F.expr("interval 9 hours")  # Tokyo has no summer time
    return table(spark, d, "events").groupBy(F.date_format(local, "yyyy-MM-dd").alias("zone_day")).agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(timezone('Europe/Berlin', timezone('UTC', ts + interval 80 days)), '%Y-%m-%d') zone_day, count(*) n from events group by all")
def q_zone_day(spark: SparkSession, d: str) -> DataFrame:
    at = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.col("ts") + F.expr("interval 80 days"))
    return table(spark, d, "events").groupBy(F.date_format(at, "yyyy-MM-dd").alias("zone_day")).agg(F.count(F.lit(1)).alias("n"))
