"""State machines over logs made of ``orders`` and ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state as st
from ..session import micros, shared_dir, table
from .metric_queries import DAY, HOUR, T0
from .registry import query

NOW = 946_684_800_000_000  # 2000-01-01


def log(spark, d):
    o = table(spark, d, "orders")
    at = micros(F.col("o_orderdate"))
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 3 == 0, at + 400 * DAY).alias("expires"))


@query(f"select key, version, value from (select o_custkey as key, o_orderkey as version, o_totalprice as value, case when o_orderkey % 3 = 0 then epoch_us(o_orderdate) + {400 * DAY} end expires, row_number() over (partition by o_custkey order by o_orderkey desc) rn from orders) where rn = 1 and (expires is null or expires > {NOW})")
def q_kv_latest(spark, d):
    return st.latest(log(spark, d), "key", "version", NOW, "expires").select("key", "version", "value")


@query("select c_mktsegment prefix, count(*) keys, sum(strlen(c_name)) bytes from customer group by all", longs="bytes")
def q_kv_prefix_inventory(spark, d):
    c = table(spark, d, "customer").select(F.concat_ws(":", "c_mktsegment", "c_custkey").alias("key"), "c_name")
    return c.groupBy(F.split("key", ":")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.octet_length("c_name")).alias("bytes"))


def calls(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("user"), micros(F.col("ts")).alias("at"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("amount"))


CALLS = "(select user_id u, event_id seq, epoch_us(ts) us, row_number() over (partition by user_id order by epoch_us(ts), event_id) rn from events)"


@query(f"with recursive c as {CALLS}, w as (select u, seq, us, rn, us b, 1 total from c where rn = 1 union all select c.u, c.seq, c.us, c.rn, case when c.us >= w.b + {DAY} then c.us else w.b end, case when c.us >= w.b + {DAY} then 1 else w.total + 1 end from w join c on c.u = w.u and c.rn = w.rn + 1) select u as user, seq, b window_begin, total from w", longs="total")
def q_counter_windows(spark, d):
    return st.counter_windows(calls(spark, d), "user", "at", "amount", DAY)


EACH = DAY // 3


@query(f"""with recursive c as {CALLS}, w as (select u, seq, us, rn, us base, us + {EACH} tat, true ok from c where rn = 1
union all select u, seq, us, rn, base, case when base - us > {DAY - EACH} then tat else base + {EACH} end, base - us <= {DAY - EACH} from (select c.u, c.seq, c.us, c.rn, greatest(c.us, w.tat) base, w.tat from w join c on c.u = w.u and c.rn = w.rn + 1))
select u as user, seq, ok, case when ok then ({DAY} - (tat - us)) // {EACH} else 0 end tokens_left, case when ok then us else base - {DAY - EACH} end retry_at from w""", longs="tokens_left retry_at")
def q_rate_limit(spark, d):
    return st.rate_limit(calls(spark, d), "user", "at", 3, DAY)


@query(f"select user_id as user, event_id seq, row_number() over (partition by user_id, epoch_us(ts) // {DAY} order by ts) <= 2 ok from events")
def q_quota(spark, d):
    return st.quota(calls(spark, d), "user", "at", {DAY: 2})


@query("select user_id as user, min(event_id) seq from events where event_type <> 'error' group by all")
def q_once(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return st.once(e, "user", "seq", "ok").select("user", "seq")


JOB = f"case when o_orderstatus = 'F' then 'done' when o_orderkey % 5 >= 4 then 'failed' when o_orderkey % 11 = 0 then 'running' when epoch_us(o_orderdate) > {NOW} then 'scheduled' else 'waiting' end"


def jobs(spark, d):
    o = table(spark, d, "orders")
    j = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), micros(F.col("o_orderdate")).alias("at"), (F.col("o_orderkey") % 5).alias("attempts"), F.lit(4).alias("most"), (F.col("o_orderkey") % 11 == 0).alias("running"), (F.col("o_orderstatus") == "F").alias("done"))
    return st.job_states(j, NOW)


@query(f"select {JOB} state, count(*) n from orders group by all")
def q_jobs_state(spark, d):
    return jobs(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"select id, grp from (select *, row_number() over (partition by grp order by at_us, id) rn from (select o_orderkey id, o_custkey grp, epoch_us(o_orderdate) at_us, {JOB} state from orders) where state = 'waiting') where rn = 1")
def q_jobs_due(spark, d):
    return st.claim(jobs(spark, d), "grp", ["at", "id"]).select("id", "grp")


@query("select o_orderkey id, least(1000 * pow(2, o_orderkey % 5 - 1), 5000)::bigint delay from orders where o_orderkey % 5 > 0")
def q_job_backoff(spark, d):
    return jobs(spark, d).where("attempts > 0").select("id", st.backoff(1000, "attempts", 5000).alias("delay"))


@query(f"select id, unnest(range({T0} + id * {HOUR}, {T0 + DAY} + 1, {6 * HOUR})) run_at from range(10) t(id)")
def q_schedule_every(spark, d):
    ids = spark.range(10).withColumn("begin", F.lit(T0) + F.col("id") * HOUR)
    return st.schedule(ids, "begin", 6 * HOUR, T0 + DAY).select("id", "run_at")


@query(f"with s as (select user_id, event_type, min(epoch_us(ts)) f from events group by all order by f, user_id, event_type limit 100), t as (select coalesce(cast(s.user_id as varchar), '__overflow') user_id, coalesce(s.event_type, '__overflow') event_type, epoch_us(ts) // {DAY} * {DAY} at_us, value v from events e left join s on e.user_id = s.user_id and e.event_type = s.event_type) select user_id, event_type, at_us, round(fsum(v), 6) added from t group by all")
def q_instrument_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", micros(F.col("ts")).alias("us"), "value")
    return st.instruments(e, ["user_id", "event_type"], "us", "value", DAY, 100).withColumn("added", F.round("added", 6))


@query("select conv_id, count(*) turns, max(turn) last_turn from conversations group by all")
def q_document_store(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.to_json(F.struct("turn", "role")).alias("value"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max(F.get_json_object("value", "$.turn").cast("long")).alias("last_turn"))


@query("select 'STRUCT<k: BIGINT>' as type, count(*) n from events")
def q_json_schema_inference(spark, d):
    return table(spark, d, "events").agg(F.schema_of_json_agg("props").alias("type"), F.count(F.lit(1)).alias("n")) if hasattr(F, "schema_of_json_agg") else table(spark, d, "events").groupBy(F.concat(F.lit("STRUCT<"), F.array_join(F.transform(F.json_object_keys("props"), lambda k: F.concat(k, F.lit(": BIGINT"))), ", "), F.lit(">")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) before from conversations")
def q_conversation_order(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query()
def q_jobs_log(spark, d):
    e = table(spark, d, "events")
    ops = {"view": "add", "click": "set", "signup": "start", "purchase": "done", "error": "error"}
    op = F.create_map(*(F.lit(x) for pair in ops.items() for x in pair))[F.col("event_type")]
    return st.job_log(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("at"), op.alias("op"), F.col("props").alias("value"), F.lit(None).cast("long").alias("due")))


@query(f"select user_id as user, event_id seq, us + {6 * HOUR} run_at from (select user_id, event_id, epoch_us(ts) us, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) nx from events) where nx is null or nx >= us + {6 * HOUR}")
def q_debounce(spark, d):
    return st.debounce(calls(spark, d), "user", "at", 6 * HOUR).select("user", "seq", "run_at")


@query(f"with recursive c as {CALLS}, w as (select u, seq, us, rn, us b, true added from c where rn = 1 union all select c.u, c.seq, c.us, c.rn, case when c.us >= w.b + {DAY} then c.us else w.b end, c.us >= w.b + {DAY} from w join c on c.u = w.u and c.rn = w.rn + 1) select u as user, seq, added, b + {DAY} run_at from w")
def q_throttle(spark, d):
    return st.throttle(calls(spark, d), "user", "at", DAY)


@query("select event_type instance, count(*) n, max(epoch_us(ts)) window_end from events group by all")
def q_flow_collect(spark, d):
    """Two runs that read the same window: the dataset holds each event once."""
    from ..operators.flows import Run

    at = f"{shared_dir(spark)}/tidemark-flow-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_type", micros(F.col("ts")).alias("us"), "user_id", "value")
    for run in ("r1", "r2"):
        Run(spark, at, "collect", run).collect("events", lambda: rows, f"{at}/dataset", "event_type", "us")
    return spark.read.parquet(f"{at}/dataset").groupBy(F.col("event_type").alias("instance")).agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("window_end"))


BREACH = "(select user_id, max(value) > 60 breach from events where user_id % 7 <> 0 group by all)"


@query(f"select cast(user_id as varchar) subject, case when user_id % 2 = 0 then 'firing' else 'ok' end was, case when breach then 'firing' else 'ok' end state, 'watch/r1/commit/' || user_id as operation from {BREACH} where (user_id % 2 = 0) <> breach")
def q_flow_transitions(spark, d):
    """Who moves from which state to which, and the notification that was written with the new state."""
    from ..operators.flows import Run

    e = table(spark, d, "events")
    states = e.select("user_id").distinct().select(F.col("user_id").cast("string").alias("subject"), F.when(F.col("user_id") % 2 == 0, "firing").otherwise("ok").alias("state"))
    run = Run(spark, f"{shared_dir(spark)}/tidemark-flow-{uuid.uuid4().hex}", "watch", "r1")
    found = e.groupBy("user_id").agg((F.max("value") > 60).alias("b")).select(F.col("user_id").cast("string").alias("subject"), F.when(F.col("user_id") % 7 != 0, F.col("b")).alias("breach"))
    moved = run.evaluate("evaluate", lambda: found, states)
    told = run.commit("commit", moved, states).where("kind = 'notify'")
    return moved.join(told.select("subject", "operation"), "subject")
