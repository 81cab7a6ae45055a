"""Profiles, keys and questions over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import dash, metrics, see
from ..session import table
from .registry import query

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
TABLES = [*KEYS, "lineitem"]
PROFILED = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query(" union all ".join(f"select 'customer' as \"table\", '{c}' as \"column\", '{k}' as type, count(*) as rows, count(*) - count({c}) nulls, count(distinct {c}) \"distinct\" from customer" for c, k in PROFILED))
def q_profile_columns(spark, d):
    return see.profile(table(spark, d, "customer"), "customer").drop("width")


STATS = [("customer", "c_mktsegment"), ("customer", "c_custkey"), ("orders", "o_orderpriority"), ("orders", "o_custkey")]


@query(" union all ".join(f"select '{t}' as \"table\", '{c}' as \"column\", round((count(*) - count({c})) / cast(count(*) as double), 6) null_frac, round(avg(strlen(cast({c} as varchar))), 6) avg_width, round(case when count(distinct {c}) > 0.1 * count(*) then -count(distinct {c}) / cast(count(*) as double) else count(distinct {c}) end, 6) n_distinct from {t}" for t, c in STATS))
def q_column_statistics(spark, d):
    found = [(t, c, see.column_statistics(table(spark, d, t), c)) for t, c in STATS]
    return spark.createDataFrame([(t, c, round(x["null_frac"], 6), round(x["avg_width"], 6), round(float(x["n_distinct"]), 6)) for t, c, x in found], "`table` string, `column` string, null_frac double, avg_width double, n_distinct double")


@query("select c_mktsegment as value, count(*) n from customer group by all order by n desc, value limit 30")
def q_profile_mcv(spark, d):
    return see.common_values(table(spark, d, "customer"), "c_mktsegment")


@query("select part, bound from (select l_quantity bound, row_number() over (order by l_quantity) rn, count(*) over () n from lineitem), range(11) t(part) where rn = greatest(1, (part * n + 9) // 10)")
def q_profile_histogram(spark, d):
    return see.histogram(table(spark, d, "lineitem"), "l_quantity", 10)


@query("select o_orderpriority as value, count(*) n from orders group by all order by n desc, value limit 30")
def q_see_probe(spark, d):
    return see.common_values(table(spark, d, "orders"), "o_orderpriority")


def roles(spark, d, tables=("orders", "customer")) -> dict[str, dict[str, str]]:
    out = {}
    for t in tables:
        rows = see.profile(table(spark, d, t), t).collect()
        out[t] = {r["column"]: see.role(r["column"], r["type"], r["distinct"], r["rows"]) for r in rows}
    return out


# What the tables' own columns say: names and types from the catalog, counts from the rows.
NAMES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}
CATALOG = "(" + " union all ".join(f"select '{t}' t, column_name c, column_type k from (describe {t})" for t in TABLES) + ")"
COUNTS = "(" + " union all ".join(f"select '{t}' t, '{c}' c, count(*) n, count(distinct {c}) d from {t}" for t, cs in NAMES.items() for c in cs) + ")"
ROLES = f"(select t, c, case when d = n and n > 1 and k in ('INTEGER', 'BIGINT') and ends_with(c, 'key') then 'identifier' when starts_with(k, 'TIMESTAMP') then 'event' when ends_with(c, 'key') then 'reference' when regexp_matches(c, 'price$|acctbal$') then 'money' when k = 'VARCHAR' and d <= 50 then 'category' when k = 'VARCHAR' then 'text' else 'number' end r from {COUNTS} join {CATALOG} using (t, c))"
KEYED = "(select unnest([" + ", ".join(f"{{'t': '{t}', 'k': '{k}'}}" for t, k in KEYS.items()) + "], recursive := true))"
GUESSED = f"(select a.t child, a.c col, b.t parent, b.k parent_key from {CATALOG} a join {KEYED} b on a.t <> b.t and substr(a.c, 3) = substr(b.k, 3))"


@query(f"select t as \"table\", c as \"column\", r as role from {ROLES}")
def q_see_roles(spark, d):
    got = [(t, c, r) for t, cols in roles(spark, d).items() for c, r in cols.items()]
    return spark.createDataFrame(got, "`table` string, `column` string, role string")


def guessed(spark, d):
    return see.guess_keys(see.snapshot(spark, {t: table(spark, d, t) for t in TABLES}, KEYS))


@query(f"select * from {GUESSED}")
def q_fk_guess_names(spark, d):
    return spark.createDataFrame(guessed(spark, d), "child string, col string, parent string, parent_key string")


@query(" union all ".join(f"select '{t}' as \"table\", count(*) as rows from {t}" for t in TABLES))
def q_table_statistics(spark, d):
    parts = [see.table_statistics(table(spark, d, t), t).select("table", "rows") for t in TABLES]
    return reduce(lambda a, b: a.union(b), parts)


ROWS = "(" + " union all ".join(f"select '{t}' t, count(*) n from {t}" for t in TABLES) + ")"
OUT = f"(select t, count(distinct child || col) filter (child = t) o, count(distinct child || col) filter (parent = t) i from {ROWS}, {GUESSED} group by t)"
SHAPE = f"(select t, count(*) cols, count_if(starts_with(k, 'TIMESTAMP')) times, count_if(regexp_matches(c, 'price$|acctbal$|cost$|quantity$|size$')) measures from {CATALOG} group by t)"


@query(f"select t as \"table\", case when o >= 2 and measures + times > 0 then 'fact' when times > 0 then 'event' when i > 0 and (cols - 1 <= 3 or n < 100) then 'lookup' else 'other' end as role from {ROWS} join {OUT} using (t) join {SHAPE} using (t)")
def q_table_roles(spark, d):
    keys, cols = guessed(spark, d), roles(spark, d, TABLES)
    snap = {c.table: c for c in see.snapshot(spark, {t: table(spark, d, t) for t in TABLES}, KEYS)}
    got = [(t, see.table_role(snap[t], cols[t], keys, table(spark, d, t).count())) for t in TABLES]
    return spark.createDataFrame(got, "`table` string, role string")


@query(f"select t as subject, round(sum(ln(1 + n)), 6) activity from (select distinct t, x from (select t, t x from {ROWS} union all select parent, child from {GUESSED})) join (select t x, n from {ROWS}) using (x) group by t")
def q_subjects(spark, d):
    rows = {t: table(spark, d, t).count() for t in TABLES}
    return spark.createDataFrame([(t, round(x, 6)) for t, x in see.subjects(rows, guessed(spark, d))], "subject string, activity double")


HELD = "(" + " union all ".join(f"select '{t}' child, '{c}' col, '{p}' parent, '{k}' parent_key from (select count(distinct {c}) n, count(distinct {c}) filter ({c} in (select {k} from {p})) f from {t}) where n = f" for t, c, p, k in (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_suppkey", "nation", "n_nationkey"))) + ")"


@query(f"with g as (select * from {GUESSED}), h as (select * from {HELD}), x as (select (select count(*) from g semi join h using (child, col, parent)) hits, (select count(*) from g) g, (select count(*) from h) h) select round(hits / g, 6) as precision, round(hits / h, 6) recall, round(2 * hits / (g + h), 6) f1 from x")
def q_key_scores(spark, d):
    """Guesses by name against keys whose values are all found: of the pairs named here, a stated set."""
    asked = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_suppkey", "nation", "n_nationkey")]
    true = {x for x in asked if see.inclusion(table(spark, d, x[0]), x[1], table(spark, d, x[2]), x[3]).first()["containment"] == 1}
    s = see.key_scores(set(guessed(spark, d)), true)
    return spark.createDataFrame([(round(s["precision"], 6), round(s["recall"], 6), round(s["f1"], 6))], "precision double, recall double, f1 double")


@query("select count(distinct o_custkey) distinct_values, count(distinct case when o_custkey in (select c_custkey from customer) then o_custkey end) found, round(count(distinct case when o_custkey in (select c_custkey from customer) then o_custkey end) / cast(count(distinct o_custkey) as double), 6) containment, round(count(distinct case when o_custkey in (select c_custkey from customer) then o_custkey end) / cast((select count(*) from customer) as double), 6) coverage from orders")
def q_fk_inclusion(spark, d):
    return see.inclusion(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') span, cast(count(*) as double) as value from orders group by all")
def q_see_rows_over_time(spark, d):
    return see.compile(see.Question("orders", "rows", "o_orderdate"), table(spark, d, "orders"))


@query("select c_mktsegment part, round(fsum(c_acctbal), 4) as value from customer group by all")
def q_see_money_by_kind(spark, d):
    return see.compile(see.Question("customer", "c_acctbal", None, "c_mktsegment"), table(spark, d, "customer")).withColumn("value", F.round("value", 4))


@query("select round(fsum(l_extendedprice * (1 - l_discount)), 3) net from lineitem")
def q_see_net_revenue(spark, d):
    return exact.sums(table(spark, d, "lineitem"), [], {"net": [F.col("l_extendedprice") * (1 - F.col("l_discount"))]}).withColumn("net", F.round("net", 3))


@query("select l_returnflag, count(distinct l_partkey) parents from lineitem group by all")
def q_see_distinct_parents(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parents"))


GAPS = "(select l_returnflag, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 86400000000 n_days from lineitem join orders on l_orderkey = o_orderkey)"


def gaps(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_returnflag", F.date_diff("l_shipdate", "o_orderdate").alias("days"))


@query(f"select l_returnflag, round(sum(n_days) / cast(count(*) as double), 6) gap_days from {GAPS} group by all")
def q_see_gap_days(spark, d):
    return gaps(spark, d).groupBy("l_returnflag").agg(F.round(F.sum("days") / F.count("days"), 6).alias("gap_days"))


@query(f"select l_returnflag, count_if(n_days > 0) late, count(*) n from {GAPS} group by all", longs="late")
def q_see_late(spark, d):
    return gaps(spark, d).groupBy("l_returnflag").agg(F.count_if(F.col("days") > 0).alias("late"), F.count(F.lit(1)).alias("n"))


@query("select children, count(*) parents from (select l_orderkey, count(*) children from lineitem group by all) group by all")
def q_see_per_distribution(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("children")).groupBy("children").agg(F.count(F.lit(1)).alias("parents"))


@query("select strftime(o_orderdate, '%Y-%m-%d') as day, round(count_if(o_orderstatus = 'P') / cast(count(*) as double), 6) failed from orders where o_orderdate > (select max(o_orderdate) from orders) - interval 28 days group by all")
def q_see_failed_share(spark, d):
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = o.join(F.broadcast(last)).where("o_orderdate > last - interval 28 days")
    return recent.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.count_if(F.col("o_orderstatus") == "P") / F.count(F.lit(1)), 6).alias("failed"))


@query("select o_orderstatus, round(quantile_cont(o_totalprice, 0.95), 4) p95 from orders group by all")
def q_see_p95_delay(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"))


@query("select 'orders' tile, cast(count(*) as double) as value from orders union all select 'customers with orders', count(distinct o_custkey) from orders union all select 'open', count_if(o_orderstatus = 'O') from orders union all select 'revenue', round(fsum(o_totalprice), 4) from orders")
def q_see_tiles(spark, d):
    o = table(spark, d, "orders")
    a = o.agg(F.count(F.lit(1)).cast("double").alias("a"), F.count_distinct("o_custkey").cast("double").alias("b"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("c"))
    total = exact.sums(o, [], {"d": [F.col("o_totalprice")]}).withColumn("d", F.round("d", 4))
    return a.join(F.broadcast(total)).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("orders", "customers with orders", "open", "revenue"))), F.array("a", "b", "c", "d"))).alias("tile", "value"))


@query("select count_if(n >= 2) twice, count(*) once_or_more from (select o_custkey, count(*) n from orders group by all)", longs="twice")
def q_see_two_or_more(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= 2).alias("twice"), F.count(F.lit(1)).alias("once_or_more"))


@query("select count(distinct case when event_type = 'view' then user_id end) viewed, count(distinct case when event_type = 'click' then user_id end) clicked, count(distinct case when event_type = 'purchase' then user_id end) bought from events")
def q_see_funnel(spark, d):
    who = lambda t: F.count_distinct(F.when(F.col("event_type") == t, F.col("user_id")))
    return table(spark, d, "events").agg(who("view").alias("viewed"), who("click").alias("clicked"), who("purchase").alias("bought"))


@query("select o_orderkey from orders where o_orderstatus is not null and not coalesce(o_orderstatus = 'P', false)")
def q_live_rows(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isNotNull() & ~F.coalesce(F.col("o_orderstatus") == "P", F.lit(False))).select("o_orderkey")


@query("select case when max(o_orderdate) - min(o_orderdate) <= interval 90 days then 'day' when max(o_orderdate) - min(o_orderdate) <= interval 420 days then 'week' when max(o_orderdate) - min(o_orderdate) <= interval 2196 days then 'month' else 'year' end unit from orders")
def q_auto_bucket(spark, d):
    days = F.date_diff(F.max("o_orderdate"), F.min("o_orderdate"))
    return table(spark, d, "orders").agg(F.when(days <= 90, "day").when(days <= 420, "week").when(days <= 2196, "month").otherwise("year").alias("unit"))


@query(f"with r as (select * from {ROLES}), m as (select distinct t, 'rows' measure from r union all select t, c from r where r in ('money', 'quantity')), x as (select distinct r.t, w.c as w from r left join (select t, c from r where r = 'event') w using (t)), p as (select distinct t, null part_by from r union all select t, c from r where r = 'category') select t as \"table\", measure, w as \"time\", part_by from m join x using (t) join p using (t)")
def q_see_questions(spark, d):
    return spark.createDataFrame([(q.table, q.measure, q.time, q.by) for q in see.questions(roles(spark, d))], "`table` string, measure string, time string, part_by string")


BY = [("region", "r_name"), ("nation", "n_name"), ("customer", "c_mktsegment"), ("customer", "c_name"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag")]


@query(" union all ".join(f"select '{t}' as \"table\", '{c}' part_by, veto from (select unnest(list_filter([case when count(*) < 30 then 'too few rows' end, case when count(distinct {c}) not between 2 and 50 then 'a breakdown needs 2 to 50 values' end], lambda x: x is not null)) veto from {t})" for t, c in BY))
def q_see_vetoes(spark, d):
    out = []
    for t, c in BY:
        rows = {r["column"]: r for r in see.profile(table(spark, d, t), t).collect()}
        found = see.vetoes(see.Question(t, "rows", None, c), {x: r["distinct"] for x, r in rows.items()}, {x: r["nulls"] for x, r in rows.items()}, next(iter(rows.values()))["rows"])
        out += [(t, c, v) for v in found]
    return spark.createDataFrame(out, "`table` string, part_by string, veto string")


@query(f"select 'value' source, 'value' title, 'average' panel, false guessed from events having count(value) > 0 union all select distinct event_type, event_type, 'count per hour', false from events union all select t, c, case when starts_with(k, 'TIMESTAMP') then 'rows per day' else 'sum' end, true from {CATALOG} where t in ('orders', 'customer') and (starts_with(k, 'TIMESTAMP') or k in ('INTEGER', 'BIGINT', 'DOUBLE')) and not ends_with(c, 'key')")
def q_known_panels(spark, d):
    from .metric_queries import gauges

    streams = table(spark, d, "events").select(F.col("event_type").alias("name"), F.lit("stream").alias("kind")).distinct()
    known = dash.known_panels(metrics.names(gauges(spark, d)).select("name", "kind").union(streams))
    keys = {k for c in see.snapshot(spark, {t: table(spark, d, t) for t in TABLES}, KEYS) for k in [c.key]} | {x[1] for x in guessed(spark, d)}
    return reduce(lambda a, b: a.union(b), [known, *(dash.guessed_panels(table(spark, d, t), t, sorted(k for k in keys if k)) for t in ("orders", "customer"))])


@query("select 'l_returnflag = ' || l_returnflag panel, l_linestatus, count(*) n from lineitem group by all")
def q_repeat_panel(spark, d):
    rows = dash.repeated(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag")
    return rows.groupBy("panel", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderpriority part, count(*) n, printf('%.1f', 100.0 * count(*) / sum(count(*)) over ()) || '%' as share, format('{:,}', count(*)) as commas, regexp_replace(cast(max(o_totalprice) as varchar), '\\.0$', '') as top from orders group by all")
def q_formatted(spark, d):
    o = table(spark, d, "orders")
    whole = o.agg(F.count(F.lit(1)).alias("all"))
    per = o.groupBy(F.col("o_orderpriority").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return per.join(F.broadcast(whole)).select("part", "n", dash.share(F.col("n"), F.col("all")).alias("share"), dash.commas(F.col("n")).alias("commas"), dash.number_text(F.col("most")).alias("top"))


@query("select case when m < 120 then 'seconds' when m / 60 < 120 then 'minutes' when m / 3600 < 120 then 'hours' else 'days' end unit, round(m / case when m < 120 then 1 when m / 60 < 120 then 60 when m / 3600 < 120 then 3600 else 86400 end, 6) middle from (select quantile_cont(86400.0 * n_days, 0.5) m from (select abs(n_days) n_days from " + GAPS + "))")
def q_time_unit(spark, d):
    s = gaps(spark, d).select((F.abs("days") * 86400.0).alias("seconds"))
    unit, length = see.time_unit(s, "seconds")
    return s.agg(F.round(F.percentile("seconds", 0.5) / length, 6).alias("middle")).withColumn("unit", F.lit(unit))


@query("select o_orderpriority part, count(*) n from orders where o_orderpriority not in ('5-LOW') group by all")
def q_see_decisions(spark, d):
    o = table(spark, d, "orders")
    dropped = spark.createDataFrame([("5-LOW",)], "part string")
    return o.groupBy(F.col("o_orderpriority").alias("part")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(dropped), "part", "left_anti")


@query()
def q_bounded_sample_scaled(spark, d):
    li = table(spark, d, "lineitem")
    how, out = see.bounded(see.Question("lineitem", "rows", None, "l_returnflag"), li, li.count())
    return out.withColumn("how", F.lit(how))


@query("select 'distinct l_partkey' question, case when count(*) <= 10000 then 'exact' else 'refused' end answer, case when count(*) <= 10000 then cast(count(distinct l_partkey) as double) end as value from lineitem")
def q_bounded_refuse(spark, d):
    """A count of different values: exact on a small table, refused where only a sample would be read."""
    li, q = table(spark, d, "lineitem"), see.Question("lineitem", "distinct l_partkey")
    try:
        how, out = see.bounded(q, li, li.count())
        return out.select(F.lit(q.measure).alias("question"), F.lit(how).alias("answer"), "value")
    except see.RangeError:
        return spark.createDataFrame([(q.measure, "refused", None)], "question string, answer string, value double")


@query()
def q_drift(spark, d):
    li = table(spark, d, "lineitem")
    q = see.Question("lineitem", "rows", None, "l_returnflag")
    return see.drift(see.bounded(q, li, li.count())[1], see.compile(q, li), ["part"])


@query("select l_returnflag, l_linestatus, count(*) n, rank() over (order by count(*) desc) place from lineitem group by all")
def q_see_top_groups(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))  # a few groups


@query("select round(corr(cast(o_orderkey as double), cast(epoch_us(o_orderdate) // 86400000000 as double)), 6) by_date, round(corr(cast(o_orderkey as double), cast(o_custkey as double)), 6) by_customer from orders")
def q_physical_correlation(spark, d):
    o = table(spark, d, "orders")
    day = F.date_diff("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz")).cast("double")
    key = F.col("o_orderkey").cast("double")
    return o.agg(F.round(F.corr(key, day), 6).alias("by_date"), F.round(F.corr(key, F.col("o_custkey").cast("double")), 6).alias("by_customer"))


@query()
def q_see_candidates(spark, d):
    """The five panels of all tables, by their measured roles; the order of penalties has no SQL, tests give known answers."""
    from ..operators import candidates as ca

    keys, cols = guessed(spark, d), roles(spark, d, TABLES)
    snap = {c.table: c for c in see.snapshot(spark, {t: table(spark, d, t) for t in TABLES}, KEYS)}
    named, tables = {"identifier": "pk", "reference": "fk"}, []
    for t in TABLES:
        rows = {r["column"]: r for r in see.profile(table(spark, d, t), t).collect()}
        n = next(iter(rows.values()))["rows"]
        own = tuple(ca.Column(c, named.get(cols[t][c], cols[t][c]), distinct=r["distinct"], nulls=r["nulls"] / max(1, n)) for c, r in rows.items())
        tables.append(ca.Table(t, see.table_role(snap[t], cols[t], keys, n), n, own))
    got = ca.five(ca.generate(tables))
    return spark.createDataFrame([(c.template, c.table.name, total) for c, total in got], "template string, `table` string, total int")
