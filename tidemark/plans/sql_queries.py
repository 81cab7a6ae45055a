"""Joins, set operations, builder queries and calculations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.ordered import running
from ..functions.ranges import bucket
from ..operators import calc
from ..operators import sql as b
from ..session import micros, table
from .metric_queries import DAY, HOUR
from .registry import query


def t(spark: SparkSession, d: str, *names: str):
    return [table(spark, d, n) for n in names]


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY'")
def q_join_inner(spark, d):
    o, c = t(spark, d, "orders", "customer")
    return o.join(c.where("c_mktsegment = 'MACHINERY'"), o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by all")
def q_join_left(spark, d):
    o, c = t(spark, d, "orders", "customer")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n"))


@query("select p_partkey, s_suppkey from part full join (select * from supplier where s_suppkey > 50) on p_partkey = s_suppkey")
def q_join_full(spark, d):
    p, s = t(spark, d, "part", "supplier")
    return p.join(s.where("s_suppkey > 50"), p.p_partkey == s.s_suppkey, "full").select("p_partkey", "s_suppkey")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def q_join_semi(spark, d):
    o, c = t(spark, d, "orders", "customer")
    return c.join(o.where("o_totalprice > 400000"), o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def q_join_anti(spark, d):
    o, c = t(spark, d, "orders", "customer")
    return c.join(o.where("o_totalprice > 400000"), o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@query(f"select r_name, round(fsum(l_extendedprice), 4) revenue from lineitem join (select distinct o_orderkey, o_custkey from orders) on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def q_see_path_join(spark, d):
    li, o, c, n, r = t(spark, d, "lineitem", "orders", "customer", "nation", "region")
    o = o.select("o_orderkey", "o_custkey").distinct()
    j = li.select("l_orderkey", "l_extendedprice").join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return exact.sums(j.select("r_name", "l_extendedprice"), ["r_name"], {"revenue": [F.col("l_extendedprice")]}).withColumn("revenue", F.round("revenue", 4))


@query("select a.n_nationkey, b.n_nationkey other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def q_self_join(spark, d):
    n = table(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_nationkey"), F.col("b.n_nationkey").alias("other"))


@query("""select c_custkey, case when j is null then '[]' else j end orders from customer left join (select o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey || '}', ',' order by rn) || ']' j from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn <= 3 group by all) on o_custkey = c_custkey""")
def q_include_topn(spark, d):
    c, o = t(spark, d, "customer", "orders")
    return b.include(c.select("c_custkey"), o, ("c_custkey", "o_custkey"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, ["o_orderkey"], "orders")


@query("select o_orderkey, o_totalprice from orders where o_totalprice < 300000 or (o_totalprice = 300000 and o_orderkey > 5) order by o_totalprice desc, o_orderkey limit 50")
def q_keyset_page(spark, d):
    return b.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 50, [300000.0, 5])


@query("select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_custkey is not null and (o_totalprice > 450000 or false)")
def q_builder_where(spark, d):
    o = table(spark, d, "orders")
    return o.where(b.where({"o_orderstatus": ["O", "P"]}) & ~b.where({"o_custkey": None}) & b.any_of(F.col("o_totalprice") > 450000, b.where({"o_orderkey": []}))).select("o_orderkey")


@query("select c_custkey, c_acctbal from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING'")
def q_param_binding(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("q_param_customer")
    return spark.sql("select c_custkey, c_acctbal from q_param_customer where c_acctbal > :least and c_mktsegment = :segment", args={"least": 5000.0, "segment": "BUILDING"})


@query("select c_custkey, case when c_custkey % 5 = 0 then 0 else c_acctbal end c_acctbal from customer union all select max(c_custkey) + 1, 1 from customer")
def q_upsert_result(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")).union(c.agg((F.max("c_custkey") + 1).alias("c_custkey"), F.lit(1.0).alias("c_acctbal")))
    return b.upsert(c, changes, ["c_custkey"])


@query("select o_custkey, count(*) n from orders group by all having count(*) > 15")
def q_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


@query("select coalesce(l_returnflag, '*') flag, coalesce(l_linestatus, '*') status, count(*) n from lineitem group by rollup (l_returnflag, l_linestatus)")
def q_rollup_returnflag(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query("select coalesce(l_returnflag, '*') flag, coalesce(l_linestatus, '*') status, count(*) n from lineitem group by cube (l_returnflag, l_linestatus)")
def q_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query("with recursive r(n, k) as (select n_nationkey, 0 from nation where n_nationkey < 3 union all select n, k + 1 from r where k < 4) select n, k from r")
def q_recursive_cte(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("q_cte_nation")
    return spark.sql("with recursive r(n, k) as (select n_nationkey, 0 from q_cte_nation where n_nationkey < 3 union all select n, k + 1 from r where k < 4) select n, k from r")


@query("(select o_custkey k from orders intersect select c_custkey from customer where c_acctbal > 0)")
def q_setintersect(spark, d):
    o, c = t(spark, d, "orders", "customer")
    return o.select(F.col("o_custkey").alias("k")).intersect(c.where("c_acctbal > 0").select("c_custkey"))


@query("(select 'a' side, o_custkey k, count(*) n from (select o_custkey from orders where o_orderstatus = 'O' except all select o_custkey from orders where o_orderstatus = 'F') group by all) union all (select 'b', o_custkey, count(*) from (select o_custkey from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O') group by all)")
def q_setdiff(spark, d):
    o = table(spark, d, "orders")
    x, y = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "OF")
    side = lambda df, s: df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "k", "n")
    return side(x.exceptAll(y), "a").union(side(y.exceptAll(x), "b"))


@query("select 'orders' origin, count(*) n from orders union all select 'lineitem', count(*) from lineitem")
def q_union_frames(spark, d):
    parts = [table(spark, d, x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("origin"), "n") for x in ("orders", "lineitem")]
    return parts[0].unionByName(parts[1])


@query("select l_returnflag, l_linestatus, sum(l_quantity) qty, round(sum(l_extendedprice), 2) price, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def q_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    out = exact.sums(li, ["l_returnflag", "l_linestatus"], {"price": [F.col("l_extendedprice")]}, {"qty": (F.sum("l_quantity"), "sum"), "n": (F.count(F.lit(1)), "sum")})
    return out.withColumn("price", F.round("price", 2))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn, ntile(4) over (partition by o_custkey order by o_totalprice desc, o_orderkey) fourth from orders")
def q_quantile_rows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.ntile(4).over(w).cast("long").alias("fourth"))


@query("select year(o_orderdate) y, sum(case when o_orderstatus = 'O' then 1 else 0 end) o, sum(case when o_orderstatus = 'F' then 1 else 0 end) f from orders group by all", longs="o f")
def q_pivot_stacked(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("y")).pivot("o_orderstatus", ["O", "F"]).agg(F.count(F.lit(1))).select("y", F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f"))


# Calculations: nations are instances, regions are groups; an instance whose key divides by 7 failed.
SITE = "(select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey)"


def site_frame(spark, d):
    o, c, n, r = t(spark, d, "orders", "customer", "nation", "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("r_name", "n_name", "n_nationkey", "o_totalprice", "o_orderdate", "o_orderkey")


@query(f"select r_name, round(fsum(o_totalprice), 4) revenue, count(o_orderkey) n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) newest from orders join customer on o_custkey = c_custkey join {SITE} on c_nationkey = n_nationkey group by all")
def q_calc_sum_by_site(spark, d):
    f = site_frame(spark, d).withColumn("at", F.struct("o_orderdate", "o_orderkey")).withColumn("k", F.col("o_orderkey"))
    return calc.calculate(f, {"o_totalprice": {"op": "sum", "as": "revenue"}, "o_orderkey": {"op": "count", "as": "n"}, "k": {"op": "last", "as": "newest"}}, ["r_name"], time="at").withColumn("revenue", F.round("revenue", 4))


@query(f"select r_name, bool_and(n_nationkey % 7 <> 0) complete, coalesce(string_agg(case when n_nationkey % 7 = 0 then n_name end, ',' order by n_name), '') missing from {SITE} group by all")
def q_calc_incomplete(spark, d):
    n, r = t(spark, d, "nation", "region")
    a = n.join(r, n.n_regionkey == r.r_regionkey).withColumn("answered", F.col("n_nationkey") % 7 != 0)
    return calc.completeness(a, ["r_name"], "n_name", "answered")


@query(f"select n_name, count(o_orderkey) n from {SITE} left join (select * from orders join customer on o_custkey = c_custkey where o_totalprice > 490000) on c_nationkey = n_nationkey group by all")
def q_calc_empty_zero(spark, d):
    got = site_frame(spark, d).where("o_totalprice > 490000").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return calc.empty_zero(got, table(spark, d, "nation"), ["n_name"], ["n"])


@query("select c_mktsegment, c_nationkey % 2 currency, round(fsum(c_acctbal), 4) balance from customer group by all")
def q_calc_currency(spark, d):
    c = table(spark, d, "customer").withColumn("currency", F.col("c_nationkey") % 2)
    out = calc.calculate(c, {"c_acctbal": {"op": "sum", "as": "balance"}}, ["c_mktsegment", "currency"])
    one = calc.one_unit(c.withColumn("unit", F.col("currency")), "unit", ["c_mktsegment", "currency"])
    return out.withColumn("balance", F.round("balance", 4)).join(one, ["c_mktsegment", "currency"]).drop("unit")


@query("select name, json_extract_string(labels, '$.o_orderstatus') as status, count(*) n from (select unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) as name, json_object('o_orderstatus', o_orderstatus) labels from orders) group by all")
def q_series_rule(spark, d):
    s = calc.series_rule(table(spark, d, "orders"), "o_orderdate")
    return s.groupBy("name", F.col("labels")["o_orderstatus"].alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey, case when s_acctbal >= 8000 then 'bad' when s_acctbal >= 4000 then 'warn' else 'ok' end state from supplier")
def q_threshold_states(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", calc.thresholds(F.col("s_acctbal"), 4000, 8000).alias("state"))


EVAL = f"(select event_type, at_us, fsum(value) > 700 breach from (select event_type, epoch_us(ts) - epoch_us(ts) % {12 * HOUR} at_us, value from events) group by all)"
STATES = f"(select *, sum(ch) over (partition by event_type order by at_us) run from (select *, case when lag(breach) over (partition by event_type order by at_us) is distinct from breach then 1 else 0 end ch from {EVAL}))"
FIRES = f"(select *, breach and at_us - min(at_us) over (partition by event_type, run) >= {DAY} fires, row_number() over (partition by event_type, run order by at_us) no from {STATES})"
ALERT = f"(select event_type, at_us, case when fires then 'firing' when breach then 'pending' when no = 1 and coalesce(lag(fires) over (partition by event_type order by at_us), false) then 'resolved' else 'ok' end state from {FIRES})"


def evaluations(spark, d):
    e = table(spark, d, "events").withColumn("at_us", bucket(micros(F.col("ts")), 12 * HOUR))
    return exact.sums(e, ["event_type", "at_us"], {"total": [F.col("value")]}).select("event_type", "at_us", (F.col("total") > 700).alias("breach"))


@query(f"select event_type, at_us, state from {ALERT}")
def q_alert_states(spark, d):
    return calc.alert_states(evaluations(spark, d), ["event_type"], "at_us", "breach", DAY).select("event_type", "at_us", "state")


@query(f"select event_type, at_us, was, state from (select *, lag(state) over (partition by event_type order by at_us) was from {ALERT}) where was is null or was <> state")
def q_alert_transitions(spark, d):
    s = calc.alert_states(evaluations(spark, d), ["event_type"], "at_us", "breach", DAY)
    return calc.transitions(s, ["event_type"], "at_us").select("event_type", "at_us", "was", "state")


@query(f"select event_type, user_id, greatest(max(epoch_us(ts)), 1706659200000000 - {DAY}) as begin, 1706659200000000 as 'end', 1706659200000000 - max(epoch_us(ts)) > {DAY} gap from events group by all")
def q_collector_windows(spark, d):
    e = table(spark, d, "events").withColumn("us", micros(F.col("ts")))
    return calc.collector_windows(e, ["event_type", "user_id"], "us", 1_706_659_200_000_000, DAY)


@query("select count(*) fetched, count(*) > 1000 truncated from (select * from orders limit 1001)")
def q_row_cap(spark, d):
    return b.checked(table(spark, d, "orders"), 1000).agg(F.count(F.lit(1)).alias("fetched")).select("fetched", (F.col("fetched") > 1000).alias("truncated"))


@query("""select o_orderkey, '{"key":"' || o_orderkey || '","status":"' || o_orderstatus || '"}' as json from orders""")
def q_frame_json(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"))).alias("json"))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20 and l_extendedprice between 20000 and 30000")
def q_geo_box(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20) & F.col("l_extendedprice").between(20000, 30000)).select("l_orderkey", "l_linenumber")


@query("select round(corr(rx, ry), 9) rho from (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 rx, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 ry from lineitem)")
def q_spearman(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    for x in ("l_quantity", "l_extendedprice"):  # ranks by counts of values
        per = running(li.groupBy(x).agg(F.count(F.lit(1)).alias("c")), x, "c", "ahead")
        li = li.join(per.select(x, (F.col("ahead") + (F.col("c") + 1) / 2).alias(f"r_{x}")), x)
    return li.agg(F.round(F.corr("r_l_quantity", "r_l_extendedprice"), 9).alias("rho"))
