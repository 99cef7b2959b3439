"""What Spark gives besides: grouping sets, sketches, as-of and range joins,
sessions.  These complete the usual categories; the layout rules don't need
them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .inputs import table
from .registry import query

CENTS = "cast(floor(l_extendedprice * cast(100 as double) + cast(0.5 as double)) as bigint)"


def _cents(column: str):
    return F.floor(F.col(column) * 100 + 0.5)


@query("extra_rollup", f"select l_returnflag, l_linestatus, cast(grouping(l_returnflag) + grouping(l_linestatus) as int) as level, count(*) as n, cast(sum({CENTS}) as bigint) as cents from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    rows = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int").alias("level"), F.count("*").alias("n"), F.sum(_cents("l_extendedprice")).alias("cents"))


@query("extra_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("extra_semi_join", "select c_custkey, c_mktsegment from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')")
def semi_join(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("extra_region_revenue", f"select r_name, n_name, count(*) as n, cast(sum({CENTS}) as bigint) as cents from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name")
def region_revenue(spark, sf):
    places = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.sum(_cents("l_extendedprice")).alias("cents"))


@query("extra_asof_join", "with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by 1, 2) select p.event_id, v.event_id as view_id from p asof left join v on v.user_id = p.user_id and v.ts <= p.ts")
def asof_join(spark, sf):
    """The last view before each purchase: one sort of both sides, no join."""
    rows = table(spark, sf, "events").where("event_type in ('view', 'purchase')")
    order = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order)
    return rows.select("event_id", "event_type", seen.alias("view_id")).where("event_type = 'purchase'").drop("event_type")


@query("extra_sessions", "with g as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 43200000000 then 0 else 1 end as s from events), n as (select *, sum(s) over (partition by user_id order by ts) as k from g) select user_id, epoch_us(min(ts)) as start_us, count(*) as n from n group by user_id, k")
def sessions(spark, sf):
    rows = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy("user_id", F.session_window("at", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("extra_distinct_estimate", "select l_returnflag, count(distinct l_partkey) as parts, true as close from lineitem group by l_returnflag")
def distinct_estimate(spark, sf):
    # each part of a flag once: the sketch of repeated values is that of the values, and beside a
    # distinct count in one aggregation it would be sent along with every part
    parts = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey").distinct()
    counted = parts.groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("near"))
    return counted.select("l_returnflag", "parts", (F.abs(F.col("near") - F.col("parts")) <= 0.1 * F.col("parts")).alias("close"))


@query("extra_ranks", "select s_suppkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by s_nationkey order by s_acctbal, s_suppkey) as quarter from supplier window w as (partition by s_nationkey order by floor(s_acctbal / 1000))")
def ranks(spark, sf):
    by_nation = Window.partitionBy("s_nationkey")
    coarse, fine = by_nation.orderBy(F.floor(F.col("s_acctbal") / 1000)), by_nation.orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.rank().over(coarse).cast("long").alias("r"), F.dense_rank().over(coarse).cast("long").alias("d"), F.ntile(4).over(fine).cast("long").alias("quarter"))


@query("extra_range_frame", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as last_day from events")
def range_frame(spark, sf):
    day = 86_400_000_000
    rows = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-day, 0)).alias("last_day"))
