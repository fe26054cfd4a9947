"""Generic relational queries over the order tables: joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.session import read


def money(x):
    return F.round(x, 2)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    l = read(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum("l_extendedprice")).alias("sum_base"), money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def local_suppliers(spark, d):
    c, o, l, s, n, r = (read(spark, d, x) for x in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(l, l.l_orderkey == o.o_orderkey).join(s, (l.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name").agg(money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def customers_without_urgent_orders(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderpriority LIKE '1%'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def returned_orders(spark, d):
    l = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(l, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_size, grouping(p_brand)::BIGINT AS g_brand, grouping(p_size)::BIGINT AS g_size, count(*) AS n, sum(CAST(round(p_retailprice * 100) AS BIGINT))::BIGINT AS cents FROM part GROUP BY CUBE (p_brand, p_size)")
def part_cube(spark, d):
    return read(spark, d, "part").cube("p_brand", "p_size").agg(F.grouping("p_brand").cast("long").alias("g_brand"), F.grouping("p_size").cast("long").alias("g_size"), F.count("*").alias("n"), F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("cents"))


@query("""SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, rank() OVER w AS place, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)) WHERE place <= 3""")
def top_customers(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    frame = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey").rowsBetween(-2, 0)
    return read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.rank().over(w).cast("long").alias("place"), money(F.sum("c_acctbal").over(frame)).alias("moving")).where("place <= 3")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def nation_sets(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return c.intersect(read(spark, d, "supplier").select("s_nationkey")).subtract(read(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def orders_by_month(spark, d):
    return read(spark, d, "orders").groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, min(event_id) AS first_event FROM events GROUP BY 1")
def event_ledger(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_event"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, max(session)::BIGINT AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def user_sessions(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    s = e.withColumn("new", F.when(gap <= 30 * 60 * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(order))
    return s.groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("n"))


@query("""SELECT source AS work, grouping(source) = 1 AS total, count(*) AS units, sum(n_chars)::BIGINT AS chars, count(quality) AS labelled, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""")
def census_rollup(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").withColumnRenamed("source", "work")
    return both.rollup("work").agg((F.grouping("work") == 1).alias("total"), F.count("*").alias("units"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
