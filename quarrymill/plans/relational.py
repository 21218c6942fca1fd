"""Relational queries over the star schema: joins, set operations, rollups, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.plans.registry import query
from quarrymill.runtime import table


@query("SELECT n_name, r_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def star_join(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) SELECT o_orderpriority, count(*)::BIGINT AS orders, count(l.l_orderkey)::BIGINT AS shipped, round(sum(q), 2) AS quantity FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1")
def left_join_aggregate(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))  # noqa: E741
    return table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.count("l_orderkey").alias("shipped"), F.round(F.sum("q"), 2).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS sum_qty, round(sum(l_extendedprice),2) AS sum_base, round(sum(l_extendedprice*(1-l_discount)),2) AS sum_disc, round(avg(l_discount),4) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1,2")
def pricing_summary(spark, sf):
    d = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def anti_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT nationkey, list FROM (SELECT c_nationkey AS nationkey, 'both' AS list FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT n_nationkey, 'no_supplier' FROM nation EXCEPT SELECT s_nationkey, 'no_supplier' FROM supplier)")
def set_operations(spark, sf):
    c, s, n = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"))
    return c.intersect(s).withColumn("list", F.lit("both")).union(n.subtract(s).withColumn("list", F.lit("no_supplier")))


@query("SELECT key, name, balance, segment FROM (SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier)")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance")
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 2")
def top_orders(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("o_custkey", "o_orderkey", "rank")


@query("SELECT a.o_custkey, count(*)::BIGINT AS both FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') b USING (o_custkey) GROUP BY 1")
def self_join_both(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus in ('F','O')").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n")).where("n = 2")
    return o.select("o_custkey", F.lit(1).cast("long").alias("both"))


@query("SELECT p_brand, p_type, count(*)::BIGINT AS n, round(avg(p_retailprice), 2) AS price, grouping_id(p_brand, p_type)::INT AS level FROM part GROUP BY ROLLUP(p_brand, p_type)")
def rollup_levels(spark, sf):
    return table(spark, sf, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("price"), F.grouping_id().cast("int").alias("level"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY revenue DESC, l_suppkey LIMIT 10")
def top_suppliers(spark, sf):
    d = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return d.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_suppkey").limit(10)
