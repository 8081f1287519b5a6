"""Engine breadth: relational forms beyond the domain operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..sources import views
from .registry import query


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_quantity(spark, sf_dir):
    g = views.read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return g.agg((F.grouping("l_returnflag").cast("long") + 2 * F.grouping("l_linestatus").cast("long")).alias("level"), F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf_dir):
    return views.read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_orders(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_customers(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_customers(spark, sf_dir):
    return views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(views.read(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT s_suppkey AS symbol, unnest(['price', 'balance']) AS metric, round(unnest([s_suppkey * 1.5, s_acctbal]), 4) AS value FROM supplier")
def unpivot_supplier(spark, sf_dir):
    s = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_suppkey") * 1.5).alias("price"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("symbol", ["price", "balance"], "metric", "value").withColumn("value", rounded("value", 4))


@query("SELECT year(l_shipdate) AS year, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS A, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS N, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY 1")
def pivot_flags(spark, sf_dir):
    p = views.read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("year", *[rounded(c, 2).alias(c) for c in "ANR"])


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    return views.read(spark, sf_dir, "events").groupBy("event_type", F.from_json("props", "k long")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query()
def approx_distinct_parts(spark, sf_dir):
    return views.read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))
