"""Queries of scalar builders over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.functions import text as tx
from tessera.streaming import events as st

from .registry import query, table


@query("mat02_clamp", "SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN least(1.0, greatest(0.0, round(c_acctbal / 5000, 6))) END AS share FROM customer")
def mat02(spark, d):
    return table(spark, d, "customer").select("c_custkey", sc.clamp(F.round(F.col("c_acctbal") / 5000, 6)).alias("share"))


@query("mat03_log_support", "SELECT l_partkey, count(*) AS n, round(least(ln(1 + count(*)) / ln(1 + 40.0), 1.0), 6) AS support FROM lineitem GROUP BY 1")
def mat03(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return g.select("l_partkey", "n", F.round(sc.log_support(F.col("n"), 40), 6).alias("support"))


@query("dat09_month_buckets", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def dat09(spark, d):
    return table(spark, d, "orders").groupBy(sc.month_bucket(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))


@query("set01_jaccard", "WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey % 20)) AS a, list_distinct(list(l_suppkey % 20)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM s")
def set01(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("a"), F.collect_set(F.col("l_suppkey") % 20).alias("b"))
    return s.select("l_orderkey", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("stm05_observed_once", "SELECT DISTINCT user_id, event_type FROM events")
def stm05(spark, d):
    return st.observed_once(table(spark, d, "events"), "ts", "1 day", "user_id", "event_type").select("user_id", "event_type")
