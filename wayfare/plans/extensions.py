"""Extensions beyond trips and airways that Spark gives without effort: grouping sets, set operations, time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from . import domain as D


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def ext_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    x = D.table(spark, d, "lineitem")
    return x.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.08 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def ext_set_ops(spark: SparkSession, d: str) -> DataFrame:
    x = D.table(spark, d, "lineitem")
    a, b = x.where("l_quantity > 45").select(F.col("l_suppkey").alias("k")), x.where("l_discount > 0.08").select("l_suppkey")
    return a.intersect(b).subtract(D.table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS trip FROM g) SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM h GROUP BY user_id, trip")
def ext_session_window(spark: SparkSession, d: str) -> DataFrame:
    """Trips: events of a user less than two hours apart."""
    e = D.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) + i * INTERVAL (-6) HOUR AS start_ts, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2")
def ext_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of twelve hours, a new one every six."""
    e = D.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n")


@query()
def ext_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median_qty"))
