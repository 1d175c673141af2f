"""Cohorts derived from the order, line item and event tables: _row_id, time, event and covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "2001-08-02"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_gap_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from each order to the customer's next one; the last order is censored at a fixed day. Times may be 0."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    nxt = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    gaps = orders.withColumn("nx", nxt)
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return gaps.join(customer, gaps.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("_row_id"),
        F.datediff(F.coalesce("nx", F.lit(END).cast("timestamp")), "o_orderdate").cast("double").alias("time"),
        F.col("nx").isNotNull().cast("int").alias("event"),
        "o_orderpriority", "o_orderstatus", "c_mktsegment", "o_totalprice", "c_acctbal",
    )


def order_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_gap_raw(spark, sf_dir).filter("time > 0")


def ship_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment; the event is a return."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("event"), "l_linestatus", "l_quantity", "l_discount")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.select(F.datediff("l_shipdate", "o_orderdate").cast("double").alias("time"), "event", "l_linestatus", "o_orderpriority", "l_quantity", "l_discount").filter("time > 0")


def conversion(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """Hours, plus one, from a user's first event to the first purchase above 100; else censored at the last event. more are
    further aggregates of a user's events."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    hit = F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), F.col("ts"))
    f = e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("tl"), F.min(hit).alias("tp"), *[c.alias(k) for k, c in more.items()])
    hours = F.floor((F.unix_timestamp(F.coalesce("tp", "tl")) - F.unix_timestamp("t0")) / 3600.0) + 1
    return f.select(F.col("user_id").alias("_row_id"), hours.cast("double").alias("time"), F.col("tp").isNotNull().cast("int").alias("event"), *more)


#: The same cohorts in SQL.
ORDER_GAP_RAW = """
gap_raw AS (
  SELECT o_orderkey AS _row_id, CAST(date_diff('day', o_orderdate, coalesce(nx, TIMESTAMP '2001-08-02')) AS DOUBLE) AS time,
         CASE WHEN nx IS NULL THEN 0 ELSE 1 END AS event, o_orderpriority, o_orderstatus, c_mktsegment, o_totalprice, c_acctbal
  FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders) o
  JOIN customer ON o_custkey = c_custkey
)"""
ORDER_GAP = ORDER_GAP_RAW + ", gap AS (SELECT * FROM gap_raw WHERE time > 0)"
SHIP_LAG = """
lag AS (
  SELECT * FROM (
    SELECT CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event,
           l_linestatus, o_orderpriority, l_quantity, l_discount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE time > 0
)"""
CONVERSION = """
conv AS (
  SELECT user_id AS _row_id, CAST(floor((floor(epoch(coalesce(tp, tl))) - floor(epoch(t0))) / 3600.0) + 1 AS DOUBLE) AS time,
         CASE WHEN tp IS NULL THEN 0 ELSE 1 END AS event
  FROM (SELECT user_id, min(ts) AS t0, max(ts) AS tl, min(CASE WHEN event_type = 'purchase' AND value > 100 THEN ts END) AS tp FROM events GROUP BY user_id)
)"""
