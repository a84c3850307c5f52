"""Tables derived from the given parquet files, each in Spark and as a SQL CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row-wise heavy work on a scan of very few file splits.

    A large table has more splits than cores and is left alone, so no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def orders_tte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the order to 2001-08-02; the event is status F."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("time"),
        (F.col("o_orderstatus") == "F").alias("cens"),
        (F.col("o_totalprice") / 100000.0).alias("price"),
        (F.col("c_acctbal") / 1000.0).alias("acctbal"),
        F.col("o_orderpriority").alias("grp"),
        F.col("c_mktsegment").alias("segment"))


ORDERS_TTE = """orders_tte AS (
  SELECT o_orderkey AS row_id,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS DOUBLE) AS time,
         o_orderstatus = 'F' AS cens, o_totalprice / 100000.0 AS price,
         c_acctbal / 1000.0 AS acctbal, o_orderpriority AS grp, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def lineitem_ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment of the lines shipped later; the event is a return."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    gap = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(gap > 0).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        gap.cast("double").alias("time"), (F.col("l_returnflag") == "R").alias("cens"),
        F.col("l_quantity").alias("quantity"), F.col("o_orderpriority").alias("grp")))


LINEITEM_RET = """lineitem_ret AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS time,
         l_returnflag = 'R' AS cens, l_quantity AS quantity, o_orderpriority AS grp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 0)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with a rough event score and a rough predicted time."""
    return orders_tte(spark, sf_dir).select(
        "row_id", "time", "cens", "grp",
        (F.round(F.col("price") * 20) / 120.0 + 0.05).alias("score"),
        (F.round(F.col("price") * 100) * 4.0 + 7.0).alias("pred"))


SCORED = ORDERS_TTE + """,
scored AS (
  SELECT row_id, time, cens, grp, round(price * 20) / 120.0 + 0.05 AS score,
         round(price * 100) * 4.0 + 7.0 AS pred FROM orders_tte)"""
