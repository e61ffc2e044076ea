"""The tables that queries read, by folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column) -> Column:
    return F.round(c, 4)


def year_of(c: str) -> Column:
    return F.year(c).cast("long")


def nation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, year, total): orders by the customer's nation and year, a long annual panel."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", year_of("o_orderdate").alias("year"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    sums = orders.join(customers, "o_custkey").groupBy("c_nationkey", "year").agg(F.sum("o_totalprice").alias("total"))
    return sums.join(nations, "c_nationkey").select("nation", "year", F.round("total", 2).alias("total"))


NATION_YEARS = """nation_years AS (
  SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS year, round(sum(o_totalprice), 2) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
)"""


def user_days(spark: SparkSession, sf_dir: str, kind: str = "purchase") -> DataFrame:
    """(user_id, day, seen) for every user and each of six five-day spans: whether an event of the kind happened."""
    e = table(spark, sf_dir, "events").select("user_id", (F.floor((F.dayofmonth("ts") - 1) / 5)).cast("long").alias("day"), "event_type")
    return e.groupBy("user_id", "day").agg(F.max(F.col("event_type") == kind).alias("seen"))


USER_DAYS = """user_days AS (
  SELECT user_id, CAST((day(ts) - 1) // 5 AS BIGINT) AS day, bool_or(event_type = 'purchase') AS seen FROM events GROUP BY 1, 2
)"""


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, p_retailprice, p_size): parts on a grid 45 cells wide."""
    return table(spark, sf_dir, "part").select(F.expr("p_partkey div 45").alias("row"), F.expr("p_partkey % 45").alias("col"), "p_retailprice", "p_size")


PART_GRID = """part_grid AS (
  SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, p_retailprice, p_size FROM part
)"""
