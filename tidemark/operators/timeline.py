"""Phases and milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.words import decimal_year, partial_date


def milestones(df: DataFrame) -> DataFrame:
    """Milestones (id, start, end, kind) with decimal years, in order: by date, unknown dates last, then by id."""
    out = df.withColumn("start_year", decimal_year(partial_date(F.col("start")))).withColumn("end_year", decimal_year(partial_date(F.col("end"))))
    return out.orderBy(F.col("start_year").asc_nulls_last(), "id")


def milestone_faults(df: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, fault): dates that are none, ends before starts, unknown kinds, ids that are taken, sources that lack."""
    start, end = decimal_year(partial_date(F.col("start"))), decimal_year(partial_date(F.col("end")))
    rules = F.array(F.when(start.isNull(), "start"), F.when(F.col("end").isNotNull() & end.isNull(), "end"), F.when(end < start, "end before start"), F.when(~F.col("kind").isin(*kinds), "kind"), F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "source"))
    rows = df.select("id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("fault"))
    return rows.unionByName(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id").alias("fault")))


def gaps(phases: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """(group, end, next_start): phases that don't end where the next one begins."""
    follow = phases.withColumn("next_start", F.lead(start).over(Window.partitionBy(*group).orderBy(start)))
    return follow.where(F.col("next_start").isNotNull() & ~F.col(end).eqNullSafe(F.col("next_start"))).select(*group, end, "next_start")


def filled_counts(df: DataFrame, group: list[str], value: str, first: int, last: int) -> DataFrame:
    """(group, value, n) for every value from first to last, 0 where there is none (A9, A12). Rows are counted before the
    sequence is laid under them."""
    counts = df.where(F.col(value).between(first, last)).groupBy(*group, value).agg(F.count("*").alias("n"))
    every = df.select(*group).distinct().withColumn(value, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return every.join(counts, [*group, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def numbered(df: DataFrame, name: str, order: str, out: str = "slug") -> DataFrame:
    """Repeated names get -1, -2 … in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(out, F.when(k > 0, F.concat(F.col(name), F.lit("-"), k.cast("string"))).otherwise(F.col(name)))
