"""Ranks, quantiles and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import counts_below, exact_quantiles


def average_rank(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """`rank` (ties share their mean) and `ecdf` within a group. Values are counted first, and no task holds
    all values of a group; rows with a null value get null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("same"))
    below = counts_below(counts, group, value, "same")
    ranks = below.withColumn("rank", F.col("below__") + (F.col("same") + 1) / 2).withColumn("ecdf", F.col("rank") / F.col("total__")).drop("same", "below__", "total__")
    return df.join(ranks, [*group, value], "left")


def theil_sen(df: DataFrame, unit: list[str], x: str, y: str) -> DataFrame:
    """(unit, slope): the median slope of all pairs of a unit's points, of which annual series have few."""
    a = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = a.select(*unit, F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, unit).where(F.col("x2") > F.col(x))
    return pairs.groupBy(*unit).agg(F.median((F.col("y2") - F.col(y)) / (F.col("x2") - F.col(x))).alias("slope"))


def with_cuts(df: DataFrame, cuts: dict[str, tuple[str, float]], group: list[str] | None = None) -> DataFrame:
    """A column for each cut: the exact quantile of a column. Without groups the cuts are one row, with groups a row each."""
    found = exact_quantiles(df, group or [], {name: (F.col(c), q) for name, (c, q) in cuts.items()})
    return df.join(F.broadcast(found), group) if group else df.crossJoin(F.broadcast(found))


def concordance(signals: dict[str, Column], needed: int) -> Column:
    """Whether `needed` signals agree; null if fewer are active than needed, never false."""
    votes = sum((F.coalesce(s.cast("int"), F.lit(0)) for s in signals.values()), F.lit(0))
    return F.when(F.lit(len(signals)) >= needed, votes >= needed)


def variant_ratio(df: DataFrame, base: str, value: str) -> DataFrame:
    """(largest, regime): the largest ratio of a variant to the base in either direction; up to 2 is stable."""
    base_value = F.max(F.when(F.col("variant") == base, F.col(value)))
    one = df.agg(base_value.alias("base"))
    ratios = df.crossJoin(F.broadcast(one)).where(F.col("variant") != base)  # one row
    most = F.max(F.greatest(F.try_divide(F.col(value), F.col("base")), F.try_divide(F.col("base"), F.col(value))))
    return ratios.agg(most.alias("largest")).withColumn("regime", F.when(F.col("largest").isNull(), "undefined").when(F.col("largest") <= 2, "stable").otherwise("sensitive"))


def scaled(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The column stretched between two quantiles and cut to 0 and 1."""
    cut = with_cuts(df, {"low__": (column, low), "high__": (column, high)})
    value = F.try_divide(F.col(column) - F.col("low__"), F.col("high__") - F.col("low__"))
    return cut.withColumn("scaled", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).drop("low__", "high__")
