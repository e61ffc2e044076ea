"""Annual series by unit (A29, W3-W7, W12-W18, S27, S29): growth, indices, runs, fills. Windows are partitioned by unit and
hold one unit's years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import counts_below


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Compound annual growth; null rather than 0 where it isn't defined."""
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), years.cast("double"))) - 1)


def pairwise_growth(df: DataFrame, unit: list[str], year: str, value: str) -> DataFrame:
    """(unit, first_year, last_year, growth) of each pair of neighbouring years that have a value."""
    w = Window.partitionBy(*unit).orderBy(year)
    rows = df.where(F.col(value).isNotNull()).withColumn("first_year", F.lag(year).over(w)).withColumn("first_value", F.lag(value).over(w))
    growth = cagr(F.col("first_value"), F.col(value), F.col(year) - F.col("first_year"))
    return rows.where(F.col("first_year").isNotNull()).select(*unit, "first_year", F.col(year).alias("last_year"), growth.alias("growth"))


def span_growth(df: DataFrame, unit: list[str], year: str, value: str) -> DataFrame:
    """Growth over the whole span of a unit."""
    known = df.where(F.col(value).isNotNull()).groupBy(*unit).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min_by(value, year).alias("a"), F.max_by(value, year).alias("b"))
    return known.select(*unit, "first_year", "last_year", cagr(F.col("a"), F.col("b"), F.col("last_year") - F.col("first_year")).alias("growth"))


def index_base(df: DataFrame, unit: list[str], year: str, value: str, base: float = 100.0) -> DataFrame:
    """`index`: the value against the first year that has one."""
    w = Window.partitionBy(*unit).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(value, ignorenulls=True).over(w)
    return df.withColumn("index", F.try_divide(F.col(value), first) * base)


def against_pre_period(df: DataFrame, unit: list[str], year: str, value: str, before: int) -> DataFrame:
    """`relative`: the value divided by its mean of the years before."""
    mean = F.avg(F.when(F.col(year) < before, F.col(value))).over(Window.partitionBy(*unit))
    return df.withColumn("relative", F.try_divide(F.col(value), mean))


def changes(df: DataFrame, unit: list[str], year: str, value: str) -> DataFrame:
    """`change` and its sign from the year before."""
    change = F.col(value) - F.lag(value).over(Window.partitionBy(*unit).orderBy(year))
    return df.withColumn("change", change).withColumn("sign", F.signum(change))


def longest_run(df: DataFrame, unit: list[str], order: str, flag: str) -> DataFrame:
    """(unit, longest): the longest run of neighbouring rows with the flag; 0 if there is none."""
    by_order = F.row_number().over(Window.partitionBy(*unit).orderBy(order)) - F.row_number().over(Window.partitionBy(*unit, flag).orderBy(order))
    runs = df.withColumn("island", by_order).groupBy(*unit, flag, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*unit).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias("longest"))


def forward_filled(df: DataFrame, unit: list[str], order: list[str], column: str) -> DataFrame:
    """The column with the last value so far where it is null."""
    w = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def latest_wins(df: DataFrame, key: list[str], version: str, doubtful: Column) -> DataFrame:
    """One row for each key: rows in doubt never win over others, then the latest version does. By aggregation, so a key
    with very many versions is summed where it is read."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct((~doubtful).cast("int").alias("sure"), F.col(version).alias("version"), F.struct(*rest).alias("row")))
    return df.groupBy(*key).agg(best.alias("best")).select(*key, "best.*")


def pivoted(df: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    """A panel with one column for each of the names."""
    return df.groupBy(row).pivot(column, names).agg(F.first(value, ignorenulls=True))


def placebo_ranks(df: DataFrame, statistic: str) -> DataFrame:
    """`place` by falling statistic and permutation p = place / n. Statistics are counted by value, and no task ranks
    them all."""
    values = df.where(F.col(statistic).isNotNull()).groupBy(statistic).agg(F.count("*").alias("n"))
    below = counts_below(values, [], statistic, "n")
    place = F.col("total__") - F.col("below__") - F.col("n") + 1
    ranks = below.withColumn("place", place).withColumn("p", place / F.col("total__")).drop("below__", "total__")
    return df.join(ranks.drop("n"), statistic)


def thinned(df: DataFrame, unit: list[str], order: str, n: int) -> DataFrame:
    """n rows of each unit at even steps in their order, the ends included."""
    w = Window.partitionBy(*unit)
    rows = df.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("m", F.count("*").over(w))
    step = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * (F.col("m") - 1) / max(1, n - 1)).cast("int"))
    return rows.where((F.col("m") <= n) | F.array_contains(step, F.col("at"))).drop("at", "m")
