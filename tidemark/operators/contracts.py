"""Contracts of long tables (U1-U6, J1, J22, T1, K10-K11): rows that break a rule come back as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of the long table.
LONG_TABLE = "family string, unit string, year int, variable string, value double, measure string, flag string, level string, source string, method string, note string"
KEY = ["family", "unit", "year", "variable"]


class BrokenContractError(ValueError):
    pass


def key_conflicts(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, n_values, n_rows) of keys with different values; equal repeats are no conflict, null is a value of its own."""
    seen = F.count_distinct(F.struct(F.col(value)))
    return df.groupBy(*key).agg(seen.alias("n_values"), F.count("*").alias("n_rows")).where(F.col("n_values") > 1)


def orphans(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def missing(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of `expected` that are not there."""
    return expected.subtract(present)


def assert_empty(df: DataFrame, what: str) -> None:
    """Raises with an example if there is a row."""
    row = df.first()
    if row is not None:
        raise BrokenContractError(f"{what}: {row.asDict()}")


def resolved(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """An inner join whose keys must all be found."""
    assert_empty(orphans(df, other, on), "keys without a partner")
    return df.join(other, on)


def ragged_union(*parts: DataFrame) -> DataFrame:
    """All rows with the union of all columns, null where a part lacks one (U4)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def canonical_order(df: DataFrame) -> DataFrame:
    """By family, unit, variable and year; a year that is none comes first."""
    return df.orderBy("family", "unit", "variable", F.coalesce(F.col("year").try_cast("int"), F.lit(-1)))


def long_table_faults(df: DataFrame, families: list[str], flags: list[str]) -> DataFrame:
    """(fault, unit, variable, year) of a long table: unknown flags, a level other than A, values of 0 without a note,
    conflicting keys, families that are absent."""
    rule = F.filter(F.array(F.when(~F.col("flag").isin(*flags), F.lit("flag")), F.when(F.col("level") != "A", F.lit("level")), F.when((F.col("value") == 0) & F.col("note").isNull(), F.lit("zero without note"))), lambda x: x.isNotNull())
    rows = df.select(F.explode(rule).alias("fault"), "unit", "variable", "year")
    clash = key_conflicts(df, KEY, "value").select(F.lit("conflict").alias("fault"), "unit", "variable", "year")
    spark = df.sparkSession
    absent = spark.createDataFrame([(f,) for f in families], "family string").join(df.select("family").distinct(), "family", "left_anti")
    return ragged_union(rows, clash, absent.select(F.concat(F.lit("no family "), "family").alias("fault")))


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest_changes(now: DataFrame, then: DataFrame) -> DataFrame:
    """(path, state): missing, extra or changed files."""
    both = now.withColumnRenamed("sha256", "a").join(then.withColumnRenamed("sha256", "b"), "path", "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", state.alias("state")).where(F.col("state").isNotNull())
