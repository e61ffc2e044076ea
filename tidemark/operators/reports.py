"""Facts that reports state about series and maps.

Windows are partitioned by unit and hold one unit's years; all else is aggregation, so a unit with very many rows is summed
where it is read. Rows whose value is null count as not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import series


def census_and_projection(df: DataFrame, unit: list[str], year: str, value: str, flag: str, modelled: str = "modelled") -> DataFrame:
    """One row a unit with a value: the last year's value is a projection if it is modelled and an earlier value exists; then
    the value before it is the census, else the last one is. A single modelled value is an estimate, not a projection."""
    w = Window.partitionBy(*unit).orderBy(F.col(year).desc())
    known = df.where(F.col(value).isNotNull()).withColumn("back", F.row_number().over(w)).where("back <= 2")
    at = lambda back, c: F.max(F.when(F.col("back") == back, F.col(c)))
    ends = known.groupBy(*unit).agg(*[at(b, c).alias(f"{n}{b}") for b in (1, 2) for n, c in (("y", year), ("v", value), ("f", flag))])
    projected = F.col("f1").eqNullSafe(modelled) & F.col("y2").isNotNull()
    census = [F.when(projected, F.col(f"{n}2")).otherwise(F.col(f"{n}1")).alias(name) for n, name in (("y", "census_year"), ("v", "census"))]
    projection = [F.when(projected, F.col(f"{n}1")).alias(name) for n, name in (("y", "projection_year"), ("v", "projection"))]
    return ends.select(*unit, *census, *projection)


def solid_and_dashed(df: DataFrame, unit: list[str], year: str, value: str, flag: str, modelled: str = "modelled") -> DataFrame:
    """`solid`: values that aren't modelled. `dashed`: modelled values, and the last one that isn't, so that both lines meet."""
    is_modelled = F.col(flag).eqNullSafe(modelled)
    last = F.max(F.when(F.col(value).isNotNull() & ~is_modelled, F.col(year))).over(Window.partitionBy(*unit))
    rows = df.withColumn("last_solid", last)
    solid, dashed = F.when(~is_modelled, F.col(value)), F.when(is_modelled | (F.col(year) == F.col("last_solid")), F.col(value))
    return rows.withColumn("solid", solid).withColumn("dashed", dashed).drop("last_solid")


def ratio_to_unit(df: DataFrame, unit: str, base: str, key: list[str], value: str) -> DataFrame:
    """`ratio`: each other unit's value against the base unit's of the same key; null where that is missing or 0."""
    of_base = df.where(F.col(unit) == base).groupBy(*key).agg(F.max(value).alias("base_value"))
    rows = df.where(F.col(unit) != base).join(of_base, key, "left")
    return rows.withColumn("ratio", F.try_divide(F.col(value), F.col("base_value"))).drop("base_value")


def missing_reasons(df: DataFrame, unit: str, reason: str, variable: str, value: str) -> DataFrame:
    """(unit, reason, variables): the distinct variables without a value, sorted, so that a reason is stated once. They are
    made distinct before they are gathered: a list is as long as there are variables."""
    names = df.where(F.col(value).isNull()).select(unit, reason, variable).distinct()
    return names.groupBy(unit, reason).agg(F.array_sort(F.collect_set(variable)).alias("variables"))


def extremes(df: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """Lowest and highest value of each group and where they are, of ties the first place, and the median. The median is
    exact and holds a group's distinct values: meant for groups such as a unit's years."""
    known = df.where(F.col(value).isNotNull())
    low, high = F.min(F.struct(F.col(value).alias("v"), F.col(at).alias("a"))), F.min(F.struct((-F.col(value)).alias("v"), F.col(at).alias("a")))
    out = known.groupBy(*by).agg(low.alias("l"), high.alias("h"), F.median(value).alias("median"), F.count("*").alias("n"))
    return out.select(*by, F.col("l.v").alias("low"), F.col("l.a").alias("low_at"), (-F.col("h.v")).alias("high"), F.col("h.a").alias("high_at"), "median", "n")


def latest_pair(df: DataFrame, unit: list[str], year: str, variable: str, pattern: str) -> DataFrame:
    """(unit, year, base): the latest year with a variable of the pattern, whose first group is the base year; the smallest
    base if there are several. The interval comes from the data, not from a name that may not be there."""
    base = F.regexp_extract(variable, pattern, 1).try_cast("long")
    rows = df.where(F.col(variable).rlike(pattern)).withColumn("base", base).where("base IS NOT NULL")
    best = F.max(F.struct(F.col(year).alias("year"), (-F.col("base")).alias("back")))
    return rows.groupBy(*unit).agg(best.alias("best")).select(*unit, "best.year", (-F.col("best.back")).alias("base"))


def declared_order(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(name, place): names that are present; declared ones by their place from 1, all others after them, to be sorted by name."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col(name)) if order else F.lit(0)
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    return names.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("long"))


def by_prefix(df: DataFrame, key: list[str], prefix: str, variants: list[str]) -> DataFrame:
    """(key, variant, column, value): the first column, named prefix and a beginning of the variant, that has a value. A
    variant without one is an error, as dropping it in silence would drop what validates the rest."""
    columns = [c for c in df.columns if c.startswith(prefix)]

    def found(variant: str) -> Column:
        fits = [c for c in columns if variant.startswith(c[len(prefix) :])]
        missing = F.raise_error(F.lit(f"no column {prefix}* fits {variant}; there are {columns}")).cast("struct<column:string,value:double>")
        pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c in fits]
        return F.struct(F.lit(variant).alias("variant"), F.coalesce(*pairs, missing).alias("found"))

    rows = df.select(*key, F.explode(F.array(*[found(v) for v in variants])).alias("of"))
    return rows.select(*key, "of.variant", "of.found.column", "of.found.value")


def restricted_range(df: DataFrame, key: list[str], prefix: str, expected: list[str]) -> DataFrame:
    """(key, lowest, highest) over the columns of the prefix; an expected one that isn't there is an error."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    missing = sorted(set(expected) - {c[len(prefix) :] for c in columns})
    if missing:
        raise KeyError(f"no column {prefix}* for {missing}")
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(*key, F.array_min(values).alias("lowest"), F.array_max(values).alias("highest"))


def coverage(df: DataFrame, by: list[str], count: str, least: int) -> DataFrame:
    """(by, share, median): the share of cells with enough observations; the median is taken from counts of each number."""
    counts = df.where(F.col(count).isNotNull()).groupBy(*by, count).agg(F.count("*").alias("n"))
    share = F.sum(F.when(F.col(count) >= least, F.col("n")).otherwise(0)) / F.sum("n")
    return counts.groupBy(*by).agg(share.alias("share"), F.expr(f"percentile(`{count}`, 0.5, n)").alias("median"))


def exclusivity(df: DataFrame, by: list[str], fractions: list[str]) -> DataFrame:
    """(by, highest_sum, n_shared): the largest sum of fractions, and cells with a part of two classes or more; null is 0."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in fractions]
    shared = sum(((p > 0).cast("int") for p in parts), F.lit(0)) >= 2
    return df.groupBy(*by).agg(F.max(sum(parts, F.lit(0.0))).alias("highest_sum"), F.count_if(shared).alias("n_shared"))


def centroids(df: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """(by, x, y, n): the mean place of a group's cells."""
    return df.groupBy(*by).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def shares_within(df: DataFrame, by: list[str], inside: Column) -> DataFrame:
    """(by, n, n_inside, share): a class's cells and those in the zone; null is outside."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(inside, F.lit(False))).alias("n_inside"))
    return counts.withColumn("share", F.col("n_inside") / F.col("n"))


def growth_contrast(df: DataFrame, side: str, year: str, value: str, first: int, last: int) -> DataFrame:
    """(side, first, last, growth) of each side and of `total` between two years; null where the first sum is missing or 0."""
    sums = df.where(F.col(year).isin(first, last)).groupBy(side, year).agg(F.sum(value).alias("v"))
    rows = sums.select(F.explode(F.array(F.col(side), F.lit("total"))).alias(side), year, "v")
    at = lambda y: F.sum(F.when(F.col(year) == y, F.col("v")))
    return rows.groupBy(side).agg(at(first).alias("first"), at(last).alias("last")).withColumn("growth", F.try_divide(F.col("last"), F.col("first")) - 1)


def indexed_pair(left: DataFrame, right: DataFrame, year: str, value: str) -> DataFrame:
    """(year, left_index, right_index): two series against their first values, matched by year and not by place."""
    index = lambda df, name: series.index_base(df.withColumn("unit", F.lit(1)), ["unit"], year, value).select(year, F.col("index").alias(name))
    return index(left, "left_index").join(index(right, "right_index"), year, "left")
