"""Rules over ordered years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confirm_then_persist(df: DataFrame, unit: list[str], year: str, flag: str) -> DataFrame:
    """`confirmed` and `persistent`. A detection is confirmed by one in the next year (the last year confirms itself), or by
    a confirmed one before; what was once confirmed persists."""
    w = Window.partitionBy(*unit).orderBy(year)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paired = df.withColumn("pair", F.col(flag) & F.coalesce(F.lead(flag).over(w), F.lit(True)))
    ever = F.max("pair").over(so_far)
    return paired.withColumn("confirmed", F.col(flag) & ever).withColumn("persistent", ever).drop("pair")


def cumulative(df: DataFrame, unit: list[str], year: str, flag: str, licence: str | None = None) -> DataFrame:
    """`ever`: whether the flag was set so far; years before `licence` are always false and don't count."""
    flagged = F.col(flag) if licence is None else F.col(flag) & (F.col(year) >= F.col(licence))
    w = Window.partitionBy(*unit).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("ever", F.max(flagged).over(w))


def stock(df: DataFrame, year: str, flag: str, confirmed: str, persistent: str) -> DataFrame:
    """Of each year how much of the persistent stock is seen (sustained) or only inherited, what was rejected, and the
    changes from the year before."""
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    rows = df.groupBy(year).agg(n(F.col(persistent) & F.col(flag)).alias("sustained"), n(F.col(persistent) & ~F.col(flag)).alias("inherited"), n(F.col(flag) & ~F.col(confirmed)).alias("rejected"))
    w = Window.orderBy(year)  # one row a year
    return rows.withColumn("change", F.col("sustained") + F.col("inherited") - F.lag(F.col("sustained") + F.col("inherited")).over(w))


def churn(df: DataFrame, unit: list[str], year: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """(t0, t1, stayed, lost, gained, churn, jaccard) of units that are there in two years: units are counted in one pass,
    by which of the years they are in."""
    years = sorted({y for p in pairs for y in p})
    seen = df.where(F.col(year).isin(years)).groupBy(*unit).agg(*[F.max(F.col(year) == y).alias(f"y{y}") for y in years])
    tally = seen.agg(*[F.count_if(c).alias(f"{name}_{a}_{b}") for a, b in pairs for name, c in (("stayed", F.col(f"y{a}") & F.col(f"y{b}")), ("lost", F.col(f"y{a}") & ~F.col(f"y{b}")), ("gained", ~F.col(f"y{a}") & F.col(f"y{b}")))])
    rows = tally.select(F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("t0"), F.lit(b).cast("long").alias("t1"), *[F.col(f"{k}_{a}_{b}").alias(k) for k in ("stayed", "lost", "gained")]) for a, b in pairs])).alias("r")).select("r.*")
    changed = F.col("lost") + F.col("gained")
    return rows.withColumn("churn", F.try_divide(changed.cast("double"), changed + F.col("stayed"))).withColumn("jaccard", F.try_divide(F.col("stayed").cast("double"), changed + F.col("stayed")))


def lost_destination(before: DataFrame, after: DataFrame, unit: list[str], label: str, wanted: str) -> DataFrame:
    """Where units of one class go: (destination, n) with a total under null; units that are gone are `none`."""
    left = before.where(F.col(label) == wanted).select(*unit)
    to = left.join(after.select(*unit, F.col(label).alias("destination")), unit, "left").withColumn("destination", F.coalesce("destination", F.lit("none")))
    return to.where(F.col("destination") != wanted).rollup("destination").agg(F.count("*").alias("n"))
