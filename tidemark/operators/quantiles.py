"""Exact quantiles of any number of rows, without sorting them or holding their values in one task.

Sketches of bounded size bracket each quantile; a second pass counts what lies below the bracket and the values within it, which
are a few ten-thousandths of the rows. Both passes sum in tasks first. Nothing is collected: the result is a plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import checkpoint_dir

#: A sketch's rank is off by a row in so many at most; the bracket has three times as much room on each side. So many rows need none.
ACCURACY = 10_000
ROOM = 3 / ACCURACY


def exact_quantiles(df: DataFrame, groups: list[str], targets: dict[str, tuple[Column, float]]) -> DataFrame:
    """(groups, one column a target): the exact quantile of a numeric expression, interpolated between neighbours as usual; null and
    NaN values don't count, and a group without values has null. Groups are few (years, classes): a row each is broadcast. Null
    groups are one group. Without groups the result is one row."""
    n_of, own, names = range(len(targets)), [f"own{i}" for i in range(len(groups))], [f"g{i}" for i in range(len(groups))]
    held = df.select(*[F.col(g).alias(a) for g, a in zip(groups, own, strict=True)], *[F.nanvl(c.cast("double"), F.lit(None)).alias(f"v{k}") for k, (c, _) in zip(n_of, targets.values(), strict=True)])

    def edges(k: int, q: float) -> Column:
        low, high = q - ROOM, q + ROOM
        sketch = F.percentile_approx(f"v{k}", F.array(*[F.lit(min(max(x, 0.0), 1.0)) for x in (low, high)]), F.lit(ACCURACY))
        few = F.count(f"v{k}") <= ACCURACY
        low_edge = F.when(few, F.min(f"v{k}")).otherwise(sketch[0]) if low > 0 else F.min(f"v{k}")
        high_edge = F.when(few, F.max(f"v{k}")).otherwise(sketch[1]) if high < 1 else F.max(f"v{k}")
        return F.struct(F.lit(k).alias("k"), F.lit(q).alias("q"), F.count(f"v{k}").alias("n"), low_edge.alias("low"), high_edge.alias("high"))

    brackets = held.groupBy(*own).agg(F.array(*[edges(k, q) for k, (_, q) in zip(n_of, targets.values(), strict=True)]).alias("b"))
    brackets = brackets.select(*[F.col(a).alias(g) for a, g in zip(own, names, strict=True)], F.explode("b").alias("b")).select(*names, "b.*")
    values = held.select(*own, F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.col(f"v{k}").alias("v")) for k in n_of])).alias("x")).select(*own, "x.*").where(F.col("v").isNotNull())
    same = F.col("of") == F.col("k")
    for a, g in zip(own, names, strict=True):
        same &= F.col(a).eqNullSafe(F.col(g))
    met = values.join(F.broadcast(brackets), same).where(F.col("v") <= F.col("high"))  # a row a group and target
    counted = met.groupBy(*names, "k", "q", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("value")).agg(F.count("*").alias("here"))
    so_far = F.sum("here").over(Window.partitionBy(*names, "k").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("q") * (F.col("n") - 1)
    at = lambda rank: F.min(F.when(F.col("so_far") > F.col(rank), F.struct(F.col("so_far"), F.col("value"))))
    ranked = counted.withColumn("so_far", so_far).withColumns({"lower": F.floor(place), "upper": F.ceil(place), "place": place})
    found = ranked.groupBy(*names, "k").agg(at("lower").alias("a"), at("upper").alias("b"), F.max("place").alias("place"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    a, b = F.col("a.value"), F.col("b.value")
    between = F.when((F.col("lower") == F.col("upper")) | (a == b), a).otherwise((F.col("upper") - F.col("place")) * a + (F.col("place") - F.col("lower")) * b)
    # A bracket that misses its quantile would mean a sketch beyond its stated error.
    checked = F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a sketch missed its quantile")).cast("double")).otherwise(between)
    one = found.select(*names, "k", checked.alias("quantile"))
    wide = one.groupBy(*names).agg(*[F.max(F.when(F.col("k") == k, F.col("quantile"))).alias(f"t{k}") for k in n_of])
    out = [F.col(f"t{k}").alias(name) for k, name in zip(n_of, targets, strict=True)]
    if not groups:
        return wide.select(*out)
    same = F.lit(True)
    for a_, g in zip(own, names, strict=True):
        same &= F.col(a_).eqNullSafe(F.col(g))
    every = held.select(*own).distinct()
    return every.join(F.broadcast(wide), same, "left").select(*[F.col(a_).alias(g) for a_, g in zip(own, groups, strict=True)], *out)


def counts_below(counts: DataFrame, groups: list[str], value: str, n: str) -> DataFrame:
    """The rows (groups, value, n, ...), one for each value of a group, with `below__`, how much of n smaller values of the group
    have, and `total__`, that of all. Values are dealt by range and summed within their part; a group's parts, a row each, give the
    rest, so no task holds a whole group. Rows of null groups are lost."""
    checkpoint_dir(counts.sparkSession)
    dealt = counts.repartitionByRange(*groups, value).withColumn("part__", F.spark_partition_id()).checkpoint()
    key = [*groups, "part__"]
    sums = dealt.groupBy(*key).agg(F.sum(n).alias("own__"))
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))  # a row a part
    before = F.coalesce(F.sum("own__").over(over.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.withColumn("before__", before).withColumn("total__", F.sum("own__").over(over)).drop("own__")
    within = F.coalesce(F.sum(n).over(Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("within__", within).join(parts, key).withColumn("below__", F.col("before__") + F.col("within__")).drop("part__", "before__", "within__")


def exact_median(df: DataFrame, groups: list[str], columns: dict[str, Column]) -> DataFrame:
    return exact_quantiles(df, groups, {name: (c, 0.5) for name, c in columns.items()})


def rank_error(n: int) -> int:
    """Rows within a bracket, at most, of n rows."""
    return math.ceil(n * (2 * ROOM + 2 / ACCURACY)) + 2
