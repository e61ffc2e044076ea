"""Allocation and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles


def allocated(df: DataFrame, zone: list[str], weight: str, total: Column) -> DataFrame:
    """`allocated`: the zone's total by weight; null where a zone has no weight. Zone sums are aggregated and joined, so a
    zone with very many rows is summed where it is read."""
    sums = df.groupBy(*zone).agg(F.sum(F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0))).alias("weight_sum"))
    part = F.try_divide(F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)), F.nullif(F.col("weight_sum"), F.lit(0)))
    return df.join(sums, zone).withColumn("allocated", part * total).drop("weight_sum")


def floor_and_ceiling(df: DataFrame, group: list[str], value: str, fractions: dict[str, str]) -> DataFrame:
    """(group, class, floor, ceiling): the value by area share, and all of it to the first class (in order) that is there."""
    names = list(fractions)
    top = F.coalesce(*[F.when(F.col(fractions[n]) > 0, F.lit(n)) for n in names])
    sums = [F.struct(F.lit(n).alias("class"), F.sum(F.col(value) * F.col(fractions[n])).alias("floor"), F.sum(F.when(F.col("top") == n, F.col(value)).otherwise(0)).alias("ceiling")) for n in names]
    return df.withColumn("top", top).groupBy(*group).agg(F.array(*sums).alias("rows")).select(*group, F.explode("rows").alias("r")).select(*group, "r.*")


def scenarios(units: DataFrame, value: str, rates: dict[str, float], migration: list[float], years: list[int]) -> DataFrame:
    """(…, scenario, migration, years, projected): every unit under every combination of parameters; the combinations are an
    array in the plan."""
    grid = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("rate"), F.lit(m).alias("migration"), F.lit(y).cast("long").alias("years")) for n, r in rates.items() for m in migration for y in years])
    rows = units.withColumn("p", F.explode(grid)).select(*units.columns, "p.*")
    return rows.withColumn("projected", F.col(value) * F.pow(1 + F.col("rate") + F.col("migration"), F.col("years")))


def envelope(df: DataFrame, group: list[str], estimators: list[str]) -> DataFrame:
    """(group, low, high, spread_pct) over estimators; null ones don't count."""
    cols = [F.col(c) for c in estimators]
    low, high = F.least(*cols), F.greatest(*cols)
    return df.select(*group, low.alias("low"), high.alias("high"), (F.try_divide(high - low, low) * 100).alias("spread_pct"))


def nearest_year(df: DataFrame, other: DataFrame, key: list[str], year: str, other_year: str) -> DataFrame:
    """The other table's row of the nearest year by key; ties go to the smaller year (J16). Only years are compared in pairs:
    rows are joined by key, year and its nearest year."""
    years = df.select(*key, year).distinct().join(other.select(*key, F.col(other_year).alias("near")).distinct(), key)
    best = years.groupBy(*key, year).agg(F.min(F.struct(F.abs(F.col("near") - F.col(year)).alias("d"), F.col("near"))).alias("b")).select(*key, year, F.col("b.near").alias(other_year))
    return df.join(best, [*key, year]).join(other, [*key, other_year])


def share_over(df: DataFrame, group: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(w)))


#: The named estimators of a cluster's population: shares of two built-up layers, cells with any built-up share, those with at
#: least the median share, and the whole cluster, which bounds the others from above.
ESTIMATORS = ("own_share", "other_share", "any_built", "median_built", "whole")
RESTRICTED = ESTIMATORS[:-1]


def estimators(cells: DataFrame, cluster: list[str], value: str, share: str, other_share: str) -> DataFrame:
    """(cluster, own_share, other_share, any_built, median_built, whole, floor, ceiling, n, n_built, median_share): a population
    layer under five weights (A31), from one pass and the exact median of the positive shares of each cluster. Values without
    data or below 0 count as 0; shares are cut to 0 and 1. floor: the least of the restricted ones; ceiling: the whole."""
    clean = F.greatest(F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None)), F.lit(0.0)), F.lit(0.0))
    part = lambda c: F.least(F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    own = cells.select(*cluster, clean.alias("value__"), part(share).alias("share__"), part(other_share).alias("other__"))
    cuts = exact_quantiles(own, cluster, {"median_share": (F.when(F.col("share__") > 0, F.col("share__")), 0.5)})
    names = [f"c{k}__" for k in range(len(cluster))]
    same = F.lit(True)
    for c, n in zip(cluster, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    joined = own.join(F.broadcast(cuts.withColumnsRenamed(dict(zip(cluster, names, strict=True)))), same)  # a row a cluster
    v, s = F.col("value__"), F.col("share__")
    sums = {
        "own_share": v * s, "other_share": v * F.col("other__"), "any_built": F.when(s > 0, v).otherwise(0.0),
        "median_built": F.when((s > 0) & (s >= F.col("median_share")), v).otherwise(0.0), "whole": v,
    }
    out = joined.groupBy(*cluster).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count("*").alias("n"), F.count_if(s > 0).alias("n_built"), F.max("median_share").alias("median_share"))
    return out.select(*cluster, *ESTIMATORS, F.least(*RESTRICTED).alias("floor"), F.col("whole").alias("ceiling"), "n", "n_built", "median_share")


def deviations(estimated: DataFrame, observed: DataFrame, cluster: list[str], total: str) -> DataFrame:
    """(cluster, estimator, estimate, observed, deviation_pct) of each estimator where an observed total is known (A31): which of
    them the observation bears out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("estimator"), F.col(n).alias("estimate")) for n in ESTIMATORS])
    long = estimated.select(*cluster, F.explode(pairs).alias("e")).select(*cluster, "e.*")
    return long.join(observed.select(*cluster, F.col(total).alias("observed")), cluster).withColumn("deviation_pct", F.try_divide(F.col("estimate") - F.col("observed"), F.col("observed")) * 100)


def left_out(cells: DataFrame, cluster: list[str], fold: str, value: str, weight: str) -> DataFrame:
    """(cluster, fold, observed, predicted, deviation_pct): what each fold's share of the weight, at the rate of the cluster's other
    folds, makes of it (A31): held-out estimates by taking the fold's sums off the cluster's, without a fit for each fold. Null
    where the others have no weight."""
    sums = cells.groupBy(*cluster, fold).agg(F.sum(value).alias("observed"), F.sum(weight).alias("weight__"))
    totals = sums.groupBy(*cluster).agg(F.sum("observed").alias("all__"), F.sum("weight__").alias("all_weight__"))
    both = sums.join(totals, cluster)
    rest, rest_weight = F.col("all__") - F.col("observed"), F.col("all_weight__") - F.col("weight__")
    out = both.withColumn("predicted", F.when(rest_weight > 0, F.col("weight__") * rest / rest_weight))
    return out.select(*cluster, fold, "observed", "predicted", (F.try_divide(F.col("predicted") - F.col("observed"), F.col("observed")) * 100).alias("deviation_pct"))


def modelled_points(estimated: DataFrame, cluster: list[str], year: int, central: str = "any_built") -> DataFrame:
    """(cluster, year, variable, value, low, high, flag): one modelled point a cluster with its bounds (C10); no value where the
    cluster has no built-up cell, as a floor of 0 is none."""
    known = F.col("n_built") > 0
    fields = {"value": central, "low": "floor", "high": "ceiling"}
    return estimated.select(*cluster, F.lit(year).alias("year"), F.lit("population").alias("variable"), *[F.when(known, F.col(c)).alias(n) for n, c in fields.items()], F.when(known, "modelled").otherwise("missing").alias("flag"))


def sensitivity_rows(estimated: DataFrame, deviation: DataFrame, cluster: list[str]) -> DataFrame:
    """(cluster, kind, name, value): a row for each estimator, one with floor and ceiling each, one for the spread between them,
    and one for each deviation from an observed total (C12), as one long table."""
    pairs = [F.struct(F.lit("estimate").alias("kind"), F.lit(n).alias("name"), F.col(n).alias("value")) for n in ESTIMATORS]
    pairs += [F.struct(F.lit("bound").alias("kind"), F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("floor", "ceiling")]
    spread = F.try_divide(F.col("ceiling") - F.col("floor"), F.col("floor")) * 100
    pairs.append(F.struct(F.lit("bound").alias("kind"), F.lit("spread_pct").alias("name"), spread.alias("value")))
    rows = estimated.select(*cluster, F.explode(F.array(*pairs)).alias("r")).select(*cluster, "r.*")
    checks = deviation.select(*cluster, F.lit("deviation_pct").alias("kind"), F.col("estimator").alias("name"), F.col("deviation_pct").alias("value"))
    return rows.unionByName(checks)
