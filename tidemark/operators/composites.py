"""Composites of scenes with gates, substitution and scenarios (A1, A8, C15, M20). Observations are rows (row, col, year, source,
scene, bands ...); null bands are masked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def viability(scenes: DataFrame, key: list[str], band: str, n_cells: int, least_scenes: int = 2, least_seen: int = 2, least_share: float = 0.6) -> DataFrame:
    """(key, n_scenes, share, viable, reason): whether a year's source has scenes enough, and cells enough of the grid's n_cells
    with at least `least_seen` valid observations (A8, C15)."""
    cells = scenes.groupBy(*key, "row", "col").agg(F.count(band).alias("seen"))
    share = cells.groupBy(*key).agg((F.count_if(F.col("seen") >= least_seen) / n_cells).alias("share"))
    counts = scenes.select(*key, "scene").distinct().groupBy(*key).agg(F.count("*").alias("n_scenes"))
    out = counts.join(share, key)
    viable = (F.col("n_scenes") >= least_scenes) & (F.col("share") >= least_share)
    reason = F.format_string("%d scenes (at least %d), share %.3f of cells with %d observations (at least %.3f)", F.col("n_scenes"), F.lit(least_scenes), F.col("share"), F.lit(least_seen), F.lit(least_share))
    return out.select(*key, "n_scenes", "share", viable.alias("viable"), F.when(~viable, reason).alias("reason"))


def chosen_sources(found: DataFrame, year: str, source: str, order: list[str]) -> DataFrame:
    """(year, source, substituted, reasons): of each year the first viable source in order; substituted unless it is the first of
    the order; null with all reasons where none is viable (C15)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source))
    listed = found.withColumn("rank__", rank).where(F.col("rank__") > 0)
    best = F.min(F.when(F.col("viable"), F.struct(F.col("rank__"), F.col(source).alias("source"))))
    refused = F.array_sort(F.collect_list(F.when(~F.col("viable"), F.struct(F.col("rank__"), F.concat(F.col(source), F.lit(": "), F.col("reason")).alias("why")))))
    out = listed.groupBy(year).agg(best.alias("best"), refused.alias("refused"))
    why = F.array_join(F.transform(F.filter("refused", lambda r: F.col("best").isNull() | (r["rank__"] < F.col("best.rank__"))), lambda r: r["why"]), "; ")
    return out.select(year, F.col("best.source").alias(source), (F.col("best.rank__") > 1).alias("substituted"), F.when(why != "", why).alias("reasons"))


def substituted_composite(scenes: DataFrame, year: str, source: str, bands: list[str], order: list[str], least_seen: int = 2) -> DataFrame:
    """(row, col, year, source, n_seen, bands): the median of each cell and band from the first source in order that has
    `least_seen` valid observations of the cell, with its name as provenance; null where none has (C15, a cell at a time). All
    sources are summed up in one aggregation by cell and source; a cell then has a row for each source at most."""
    per = scenes.where(F.col(source).isin(order)).groupBy("row", "col", year, source).agg(F.count(bands[0]).alias("n_seen"), *[F.median(b).alias(b) for b in bands])
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source))
    picked = F.min(F.when(F.col("n_seen") >= least_seen, F.struct(rank.alias("rank"), F.col(source).alias("source"), F.col("n_seen").alias("n"), *bands)))
    out = per.groupBy("row", "col", year).agg(picked.alias("p"))
    return out.select("row", "col", year, F.col("p.source").alias(source), F.coalesce("p.n", F.lit(0)).alias("n_seen"), *[F.col(f"p.{b}").alias(b) for b in bands])


def amplitude(wet: DataFrame, dry: DataFrame, key: list[str], value: str, out: str = "amplitude") -> DataFrame:
    """wet less dry by cell; null where either is missing."""
    return wet.join(dry.select(*key, F.col(value).alias("dry__")), key, "left").withColumn(out, F.col(value) - F.col("dry__")).drop("dry__")


def thinned(scenes: DataFrame, group: list[str], scene: str, when: str, limits: dict[str, int | None]) -> DataFrame:
    """The scenes under each scenario, with a column `scenario` (M20): at most so many scenes of a group, spread evenly over their
    order in time (None keeps all). Scenes, of which there are few, are ranked; their observations are joined to them."""
    few = scenes.select(*group, scene, when).distinct()
    w = Window.partitionBy(*group).orderBy(when, scene)
    ranked = few.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*group)))
    cases = F.array(*[F.struct(F.lit(name).alias("scenario"), F.lit(limit).cast("long").alias("most")) for name, limit in limits.items()])
    each = ranked.withColumn("s", F.explode(cases)).select(*group, scene, "i", "n", "s.*")
    most = F.col("most")
    # Of n scenes in order the k-th of `most` lies at round(k (n - 1) / (most - 1)); a single one is the first.
    step = lambda k: F.floor(k * (F.col("n") - 1) / F.greatest(most - 1, F.lit(1)) + 0.5)
    near = F.floor(F.col("i") * F.greatest(most - 1, F.lit(1)) / F.greatest(F.col("n") - 1, F.lit(1)))
    wanted = F.exists(F.sequence(near - 1, near + 2), lambda k: (k >= 0) & (k < most) & (step(k) == F.col("i")))
    kept = each.where(most.isNull() | (F.col("n") <= most) | wanted).select(*group, scene, "scenario")
    return scenes.join(F.broadcast(kept), [*group, scene])  # a row a scene and scenario


def capacity_experiment(scenes: DataFrame, group: list[str], scene: str, when: str, limits: dict[str, int | None], composite: Callable[[DataFrame, list[str]], DataFrame], classify: Callable[[DataFrame, list[str]], Column], cell_km2: float, base: str) -> DataFrame:
    """(scenario, group, cells, km2, valid_share, change_pct): the area of a class when a year is built from fewer scenes (M20): thin,
    composite by scenario, classify, sum; all scenarios in one plan, the scenario being part of every key. composite takes the
    scenes and the keys beside row and col; classify gives the expression of the class from the composite's columns. change_pct
    is against the scenario `base`."""
    keys = ["scenario", *group]
    made = composite(thinned(scenes, group, scene, when, limits), keys)
    held = classify(made, keys)
    sums = made.groupBy(*keys).agg(F.count("*").alias("n__"), F.count_if(F.coalesce(held, F.lit(False))).alias("cells"), F.count(held).alias("valid__"))
    areas = sums.select(*keys, "cells", (F.col("cells") * cell_km2).alias("km2"), (F.col("valid__") / F.col("n__")).alias("valid_share"))
    of_base = areas.where(F.col("scenario") == base).select(*group, F.col("km2").alias("base__"))
    joined = areas.join(F.broadcast(of_base), group) if group else areas.crossJoin(F.broadcast(of_base))  # a row a group
    return joined.withColumn("change_pct", F.try_divide(F.col("km2") - F.col("base__"), F.col("base__")) * 100).drop("base__")
