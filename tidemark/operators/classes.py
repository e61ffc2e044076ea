"""Rules that name the class of a cell (P16, P17, P19-P21, G10, G11): tables of cells with a column for each band or mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators.quantiles import exact_quantiles

#: Ratios to the landscape's medians, and bounds in metres, that results must equal.
GREEN_RATIO, FOOTPRINT_RATIO = 1.30, 0.60
IRRIGATED_AMPLITUDE, RAINFED_AMPLITUDE, RAINFED_WET = 0.50, 1.30, 1.00
HEIGHT_LOW_M, HEIGHT_HIGH_M, RIVER_M = -2.0, 10.0, 1000.0
#: Classes of the densification map, by number.
SEVEN = ("outside", "empty", "sparse", "densifying", "expansion", "consolidated", "industrial")


class EmptyReferenceError(ValueError):
    """A reference mask holds no cell."""


def is_number(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])


def medians(df: DataFrame, columns: dict[str, str], where: Column) -> DataFrame:
    """One row with the exact median of each column and the number of cells over a reference mask; an empty mask is an error."""
    own = df.where(where)
    if own.isEmpty():
        raise EmptyReferenceError("the reference mask is empty")
    found = exact_quantiles(own, [], {name: (F.col(c), 0.5) for name, c in columns.items()})
    return found.crossJoin(F.broadcast(own.agg(F.count("*").alias("n_reference"))))  # one row each


def exclusive_layers(df: DataFrame, label: str, built: str, industrial: str, resettled: str, out: str = "layer") -> DataFrame:
    """`layer`: industrial before resettled before built-up; the label of the rest if it is vegetation, bare soil or water."""
    rest = F.when(F.col(label).isin("vegetation", "bare_soil", "water"), F.col(label))
    return df.withColumn(out, F.when(F.col(industrial), "industrial").when(F.col(resettled), "resettled").when(F.col(built), "built_up").otherwise(rest))


def training_labels(df: DataFrame, first_year: str, year: int, valid: str, excluded: str, guard: int = 5, ratio: float = GREEN_RATIO) -> DataFrame:
    """`training_label` of cells (row, col, ndvi, mndwi, ndwi and flags): built where the eroded built-up mask of the year is true;
    elsewhere, off a guard band of `guard` cells around anything ever built and off excluded cells, water, vegetation (ndvi at
    least ratio times its median over this pool without water) or bare soil; null otherwise (P17)."""
    ever = df.where(F.col(first_year) > 0)
    core = grid.eroded(ever.where(F.col(first_year) <= year)).withColumn("core__", F.lit(True))
    near = grid.dilated(ever.select("row", "col"), guard).withColumn("near__", F.lit(True))
    marked = df.join(core, ["row", "col"], "left").join(near, ["row", "col"], "left")
    pool = F.col(valid) & F.col("near__").isNull() & ~F.col(excluded)
    water = (F.col("mndwi") > 0) & (F.col("ndwi") > 0)
    marked = marked.withColumn("pool__", F.coalesce(pool, F.lit(False))).withColumn("water__", F.coalesce(water, F.lit(False)))
    cut = medians(marked, {"median__": "ndvi"}, F.col("pool__") & ~F.col("water__")).select("median__")
    named = marked.crossJoin(F.broadcast(cut))  # one row
    other = F.when(F.col("water__"), "water").when(F.col("ndvi") >= ratio * F.col("median__"), "vegetation").otherwise("bare_soil")
    label = F.when(~F.col(valid), None).when(F.col("core__"), "built").when(F.col("pool__"), other)
    return named.withColumn("training_label", label).drop("core__", "near__", "pool__", "water__", "median__")


def phenology(df: DataFrame, vegetation: str, soil: str, dry: str, wet: str, amplitude: str) -> DataFrame:
    """`crop`: irrigated (green all year: little amplitude in vegetation), rainfed (bare when dry, at least as green as the
    landscape when wet) or null, by ratios to medians over vegetation and soil (P19)."""
    known = is_number(dry, wet, amplitude)
    reference = (F.col(vegetation) | F.col(soil)) & known
    cuts = medians(df, {"amplitude__": amplitude, "wet__": wet}, reference).drop("n_reference")
    a = F.col(amplitude)
    irrigated = F.col(vegetation) & known & (a <= IRRIGATED_AMPLITUDE * F.col("amplitude__"))
    rainfed = F.col(soil) & known & (a >= RAINFED_AMPLITUDE * F.col("amplitude__")) & (F.col(wet) >= RAINFED_WET * F.col("wet__"))
    both = df.crossJoin(F.broadcast(cuts))  # one row
    return both.withColumn("crop", F.when(irrigated, "irrigated").when(rainfed, "rainfed")).drop("amplitude__", "wet__")


def floodplain(height: Column, distance_m: Column) -> Column:
    """Little above the nearest river, a channel's noise below it included, and near it (P20); false where either is missing."""
    return F.coalesce(height.between(HEIGHT_LOW_M, HEIGHT_HIGH_M) & (distance_m <= RIVER_M), F.lit(False))


def densification(df: DataFrame, domain: str, occupied: str, before: str, after: str, signals: list[str], industrial: str, tau: float, high: float, low: float, industrial_q: float, needed: int = 2) -> DataFrame:
    """`votes` and `class` 0 to 6 (SEVEN) of each cell, by quantiles over occupied cells and precedence from industrial down.
    A signal votes in occupied cells where it is above 0 and at least its quantile tau. Without occupied cells nothing votes."""
    own = F.col(occupied)
    cuts = {f"cut_{k}__": (F.when(own, F.col(s)), tau) for k, s in enumerate(signals)}
    cuts |= {name: (F.when(own, F.col(before)), q) for q, name in ((high, "high__"), (low, "low__"))}
    cuts["industrial__"] = (F.when(F.col(domain) & (F.col(industrial) > 0), F.col(industrial)), industrial_q)
    all_of = df.crossJoin(F.broadcast(exact_quantiles(df, [], cuts)))  # one row
    votes = sum((F.coalesce(own & (F.col(s) > 0) & (F.col(s) >= F.col(f"cut_{k}__")), F.lit(False)).cast("int") for k, s in enumerate(signals)), F.lit(0))
    f0, f1 = F.col(before), F.col(after)
    yes = lambda c: F.coalesce(c, F.lit(False))
    middle = F.when(F.col("votes") >= needed, 3).otherwise(2)
    kind = (
        F.when(~F.col(domain), 0).when(yes(F.col(industrial) >= F.col("industrial__")), 6).when(yes(f0 >= F.col("high__")), 5)
        .when(yes((f0 < F.col("low__")) & (f1 >= F.col("low__"))), 4).when(yes((f0 >= F.col("low__")) & (f0 < F.col("high__"))), middle).otherwise(1)
    )
    out = all_of.withColumn("votes", votes).withColumn("class", kind)
    return out.select(*df.columns, "votes", "class")


def persistent_bare(df: DataFrame, year: str, reference: Column, ratio: float = FOOTPRINT_RATIO) -> DataFrame:
    """`bare`: no water, and less green than a part of the landscape's median of its year in the dry and in the wet season."""
    cuts = exact_quantiles(df.where(reference), [year], {"dry__": (F.col("ndvi"), 0.5), "wet__": (F.col("ndvi_wet"), 0.5)})
    known = is_number("ndvi", "ndvi_wet", "mndwi")
    bare = known & (F.col("mndwi") <= 0) & (F.col("ndvi_wet") < ratio * F.col("wet__")) & (F.col("ndvi") < ratio * F.col("dry__"))
    return df.join(F.broadcast(cuts), year, "left").withColumn("bare", F.coalesce(bare, F.lit(False))).drop("dry__", "wet__")  # a row a year


def footprints(df: DataFrame, year: str, domain: str, licence: int, ratio: float = FOOTPRINT_RATIO, lasting: bool = False) -> DataFrame:
    """(year, row, col) of the footprint of each year: cells of the domain that are persistently bare or built, closed by a 3 x 3
    square within the domain; none before the licence (G10). lasting: what was footprint once since the licence stays so."""
    marked = persistent_bare(df, year, F.col("valid") & ~F.coalesce(F.col("mndwi") > 0, F.lit(False)) & ~F.col(domain), ratio)
    seed = marked.where(F.col(domain) & (F.col(year) >= licence) & ((F.col("bare") & F.col("valid")) | F.col("built"))).select(year, "row", "col")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in grid.SQUARE])).alias("s")

    def moved(cells: DataFrame) -> DataFrame:
        return cells.select(year, "row", "col", steps).select(year, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))

    full = moved(moved(seed).distinct()).groupBy(year, "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == len(grid.SQUARE))
    closed = full.select(year, "row", "col").join(df.where(F.col(domain)).select("row", "col").distinct(), ["row", "col"], "left_semi")
    if not lasting:
        return closed
    years = df.select(F.col(year).alias("later")).distinct()
    first = closed.groupBy("row", "col").agg(F.min(year).alias("first"))
    return first.join(F.broadcast(years), F.col("later") >= F.col("first")).select(F.col("later").alias(year), "row", "col")  # a row a year


def footprint_sweep(df: DataFrame, year: str, domains: dict[str, str], licence: int, ratios: list[float], cell_km2: float) -> DataFrame:
    """(domain, ratio, lasting, year, km2) of the footprint under every combination of parameters, 0 where it is empty (G11). The
    table is read once for the medians of all domains and once for the seeds of all combinations, which are rows from there on."""
    names, columns = list(domains), list(domains.values())
    dry_land = F.col("valid") & ~F.coalesce(F.col("mndwi") > 0, F.lit(False))
    cuts = {f"{band}_{k}__": (F.when(dry_land & ~F.col(c), F.col(band)), 0.5) for k, c in enumerate(columns) for band in ("ndvi", "ndvi_wet")}
    marked = df.join(F.broadcast(exact_quantiles(df, [year], cuts)), year)  # a row a year
    dry = is_number("ndvi", "ndvi_wet", "mndwi") & (F.col("mndwi") <= 0)
    cases = []
    for k, c in enumerate(columns):
        for ratio in ratios:
            bare = dry & (F.col("ndvi_wet") < ratio * F.col(f"ndvi_wet_{k}__")) & (F.col("ndvi") < ratio * F.col(f"ndvi_{k}__"))
            seed = F.col(c) & (F.col(year) >= licence) & ((F.coalesce(bare, F.lit(False)) & F.col("valid")) | F.col("built"))
            cases.append(F.when(seed, F.struct(F.lit(names[k]).alias("domain"), F.lit(ratio).alias("ratio"))))
    key = ["domain", "ratio", "year"]
    seeds = marked.select(F.col(year).alias("year"), "row", "col", F.explode(F.array_compact(F.array(*cases))).alias("case")).select("case.*", "year", "row", "col")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in grid.SQUARE])).alias("s")

    def moved(cells: DataFrame) -> DataFrame:
        return cells.select(*key, "row", "col", steps).select(*key, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))

    full = moved(moved(seeds).distinct()).groupBy(*key, "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == len(grid.SQUARE))
    held = [F.when(F.col(c), F.lit(n)) for n, c in domains.items()]
    within = df.select("row", "col", F.explode(F.array_compact(F.array(*held))).alias("domain")).distinct()
    closed = full.select(*key, "row", "col").join(within, ["domain", "row", "col"], "left_semi")
    # A cell's first year in a combination serves the lasting footprint of all later ones.
    w = Window.partitionBy("domain", "ratio", "row", "col")
    counted = closed.withColumn("first", F.min("year").over(w)).groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("year")).alias("new"))
    combos = df.sparkSession.createDataFrame([(n, float(r)) for n in names for r in ratios], "domain string, ratio double")
    every = df.select(F.col(year).alias("year")).distinct().crossJoin(F.broadcast(combos))  # years and parameters: a few rows
    filled = every.join(counted, key, "left").na.fill(0, ["n", "new"])
    so_far = F.sum("new").over(Window.partitionBy("domain", "ratio").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    both = F.array(F.struct(F.lit(False).alias("lasting"), F.col("n")), F.struct(F.lit(True).alias("lasting"), F.col("so_far").alias("n")))
    rows = filled.withColumn("so_far", so_far).select(*key, F.explode(both).alias("b"))
    return rows.select("domain", "ratio", "b.lasting", F.col("year").alias(year), (F.col("b.n") * cell_km2).alias("km2"))


def class_areas(df: DataFrame, group: list[str], kind: str, cell_km2: float) -> DataFrame:
    """(group, class, n, km2, place): areas with their place by size, ties by class."""
    n = df.groupBy(*group, kind).agg(F.count("*").alias("n")).withColumn("km2", F.col("n") * cell_km2)
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), kind)))
