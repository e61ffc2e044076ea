"""End-to-end runs over a grid: areas and growth by unit, areas of layers, and the whole classification.

Units are the sites nearest to a cell. Years, layers and units are few; tables of them are small, tables of cells may be large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import classes, grid, learning, series, spatial, temporal, vector
from tidemark.operators.checkpoints import checkpoint_dir


def by_unit(cells: DataFrame, sites: DataFrame, name: str, xy: tuple[str, str]) -> DataFrame:
    """The cells with the nearest site as `unit`. sites: name and the columns xy (x by column, y by row), in cells."""
    near = spatial.nearest_site(cells, sites, (F.col("col") + 0.5, F.col("row") + 0.5), xy, name, "unit")
    return near.drop("d2")


def _complete(areas: DataFrame, parts: list[DataFrame], value: str) -> DataFrame:
    """Every combination of the parts' rows, 0 where there is no area."""
    every = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # units, layers and years: a few rows each
    return every.join(areas, every.columns, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def area_and_growth(cells: DataFrame, sites: DataFrame, name: str, xy: tuple[str, str], first_year: str, years: list[int], cell_km2: float, excluded: Column | None = None) -> DataFrame:
    """(unit, metric, start_year, year, value) from the year in which a cell was first seen as built (C1): the area so far at each
    year, 0 where a unit has none; growth a year between neighbouring years and over the whole span, null where an area is 0.
    Each cell counts from its first year on, so it is summed once by unit and first of `years` that includes it."""
    own = cells.where((F.col(first_year) > 0) & (F.col(first_year) <= max(years)))
    own = own if excluded is None else own.where(~F.coalesce(excluded, F.lit(False)))
    step = F.array_min(F.filter(F.array(*[F.lit(y).cast("long") for y in years]), lambda y: y >= F.col(first_year)))
    new = by_unit(own.select("row", "col", step.alias("year")), sites, name, xy).groupBy("unit", "year").agg(F.count("*").alias("new"))
    table = sites.sparkSession.createDataFrame([(y,) for y in years], "year long")
    full = _complete(new, [sites.select(F.col(name).alias("unit")).distinct(), table], "new")
    areas = full.join(full.select(F.col("unit").alias("u"), F.col("year").alias("y"), F.col("new").alias("n")), (F.col("unit") == F.col("u")) & (F.col("y") <= F.col("year")))
    areas = areas.groupBy("unit", "year").agg((F.sum("n") * cell_km2).alias("km2"))
    rows = areas.select("unit", F.lit("area_km2").alias("metric"), F.lit(None).cast("long").alias("start_year"), "year", F.col("km2").alias("value"))
    pairs = series.pairwise_growth(areas, ["unit"], "year", "km2")
    span = series.span_growth(areas, ["unit"], "year", "km2")
    growth = [g.select("unit", F.lit(metric).alias("metric"), F.col("first_year").alias("start_year"), F.col("last_year").alias("year"), (F.col("growth") * 100).alias("value")) for g, metric in ((pairs, "growth_pct"), (span, "span_growth_pct"))]
    return rows.unionByName(growth[0]).unionByName(growth[1])


def layer_areas(cells: DataFrame, sites: DataFrame, name: str, xy: tuple[str, str], year: str, layer: str, cell_km2: float) -> DataFrame:
    """(unit, layer, year, km2) of every layer, unit and year, 0 where there is nothing."""
    known = cells.where(F.col(layer).isNotNull()).select("row", "col", F.col(year).alias("year"), F.col(layer).alias("layer"))
    areas = by_unit(known, sites, name, xy).groupBy("unit", "layer", "year").agg((F.count("*") * cell_km2).alias("km2"))
    parts = [sites.select(F.col(name).alias("unit")).distinct(), known.select("layer").distinct(), known.select("year").distinct()]
    return _complete(areas, parts, "km2").select("unit", "layer", "year", "km2")


def classified_years(cells: DataFrame, years: list[int], features: list[str], height: int, width: int, sample: int, floor: int, trees: int, guard: int = 5, seed: int = 20250907) -> DataFrame:
    """(row, col, year, label, raw): each year's cells by a forest of its own, and whether they are built after a majority filter
    (P17, M17, M18, G3). cells: row, col, year, features, first_year, valid and excluded."""
    checkpoint_dir(cells.sparkSession)
    out = []
    for y in years:
        own = cells.where(F.col("year") == y)
        labelled = classes.training_labels(own, "first_year", y, "valid", "excluded", guard).checkpoint()
        drawn = learning.training_sample(labelled.where(F.col("training_label").isNotNull()), ["row", "col"], "training_label", sample, floor, seed)
        drawn = drawn.select(*features, "training_label").checkpoint()  # the forest reads it once a level
        model = learning.forest(drawn, features, "training_label", trees, seed)
        named = learning.classified(model, own.where("valid"), features, "label").select("row", "col", "label").checkpoint()
        smooth = grid.majority(named.where(F.col("label") == "built"), height, width).withColumn("raw", F.lit(True))
        both = own.select("row", "col", "year").join(named, ["row", "col"], "left").join(smooth, ["row", "col"], "left")
        out.append(both.withColumn("raw", F.coalesce("raw", F.lit(False))).checkpoint())
    return reduce(DataFrame.unionByName, out)


def classification_run(cells: DataFrame, years: list[int], features: list[str], height: int, width: int, licence: int, sample: int = 200_000, floor: int = 500, trees: int = 300, guard: int = 5) -> DataFrame:
    """(row, col, year, label, raw, confirmed, built, industrial, layer): the whole run (C18). Each year is classified on its own;
    what is built is confirmed by the next year and then stays; mines' footprints since the licence are industrial; one layer
    remains for each cell, by precedence. cells: row, col, year, ndvi, mndwi, ndwi, ndvi_wet and further features, first_year,
    valid, excluded, domain (where footprints may be) and resettled."""
    raw = classified_years(cells, years, features, height, width, sample, floor, trees, guard)
    ruled = temporal.confirm_then_persist(raw, ["row", "col"], "year", "raw").withColumnRenamed("persistent", "built")
    with_bands = ruled.join(cells.select("row", "col", "year", "ndvi", "ndvi_wet", "mndwi", "valid", "domain", "resettled"), ["row", "col", "year"])
    prints = classes.footprints(with_bands, "year", "domain", licence).withColumn("industrial", F.lit(True))
    marked = with_bands.join(prints, ["year", "row", "col"], "left").withColumn("industrial", F.coalesce("industrial", F.lit(False)))
    layered = classes.exclusive_layers(marked, "label", "built", "industrial", "resettled")
    return layered.select("row", "col", "year", "label", "raw", "confirmed", "built", "industrial", "layer")


def layer_polygons(run: DataFrame, year: int) -> vector.Vectors:
    """The polygons of one year's layers."""
    return vector.polygons(run.where((F.col("year") == year) & F.col("layer").isNotNull()), "layer")
