"""Cells and points in a table of polygons, and statistics by zone.

A polygon is a row (zone, rings): `rings` is an array of arrays of struct(x, y), outer rings and holes alike, as the even-odd rule
tells them apart. Sides and points are dealt by square cells, so that a point meets only the sides in its cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def edges(rings: Column) -> Column:
    """Struct(x1, y1, x2, y2) of every side of every ring, the last corner joined to the first."""

    def of_ring(ring: Column) -> Column:
        ends = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
        return F.zip_with(ring, ends, lambda a, b: F.named_struct(F.lit("x1"), a["x"], F.lit("y1"), a["y"], F.lit("x2"), b["x"], F.lit("y2"), b["y"]))

    return F.flatten(F.transform(rings, of_ring))


def inside(x: Column, y: Column, sides: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of sides."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(sides, crosses)) % 2 == 1


def distance(x: Column, y: Column, sides: Column) -> Column:
    """The distance to the nearest side."""

    def to_side(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(x - e["x1"] - along * dx, y - e["y1"] - along * dy)

    return F.array_min(F.transform(sides, to_side))


def _at(e: Column, y: Column) -> Column:
    """Where the line of a side is at a height; null for level sides."""
    return F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]


def _spans(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _crossed(x: Column, y: Column, right: Column, top: Column, sides: Column) -> Column:
    """How many of the sides, up to an even number, a way from a point crosses that goes level to `right`, then up to `top`.

    A point on a side lies to its right, as in inside(): which side of it the bend is on follows from the same comparison for both
    parts of the way, so that no rounding lets one part cross where the other doesn't."""

    def above(e: Column, height: Column) -> Column:
        falls = (e["x2"] > e["x1"]) != (e["y2"] > e["y1"])
        return F.when(_spans(e, height), (right < _at(e, height)) == falls).otherwise(e["y1"] > height)

    def odd(e: Column) -> Column:
        level = F.when(_spans(e, y), (x < _at(e, y)) != (right < _at(e, y))).otherwise(F.lit(False))
        upward = F.when((e["x1"] > right) != (e["x2"] > right), above(e, y) != above(e, top)).otherwise(F.lit(False))
        return level != upward

    return F.size(F.filter(sides, odd))


def _squares(polygons: DataFrame, zone: str, cell: float, buffer: float) -> DataFrame:
    """(zone__, shape__, copies__, bx__, by__, sides__, corner__): the squares that a side of a polygon, widened by the buffer, meets,
    with these sides alone, and squares within; corner__: 1 where the upper right corner of the square lies within.

    Sides are cut by rows of squares and then by columns. Corners come from the sides that cross a line of the grid: in order,
    each odd one opens a stretch within that the next one closes."""
    named = polygons.select(F.col(zone).alias("zone__"), F.col("rings").alias("rings__"), F.xxhash64("rings").alias("shape__"))
    whole = named.groupBy("zone__", "shape__").agg(F.count("*").alias("copies__"), F.first("rings__").alias("rings__"))
    key = ["zone__", "shape__", "copies__"]
    side = whole.select(*key, F.explode(edges(F.col("rings__"))).alias("side__"))
    e = F.col("side__")
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    wide = buffer + cell * 1e-6  # a side on the line between two squares counts for both

    def bins(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / cell), F.floor(end / cell)))

    rows = side.withColumn("by__", bins(low - wide, high + wide))
    ends = [(F.col("by__") * cell - wide), ((F.col("by__") + 1) * cell + wide)]
    cut = [F.coalesce(_at(e, F.least(F.greatest(end, low), high)), other) for end, other in zip(ends, (e["x1"], e["x2"]), strict=True)]
    met = rows.withColumn("bx__", bins(F.least(*cut) - wide, F.greatest(*cut) + wide)).select(*key, "bx__", "by__", "side__", F.lit(0).alias("corner__"))

    lines = side.withColumn("line__", bins(low, high + cell)).where(_spans(e, F.col("line__") * cell))
    lines = lines.select(*key, "line__", _at(e, F.col("line__") * cell).alias("x__"))
    order = Window.partitionBy("zone__", "shape__", "line__").orderBy("x__")
    stretches = lines.withColumn("to__", F.lead("x__").over(order)).withColumn("n__", F.row_number().over(order)).where(F.col("n__") % 2 == 1)
    within = stretches.withColumn("bx__", bins(F.col("x__") - 2 * cell, F.col("to__")))
    corner = (F.col("bx__") + 1) * cell
    within = within.where((F.col("x__") <= corner) & (corner < F.col("to__")))
    none = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    within = within.select(*key, "bx__", (F.col("line__") - 1).alias("by__"), none.alias("side__"), F.lit(1).alias("corner__"))
    return met.unionByName(within).groupBy(*key, "bx__", "by__").agg(F.collect_list("side__").alias("sides__"), F.max("corner__").alias("corner__"))


def located(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float, zone: str = "zone", buffer: float = 0.0) -> DataFrame:
    """The points with the zone of each polygon that holds them, or that lies within `buffer` of them; a point in several polygons
    gives several rows (J12-J14). Polygons are told apart by zone and rings, repeated ones by their number.

    cell: the side of the squares by which both are dealt. A point meets only the sides in its square: whether the corner of the
    square lies within is known, and the sides crossed on the way to it tell the rest. Points without both numbers lie nowhere."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    own = points.where(~F.isnan(px) & ~F.isnan(py)).withColumn("bx__", F.floor(px / cell)).withColumn("by__", F.floor(py / cell))
    right, top = (F.col("bx__") + 1) * cell, (F.col("by__") + 1) * cell
    hit = (_crossed(px, py, right, top, F.col("sides__")) + F.col("corner__")) % 2 == 1
    if buffer:
        hit = hit | F.coalesce(distance(px, py, F.col("sides__")) <= buffer, F.lit(False))
    found = own.join(_squares(polygons, zone, cell, buffer), ["bx__", "by__"]).where(hit)
    each = found.withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("copies__"))))
    return each.select(*points.columns, F.col("zone__").alias(zone))


def outside(points: DataFrame, polygons: DataFrame, key: list[str], x: str, y: str, cell: float, buffer: float) -> DataFrame:
    """The points in no polygon nor within `buffer` of one."""
    near = located(points.select(*key, x, y), polygons, x, y, cell, buffer=buffer)
    return points.join(near.select(*key).distinct(), key, "left_anti")


def zonal(cells: DataFrame, zone: list[str], value: str) -> DataFrame:
    """(zone, total, mean, largest, n, n_lit, share_lit): statistics of a value by zone; missing values count as 0."""
    v = F.when(F.col(value).isNull() | F.isnan(value), F.lit(0.0)).otherwise(F.col(value).cast("double"))
    lit = F.count_if(v > 0)
    return cells.groupBy(*zone).agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("largest"), F.count("*").alias("n"), lit.alias("n_lit"), (lit / F.count("*")).alias("share_lit"))


def variation(value: Column) -> Column:
    """Aggregate: the coefficient of variation (sample); null below two values or for a mean of 0."""
    return F.when(F.count(value) >= 2, F.try_divide(F.stddev_samp(value), F.avg(value)))


def building_statistics(buildings: DataFrame, unit: str, area: str, neighbour_d2: str, areas_km2: DataFrame) -> DataFrame:
    """(unit, n, density_km2, mean_area, cv_area, mean_neighbour) by unit, from buildings with the squared distance to the nearest
    other one and a table (unit, km2) of denominators (A24); null densities where the denominator is missing or 0."""
    own = buildings.groupBy(unit).agg(F.count("*").alias("n"), F.avg(area).alias("mean_area"), variation(F.col(area)).alias("cv_area"), F.avg(F.sqrt(neighbour_d2)).alias("mean_neighbour"))
    return own.join(areas_km2, unit, "left").withColumn("density_km2", F.when(F.col("km2") > 0, F.col("n") / F.col("km2"))).drop("km2")
