"""Polygons and lines against the cells of a grid, unions of polygons and buffers of points.

A polygon is a row (zone, rings) as in `zones`. Sides are cut at the lines of the grid, and each piece goes to its cell: no polygon
is ever copied to the cells that it covers. The expressions are native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import zones
from tidemark.operators.checkpoints import checkpoint_dir
from tidemark.operators.linking import ring_order

#: Pieces of a side shorter than this share of it come from rounding.
LEAST = 1e-12
#: Cells covered less than this have no cover but rounding.
NO_COVER = 1e-13
#: Polygons, and pieces of sides, that a task takes, about.
POLYGONS, TASK = 1 << 14, 1 << 17


def oriented_sides(polygons: DataFrame, zone: list[str]) -> DataFrame:
    """(zone, x1, y1, x2, y2) of all sides, so that a side that goes up has the polygon at larger x: rings within an odd number of
    the polygon's other rings are holes, whatever their direction."""
    ring = polygons.select(*zone, F.col("rings").alias("all__"), F.posexplode("rings").alias("k__", "ring__")).where(F.size("ring__") > 2)
    x, y = F.col("ring__")[0]["x"], F.col("ring__")[0]["y"]
    others = F.filter("all__", lambda r, k: k != F.col("k__"))
    depth = F.aggregate(F.transform(others, lambda r: zones.inside(x, y, zones.edges(F.array(r))).cast("int")), F.lit(0), lambda a, b: a + b)
    sides = zones.edges(F.array("ring__"))
    turn = F.aggregate(sides, F.lit(0.0), lambda a, e: a - (e["x1"] + e["x2"]) / 2 * (e["y2"] - e["y1"]))
    flips = (turn < 0) != (depth % 2 == 1)
    one = ring.select(*zone, flips.alias("flips__"), F.explode(sides).alias("e"))
    names = ("x1", "y1", "x2", "y2")
    back = dict(zip(names, ("x2", "y2", "x1", "y1"), strict=True))
    return one.select(*zone, *[F.when(F.col("flips__"), F.col(f"e.{back[c]}")).otherwise(F.col(f"e.{c}")).alias(c) for c in names])


def _crossings(at: str, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Points struct(t, x, y) at which a side crosses the lines of one axis: a, b its ends along it, c, d across."""
    low, high = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
    lines = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    def point(k: Column) -> Column:
        t = (k - a) / (b - a)
        along, across = k.cast("double"), c + t * (d - c)
        return F.struct(t.alias("t"), (along if at == "x" else across).alias("x"), (across if at == "x" else along).alias("y"))

    return F.transform(lines, point)


def break_points(sides: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, points): of each side (x1, y1, x2, y2, in cells) its ends and crossings of grid lines in order, as struct(t, x, y)."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    ends = [F.struct(F.lit(t).alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for t, x, y in ((0.0, "x1", "y1"), (1.0, "x2", "y2"))]
    inner = F.concat(_crossings("x", x1, x2, y1, y2), _crossings("y", y1, y2, x1, x2))
    return sides.select(*keep, F.array_sort(F.concat(F.array(*ends), inner)).alias("points"))


def pieces(sides: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, row, col, x1, y1, x2, y2): the sides cut at grid lines, each piece with its cell."""
    cut = break_points(sides, keep)
    runs = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    one = cut.select(*keep, F.explode(F.filter(runs, lambda r: r["b"]["t"] - r["a"]["t"] > LEAST)).alias("r"))
    p, q = F.col("r.a"), F.col("r.b")
    return one.select(*keep, F.floor((p["y"] + q["y"]) / 2).alias("row"), F.floor((p["x"] + q["x"]) / 2).alias("col"), p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


def in_cells(sides: DataFrame, keep: list[str], x0: float, y0: float, width: float, height: float) -> DataFrame:
    """Coordinates as numbers of cells from a corner of the grid."""
    scaled = {c: (F.col(c) - (x0 if c[0] == "x" else y0)) / (width if c[0] == "x" else height) for c in ("x1", "y1", "x2", "y2")}
    return sides.select(*keep, *[v.alias(k) for k, v in scaled.items()])


def coverage_runs(polygons: DataFrame, zone: list[str], x0: float = 0.0, y0: float = 0.0, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(zone, row, col_from, col_to, fraction): which part of the cells of a run a polygon covers (J23). A piece of a side covers
    what lies right of it in its cell and, by its rise, all of the row further right; sums from the left give each cell, and the
    cells between two of them share one fraction. Cells without cover are left out."""
    checkpoint_dir(polygons.sparkSession)
    dealt = polygons.repartition(1 + polygons.count() // POLYGONS, *zone, "rings")
    sides = in_cells(oriented_sides(dealt, zone), zone, x0, y0, width, height).checkpoint()
    # As many tasks as the pieces ask, both to cut the sides and to add up the pieces.
    count = F.ceil(F.abs(F.col("x2") - F.col("x1"))) + F.ceil(F.abs(F.col("y2") - F.col("y1"))) + 1
    tasks = 1 + int((sides.agg(F.sum(count)).first()[0] or 0) // TASK)
    own = pieces(sides.repartition(tasks, *zone, "x1", "y1", "x2", "y2"), zone).repartition(tasks, *zone, "row")
    rise = F.col("y2") - F.col("y1")
    cells = own.groupBy(*zone, "row", "col").agg(F.sum(rise).alias("rise"), F.sum(rise * (F.col("col") + 1 - (F.col("x1") + F.col("x2")) / 2)).alias("own"))
    w = Window.partitionBy(*zone, "row").orderBy("col")
    before = F.coalesce(F.sum("rise").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = cells.withColumn("before", before).withColumn("then", F.lead("col").over(w))
    at = F.struct(F.col("col").alias("col_from"), F.col("col").alias("col_to"), (F.col("before") + F.col("own")).alias("fraction"))
    gap = F.struct((F.col("col") + 1).alias("col_from"), (F.col("then") - 1).alias("col_to"), (F.col("before") + F.col("rise")).alias("fraction"))
    runs = placed.select(*zone, "row", F.explode(F.array(at, gap)).alias("r")).select(*zone, "row", "r.*")
    return runs.where((F.col("col_to") >= F.col("col_from")) & (F.col("fraction") > NO_COVER))


def coverage(polygons: DataFrame, zone: list[str], x0: float = 0.0, y0: float = 0.0, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(zone, row, col, fraction): the same with a row for each cell."""
    runs = coverage_runs(polygons, zone, x0, y0, width, height)
    return runs.select(*zone, "row", F.explode(F.sequence("col_from", "col_to")).alias("col"), "fraction")


def areas(polygons: DataFrame, zone: list[str]) -> DataFrame:
    """(zone, area): holes taken off."""
    sides = oriented_sides(polygons, zone)
    return sides.groupBy(*zone).agg(F.sum(-(F.col("x1") + F.col("x2")) / 2 * (F.col("y2") - F.col("y1"))).alias("area"))


def share_in_box(polygons: DataFrame, zone: list[str], west: float, south: float, east: float, north: float) -> DataFrame:
    """(zone, area, share): the share of each polygon's area in a rectangle, 0 without any (J23): the rectangle is one cell."""
    runs = coverage_runs(polygons, zone, west, south, east - west, north - south)
    inside = runs.where((F.col("row") == 0) & F.lit(0).between(F.col("col_from"), F.col("col_to"))).select(*zone, (F.col("fraction") * ((east - west) * (north - south))).alias("within"))
    return areas(polygons, zone).join(inside, zone, "left").select(*zone, "area", F.coalesce(F.try_divide("within", "area"), F.lit(0.0)).alias("share"))


def touched_cells(lines: DataFrame, keep: list[str], x0: float = 0.0, y0: float = 0.0, size: float = 1.0) -> DataFrame:
    """(keep, row, col): every cell that a segment (x1, y1, x2, y2) meets, once for each value of `keep` (S13). Cells are half
    open, so a point on a line of the grid belongs to the cell after it."""
    cut = break_points(in_cells(lines, keep, x0, y0, size, size), keep)
    middles = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(((b["t"] - a["t"])).alias("t"), ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
    places = F.concat("points", F.filter(middles, lambda m: m["t"] > LEAST))
    cells = F.array_distinct(F.transform(places, lambda p: F.struct(F.floor(p["y"]).alias("row"), F.floor(p["x"]).alias("col"))))
    return cut.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.row", "c.col").distinct()


def dissolved(polygons: DataFrame, zone: list[str]) -> DataFrame:
    """(zone, ring, at, x, y): corners of the rings around the union of each zone's polygons, which may touch but not overlap, and
    share the corners along which they touch (S14). Sides that two polygons walk in opposite directions cancel; what is left is
    put in order by doubling. Where a corner has several ways on, the sharpest turn to the polygon's side is taken, so that parts
    which only touch at a corner stay apart."""
    checkpoint_dir(polygons.sparkSession)
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    sides = oriented_sides(polygons, zone).select(*zone, a.alias("a"), b.alias("b")).where("a <> b")
    net = sides.groupBy(*zone, F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("net"))
    left = net.where("net <> 0").select(*zone, F.when(F.col("net") > 0, F.col("low")).otherwise(F.col("high")).alias("a"), F.when(F.col("net") > 0, F.col("high")).otherwise(F.col("low")).alias("b"))
    left = left.withColumn("head", F.monotonically_increasing_id()).checkpoint()
    then = left.select(*zone, F.col("a").alias("b"), F.col("b").alias("c"), F.col("head").alias("next"))
    # The polygon lies right of a side that goes up, so clockwise; the sharpest clockwise turn comes first.
    heading = lambda p, q: F.atan2(F.col(q)["y"] - F.col(p)["y"], F.col(q)["x"] - F.col(p)["x"])
    turn = F.pmod(heading("b", "c") - heading("a", "b") + F.pi(), F.lit(2) * F.pi())
    ways = left.join(then, [*zone, "b"]).groupBy(*zone, "head", "a").agg(F.min_by("next", F.struct(turn, F.col("next"))).alias("next"), F.lit(1).alias("n"))
    ways = ways.checkpoint()
    order = ring_order(ways.select("head", "next", "n"))
    return ways.join(order, "head").select(*zone, "ring", "at", F.col("a.x").alias("x"), F.col("a.y").alias("y"))


def ring_areas(corners: DataFrame, zone: list[str]) -> DataFrame:
    """(zone, ring, area, n) of rings given as corners in order; areas of holes are negative."""
    w = Window.partitionBy(*zone, "ring").orderBy("at")
    first = Window.partitionBy(*zone, "ring").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in ("x", "y"))
    return corners.withColumn("part", -(F.col("x") + nx) / 2 * (ny - F.col("y"))).groupBy(*zone, "ring").agg(F.sum("part").alias("area"), F.count("*").alias("n"))


def buffers(sites: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Sites with a place, and those without one, which have no buffer and are reported."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    return sites.where(known), sites.where(~known)


def within_buffers(points: DataFrame, sites: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """The points within a radius of any site (S15), once each; sites and points are dealt by squares of the radius, so only near
    ones meet. Sites without a place don't count."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    square = lambda c: F.floor(F.col(c) / radius)
    placed, _ = buffers(sites, x, y)
    near = placed.select(F.col(x).alias("sx__"), F.col(y).alias("sy__"), F.explode(steps).alias("s"))
    near = near.select("sx__", "sy__", (square("sx__") + F.col("s.i")).alias("cx__"), (square("sy__") + F.col("s.j")).alias("cy__"))
    own = points.withColumn("px__", square(x)).withColumn("py__", square(y))
    dx, dy = F.col(x) - F.col("sx__"), F.col(y) - F.col("sy__")
    met = (F.col("px__") == F.col("cx__")) & (F.col("py__") == F.col("cy__")) & (dx * dx + dy * dy <= radius * radius)
    return own.join(near, met, "left_semi").drop("px__", "py__")
