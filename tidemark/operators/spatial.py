"""Sites, ranges and points."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import checkpoint_dir

#: Sites, bands or phases that a plan may hold as literals; more of them are joined.
MAX_LITERALS = 2_000
#: Places in a cell with which a search for neighbours begins: at most, and as a place meets them in the mean.
CROWD, MEAN_CROWD = 512, 8
#: Points without a neighbour so far that meet all places.
FEW = 64


def _literals(df: DataFrame, columns: list[str]) -> list | None:
    """The rows, if they are few enough for a plan."""
    rows = df.select(*columns).limit(MAX_LITERALS + 1).collect()
    return rows if len(rows) <= MAX_LITERALS else None


def nearest_site(points: DataFrame, sites: DataFrame, xy: tuple[Column, ...], site_xy: tuple[str, ...], name: str, out: str = "site") -> DataFrame:
    """The name of the nearest site of each point and the squared distance; ties go to the smaller name. Few sites go into the
    plan, so that points are neither joined nor moved; many are dealt by cells, in rounds of growing cells."""
    rows = _literals(sites, [name, *site_xy])
    if rows is None:
        return _nearest_by_cells(points, sites, xy, site_xy, name, out)
    rows = sorted(rows, key=lambda r: r[0])
    choices = []
    for k, row in enumerate(rows):
        d2 = sum(((x - F.lit(float(v))) * (x - F.lit(float(v))) for x, v in zip(xy, row[1:], strict=True)), F.lit(0.0))
        choices.append(F.struct(d2.alias("d2"), F.lit(k).alias("k"), F.lit(row[0]).alias("name")))
    best = F.array_min(F.array(*choices))
    return points.withColumn("best__", best).withColumn(out, F.col("best__.name")).withColumn("d2", F.col("best__.d2")).drop("best__")


def _nearest_by_cells(points: DataFrame, sites: DataFrame, xy: tuple[Column, ...], site_xy: tuple[str, ...], name: str, out: str) -> DataFrame:
    """The same for any number of sites. A site within a cell's side of a point lies in the point's cell or one next to it; points
    without one search on with four times the side. Each round is a checkpoint."""
    checkpoint_dir(points.sparkSession)
    k = range(len(xy))
    marked = points.select("*", *[x.cast("double").alias(f"x{i}__") for i, x in zip(k, xy, strict=True)])
    left = marked.select(*[f"x{i}__" for i in k]).dropna().distinct().checkpoint()
    places = sites.select(F.col(name).alias("name__"), *[F.col(c).cast("double").alias(f"s{i}__") for i, c in zip(k, site_xy, strict=True)]).dropna().checkpoint()
    low_high = places.agg(F.count("*"), *[F.max(f"s{i}__") - F.min(f"s{i}__") for i in k]).first()
    side = max(max(low_high[1:]) / low_high[0] ** (1 / len(xy)), 1e-9)
    steps = [F.struct(*[F.lit(v).alias(f"d{i}") for i, v in zip(k, step, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=len(xy))]
    found = []
    while not left.isEmpty():
        near = places.select("*", F.explode(F.array(*steps)).alias("step__"))
        near = near.select("*", *[(cell(F.col(f"s{i}__"), side) + F.col(f"step__.d{i}")).alias(f"c{i}__") for i in k])
        own = left.select("*", *[cell(F.col(f"x{i}__"), side).alias(f"c{i}__") for i in k])
        d2 = sum(((F.col(f"x{i}__") - F.col(f"s{i}__")) * (F.col(f"x{i}__") - F.col(f"s{i}__")) for i in k), F.lit(0.0))
        met = own.join(near, [f"c{i}__" for i in k]).withColumn("d2", d2).where(F.col("d2") <= side * side)
        best = met.groupBy(*[f"x{i}__" for i in k]).agg(F.min(F.struct("d2", "name__")).alias("best__")).checkpoint()
        found.append(best)
        left = left.join(best, [f"x{i}__" for i in k], "left_anti").checkpoint()
        side *= 4
    every = reduce(DataFrame.unionByName, found)
    both = marked.join(every, [f"x{i}__" for i in k], "left")
    return both.select(*points.columns, F.col("best__.name__").alias(out), F.col("best__.d2").alias("d2"))


def nearest_key(value: Column, keys: list) -> Column:
    """The nearest of a few keys, e.g. anchor years; ties go to the smaller key."""
    return F.array_min(F.array(*[F.struct(F.abs(value - k).alias("d"), F.lit(k).alias("key")) for k in sorted(keys)]))["key"]


def range_band(df: DataFrame, bands: DataFrame, value: Column, low: str, high: str, label: str, out: str = "band") -> DataFrame:
    """The label of the first band (by lower bound) that holds the value, bounds included; null if none does. Few bands go into
    the plan; many are dealt by bins of the mean width, and each distinct value meets those of its bin."""
    rows = _literals(bands, [low, high, label])
    if rows is not None:
        return df.withColumn(out, F.coalesce(*[F.when(value.between(a, b), F.lit(v)) for a, b, v in sorted(rows)]))
    known = bands.where(F.col(low) <= F.col(high)).select(F.col(low).cast("double").alias("low__"), F.col(high).cast("double").alias("high__"), F.col(label).alias("label__"))
    width = max(known.agg(F.avg(F.col("high__") - F.col("low__"))).first()[0] or 0.0, 1e-9)
    binned = known.withColumn("bin__", F.explode(F.sequence(cell(F.col("low__"), width), cell(F.col("high__"), width))))
    marked = df.withColumn("value__", value.cast("double"))
    own = marked.select("value__").dropna().distinct().withColumn("bin__", cell(F.col("value__"), width))
    first = own.join(binned, "bin__").where(F.col("value__").between(F.col("low__"), F.col("high__"))).groupBy("value__").agg(F.min(F.struct("low__", "high__", "label__")).alias("first__"))
    return marked.join(first, "value__", "left").select(*df.columns, F.col("first__.label__").alias(out))


def overlapping(intervals: DataFrame, start: str, end: str, low: float, high: float) -> DataFrame:
    """Intervals that share more than a bound with (low, high); an open end is null."""
    return intervals.where((F.coalesce(F.col(end), F.lit(float("inf"))) > low) & (F.col(start) < high))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def neighbours_in_cells(df: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """(key, other, d2) of all pairs within a radius: points are dealt by cell, one side to the nine cells around."""
    own = df.select(F.col(key), F.col(x).alias("x"), F.col(y).alias("y"), cell(F.col(x), radius).alias("cx"), cell(F.col(y), radius).alias("cy"))
    step = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = df.select(F.col(key).alias("other"), F.col(x).alias("ox"), F.col(y).alias("oy"), F.explode(step).alias("s")).select("other", "ox", "oy", (cell(F.col("ox"), radius) + F.col("s.dx")).alias("cx"), (cell(F.col("oy"), radius) + F.col("s.dy")).alias("cy"))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return own.join(spread, ["cx", "cy"]).where(F.col(key) != F.col("other")).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select(key, "other", "d2")


def nearest_neighbour(df: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """(key, d2) of the nearest other point (J11): one with another key. Points at one place are one with the range of their keys,
    and those with several keys there are found at once. The others search within a radius, at first the given one or, where places
    are dense, one at which a cell holds few; what finds none searches on with four times the radius until that spans all places,
    as it does once few points are left. Those left at a round are farther apart than the radius before, so a cell holds few of
    them, however many places it has. Each round is a checkpoint."""
    checkpoint_dir(df.sparkSession)
    rows = df.select(key, F.col(x).cast("double").alias("x__"), F.col(y).cast("double").alias("y__")).where(F.col(key).isNotNull() & (F.abs("x__") < float("inf")) & (F.abs("y__") < float("inf")))
    places = rows.groupBy("x__", "y__").agg(F.min(key).alias("low__"), F.max(key).alias("high__")).checkpoint()
    shared = places.where(F.col("low__") != F.col("high__"))
    found = [rows.join(shared, ["x__", "y__"], "left_semi").select(key, F.lit(0.0).alias("d2"))]
    left = places.where(F.col("low__") == F.col("high__")).select("x__", "y__", "low__")
    radius, reach = _dealt(places, radius)
    few = FEW + 1
    while True:
        near = _search(left, places, radius, few <= FEW).checkpoint()
        found.append(near.select(F.col("low__").alias(key), "d2"))
        left = left.join(near, ["x__", "y__"], "left_anti").checkpoint()
        few = left.limit(FEW + 1).count()
        if not few or radius > reach:
            break
        # A few that are left meet all places at once.
        radius = 2 * max(reach, radius) if few <= FEW else 4 * radius
    return reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("d2").alias("d2"))


def _dealt(places: DataFrame, radius: float) -> tuple[float, float]:
    """The radius with which a search begins and a length that spans all places: cells of that side hold few places, the most and
    as met by a place. Sides below 2**-30 of the largest coordinate aren't tried, as rounding would tell on the cells."""
    ends = [f(c) for c in ("x__", "y__") for f in (F.min, F.max)]
    west, east, south, north = places.agg(*ends).first()
    if west is None:
        return radius, 0.0
    least = max(abs(v) for v in (west, east, south, north)) * 2.0**-30
    radius = max(radius, least)
    while radius / 4 > least:
        sizes = places.groupBy(cell(F.col("x__"), radius), cell(F.col("y__"), radius)).agg(F.count("*").cast("double").alias("n"))
        most, met = sizes.agg(F.max("n"), F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()
        if most <= CROWD and met <= MEAN_CROWD:
            break
        radius /= 4
    return radius, 2 * ((east - west) + (north - south))


def _search(left: DataFrame, places: DataFrame, radius: float, few: bool) -> DataFrame:
    """(x__, y__, low__, d2) of the places in `left`, each with one key, that have another one within the radius; FEW at most are
    broadcast, as all places may share a cell then. The margin keeps pairs out whose cells rounding may have moved apart; they are
    met in the next round."""
    step = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select("*", F.explode(step).alias("s")).select("x__", "y__", "low__", (cell(F.col("x__"), radius) + F.col("s.dx")).alias("cx"), (cell(F.col("y__"), radius) + F.col("s.dy")).alias("cy"))
    b = places.select(F.col("x__").alias("ox"), F.col("y__").alias("oy"), F.col("low__").alias("from"), F.col("high__").alias("to"), cell(F.col("x__"), radius).alias("cx"), cell(F.col("y__"), radius).alias("cy"))
    dx, dy = F.col("x__") - F.col("ox"), F.col("y__") - F.col("oy")
    met = (F.broadcast(a) if few else a).join(b, ["cx", "cy"]).where((F.col("from") != F.col("low__")) | (F.col("to") != F.col("low__"))).withColumn("d2", dx * dx + dy * dy)
    return met.where(F.col("d2") <= (radius * (1 - 1e-6)) ** 2).groupBy("x__", "y__", "low__").agg(F.min("d2").alias("d2"))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: whether a point lies in a ring of corners (J12); the last corner joins the first."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        at = (F.lit(x2 - x1) * (y - y1)) / F.lit(y2 - y1) + x1
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def direction(dx: str, dy: str, sectors: int = 16) -> list[Column]:
    """Aggregates: mean direction in degrees clockwise from north, and the length of the mean vector."""
    r = F.hypot(F.col(dx), F.col(dy))
    s, c = F.sum(F.try_divide(F.col(dx), r)), F.sum(F.try_divide(F.col(dy), r))
    return [F.pmod(F.degrees(F.atan2(s, c)) + 360, F.lit(360.0)).alias("mean_direction"), F.try_divide(F.hypot(s, c), F.count(F.try_divide(F.col(dx), r))).alias("resultant")]


def sector(dx: Column, dy: Column, sectors: int = 16) -> Column:
    """0 to sectors - 1, clockwise from north, each beginning at its bearing."""
    return F.floor(F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0)) / (360 / sectors)).cast("int")


def grid_sums(df: DataFrame, x: str, y: str, size: float, value: str) -> DataFrame:
    """(col, row, total, n): sums over square cells from the smallest coordinates on; sums are preserved."""
    corner = df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"))
    cells = df.crossJoin(F.broadcast(corner))  # one row
    return cells.groupBy(F.floor((F.col(x) - F.col("x0")) / size).alias("col"), F.floor((F.col(y) - F.col("y0")) / size).alias("row")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def tile_corners(west: float, south: float, east: float, north: float, size: float) -> list[tuple[float, float]]:
    """South-west corners of the tiles that a box meets, half open (S3)."""
    eps = 1e-9
    xs = range(math.floor(west / size), math.ceil(east / size - eps))
    ys = range(math.floor(south / size), math.ceil(north / size - eps))
    return [(i * size, j * size) for j in ys for i in xs]


def utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Easting and northing by the series of the transverse Mercator projection (G15), on the WGS 84 ellipsoid."""
    # Semi-major axis, flattening, scale, false easting and northing.
    a, f, k0, e0, n0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0 if south else 0.0
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi) * F.tan(phi)
    n = a / F.sqrt(1 - e2 * s * s)
    cc, A = ep2 * c * c, c * lam
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = k0 * n * (A + (1 - t + cc) * A**3 / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * A**5 / 120) + e0
    north = k0 * (m + n * F.tan(phi) * (A**2 / 2 + (5 - t + 9 * cc + 4 * cc * cc) * A**4 / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * A**6 / 720)) + n0
    return east, north


def smallest_reaching(df: DataFrame, group: list[str], step: str, amount: str, target: Column) -> DataFrame:
    """(group, radius): the smallest step at which the running sum reaches the target, else the largest step.
    Amounts are summed by step first."""
    sums = df.groupBy(*group, step).agg(F.sum(amount).alias("amount"), F.max(target).alias("target"))
    w = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sums.withColumn("so_far", F.sum("amount").over(w))
    return reached.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("so_far") >= F.col("target"), F.col(step))), F.max(step)).alias("radius"))
