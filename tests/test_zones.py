"""Points in polygons by the sides of their squares, against the even-odd rule over all sides."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import zones

POLYGONS = f"zone string, rings {zones.RINGS}"


def even_odd(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def gap(x, y, rings):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            dx, dy = x2 - x1, y2 - y1
            along = min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            best = min(best, math.hypot(x - x1 - along * dx, y - y1 - along * dy))
    return best


def shapes(seed):
    """Rings with corners on whole and on broken numbers, which may cross themselves, with holes and level sides."""
    rng = random.Random(seed)
    out = []
    for k in range(6):
        whole = k % 2 == 0
        one = lambda: (float(rng.randrange(-8, 9)) if whole else rng.uniform(-8, 8))  # noqa: B023, E731
        out.append((f"z{k % 4}", [[(one(), one()) for _ in range(rng.choice([3, 4, 9]))] for _ in range(rng.choice([1, 2]))]))
    return [*out, out[0], ("square", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]]), ("none", []), (None, [[(0.0, 0.0), (1.0, 3.0), (3.0, 1.0)]])]


@pytest.mark.parametrize(("seed", "cell", "buffer"), [(1, 1.0, 0.0), (2, 0.7, 0.0), (3, 5.0, 0.0), (4, 40.0, 0.0), (5, 1.0, 0.4), (6, 2.5, 3.0)])
def test_points_in_polygons(spark, seed, cell, buffer):
    rng = random.Random(seed)
    places = [(float(i), float(j)) for i in range(-9, 10, 2) for j in range(-9, 10)] + [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(60)]
    polygons = shapes(seed)
    points = [(k, *p) for k, p in enumerate(places)] + [(-1, None, 1.0), (-2, math.nan, 1.0), (-3, 1.0, math.nan)]
    got = zones.located(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(polygons, POLYGONS), "x", "y", cell, buffer=buffer)
    want = [(k, z) for k, x, y in points[: len(places)] for z, rings in polygons if even_odd(x, y, rings) or (buffer and gap(x, y, rings) <= buffer)]
    assert sorted(((r["id"], r["zone"] or "") for r in got.collect())) == sorted((k, z or "") for k, z in want)


def test_a_polygon_of_many_sides(spark):
    n = 100_000
    angle = np.arange(n) * 2 * np.pi / n
    radius = 10 + np.sin(angle * 997) + 0.5 * np.sin(angle * 20011)
    ring = [(float(a), float(b)) for a, b in zip(radius * np.cos(angle), radius * np.sin(angle), strict=True)]
    polygons = spark.createDataFrame([("star", [ring])], POLYGONS)
    squares = zones._squares(polygons, "zone", 0.25, 0.0)
    assert squares.agg(F.max(F.size("sides__"))).first()[0] < n / 100
    rng = np.random.default_rng(3)
    xy = rng.uniform(-12, 12, (3000, 2))
    got = zones.located(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "id long, x double, y double"), polygons, "x", "y", 0.25)
    x1, y1 = np.array(ring).T
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    want = set()
    for k, (x, y) in enumerate(xy):
        spans = (y1 > y) != (y2 > y)
        if (x < (x2 - x1)[spans] * (y - y1[spans]) / (y2 - y1)[spans] + x1[spans]).sum() % 2:
            want.add(k)
    assert {r["id"] for r in got.collect()} == want


def test_empty_tables(spark):
    points, polygons = spark.createDataFrame([], "id long, x double, y double"), spark.createDataFrame([], POLYGONS)
    one = spark.createDataFrame([("a", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]])], POLYGONS)
    assert zones.located(points, one, "x", "y", 1.0).count() == 0
    assert zones.located(points.unionByName(spark.createDataFrame([(1, 0.1, 0.1)], points.schema)), polygons, "x", "y", 1.0).count() == 0
