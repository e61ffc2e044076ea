"""Polygons, shared boundaries, coverage, lines and unions against plain code on small random cases."""

import math
import random
from collections import Counter

import pytest

from tidemark.operators import linking, shapes, vector, zones


def random_cells(seed, n, letters="aaab"):
    rng = random.Random(seed)
    return {(r, c): rng.choice(letters) for r in range(n) for c in range(n) if rng.random() < 0.9}


def frame(spark, cells):
    return spark.createDataFrame([(r, c, z) for (r, c), z in cells.items()], "row long, col long, zone string")


def traced(cells):
    """(zone, corners from the smallest on, area) of every ring, walked side by side."""
    sides = {(r, c, k) for (r, c), z in cells.items() for k, (i, j) in enumerate(vector.OUT) if cells.get((r + i, c + j)) != z}
    while sides:
        r, c, k = first = min(sides)
        zone, walk = cells[r, c], []
        while (r, c, k) in sides:
            sides.remove((r, c, k))
            walk.append((r, c, k))
            (ar, ac), (i, j) = vector.AHEAD[k], vector.OUT[k]
            if cells.get((r + ar, c + ac)) != zone:
                k = (k + 1) % 4
            elif cells.get((r + ar + i, c + ac + j)) != zone:
                r, c = r + ar, c + ac
            else:
                r, c, k = r + ar + i, c + ac + j, (k + 3) % 4
        assert (r, c, k) == first
        points = [(r + vector.START[k][0], c + vector.START[k][1]) for r, c, k in walk]
        bends = [p for a, p, b in zip(points[-1:] + points, points, points[1:] + points[:1]) if (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1])]
        at = bends.index(min(bends))
        yield zone, tuple(bends[at:] + bends[:at]), sum(c + 1 if k == 1 else -c if k == 3 else 0 for r, c, k in walk)


def patches(cells):
    """How many cells hang together, by the first of them."""
    first = {}
    for cell in sorted(cells):
        todo = [cell] if cell not in first else []
        while todo:
            r, c = todo.pop()
            if (r, c) not in first:
                first[r, c] = cell
                todo += [(r + i, c + j) for i, j in vector.OUT if cells.get((r + i, c + j)) == cells[cell]]
    return Counter(first.values())


@pytest.mark.parametrize("seed,n,tile", [(1, 8, 4), (2, 15, 256)])
def test_polygons_equal_a_plain_tracer(spark, seed, n, tile):
    cells = random_cells(seed, n)
    found = vector.polygons(frame(spark, cells), tile=tile)
    walks, rings = {}, {(r.zone, r.polygon, r.ring): r for r in found.rings().collect()}
    for p in found.corners().collect():
        walks.setdefault((p.zone, p.polygon, p.ring), {})[p.place] = (p.row, p.col)
    got = Counter()
    for key, places in walks.items():
        points = [places[k] for k in range(len(places))]
        at = points.index(min(points))
        got[key[0], tuple(points[at:] + points[:at]), rings[key].cells] += 1
        assert rings[key].corners == len(points) and rings[key].hole == (rings[key].cells < 0)
    assert got == Counter(traced(cells))
    polygons = {(p.row, p.col): p for p in found.polygons().collect()}
    assert {k: p.cells for k, p in polygons.items()} == patches(cells)
    assert all(cells[k] == p.zone for k, p in polygons.items())


def test_shapes_of_a_ring_across_tiles(spark):
    """A frame around a hole, in which another cell lies, as arrays with the outline first."""
    cells = {(r, c): "a" for r in range(5) for c in range(5) if not (1 <= r <= 3 and 1 <= c <= 3) or (r, c) == (2, 2)}
    rows = vector.polygons(frame(spark, cells), tile=2).shapes(size=10.0, x0=100.0, y0=50.0).collect()
    rings = {len(r.rings): r.rings for r in rows}
    assert sorted((p.x, p.y) for p in rings[2][0]) == [(100.0, 0.0), (100.0, 50.0), (150.0, 0.0), (150.0, 50.0)]
    assert sorted((p.x, p.y) for p in rings[2][1]) == [(110.0, 10.0), (110.0, 40.0), (140.0, 10.0), (140.0, 40.0)]
    assert len(rings[1]) == 1


def test_no_cells(spark):
    empty = frame(spark, {(0, 0): "a"}).limit(0)
    assert vector.polygons(empty).rings().count() == 0 and vector.arcs(empty).count() == 0


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def meet_wrongly(one, two):
    """Whether two chords share more than an end."""
    (p, q), (u, w) = one, two
    if {p, q} == {u, w} or turn(p, q, u) * turn(p, q, w) < 0 and turn(u, w, p) * turn(u, w, q) < 0:
        return True
    within = lambda m, e, f: m not in (e, f) and turn(e, f, m) == 0 and min(e[0], f[0]) <= m[0] <= max(e[0], f[0]) and min(e[1], f[1]) <= m[1] <= max(e[1], f[1])
    return within(p, u, w) or within(q, u, w) or within(u, p, q) or within(w, p, q)


@pytest.mark.parametrize("seed,tile", [(4, 256), (5, 12)])
def test_simplified_neighbours_share_their_boundary(spark, seed, tile):
    rng = random.Random(seed)
    discs = [(rng.uniform(0, 22), rng.uniform(0, 22), rng.choice("abc")) for _ in range(6)]
    cells = {(r, c): min(discs, key=lambda d: math.hypot(r - d[0], c - d[1]))[2] for r in range(22) for c in range(22) if rng.random() < 0.97}
    found = vector.arcs(frame(spark, cells), (0.0, 1.0, 3.0), tile=tile).cache()
    areas = {(a.tolerance, a.zone): a for a in vector.areas(found).collect()}
    sizes = Counter(cells.values())
    for (tolerance, zone), a in areas.items():
        assert a.cells_before == sizes[zone] and (tolerance or a.cells_after == sizes[zone])
        assert a.error_pct == pytest.approx(100 * abs(a.cells_after - a.cells_before) / a.cells_before)
    rows = found.collect()
    for tolerance in (1.0, 3.0):
        chords = []
        for a in rows:
            if a.tolerance == tolerance:
                points = list(zip(a.rows, a.cols, strict=True))
                chords += list(zip(points, points[1:], strict=False))
        assert len(chords) < sum(len(a.rows) - 1 for a in rows if a.tolerance == 0)
        assert not any(meet_wrongly(x, y) for k, x in enumerate(chords) for y in chords[:k])
        # Each zone's chords, walked with the zone on the right, close: every corner is left as often as it is reached.
        for zone in sizes:
            ends = Counter()
            for a in rows:
                if a.tolerance == tolerance and zone in (a.zone, a.other):
                    sign = 1 if a.zone == zone else -1
                    ends[a.rows[0], a.cols[0]] += sign
                    ends[a.rows[-1], a.cols[-1]] -= sign
            assert not any(ends.values())
    worst = {t: max(a.error_pct for (s, _), a in areas.items() if s == t) for t in (0.0, 1.0, 3.0)}
    best = max(t for t in worst if worst[t] <= 5)
    assert {a.tolerance for a in vector.simplified(found, 5.0).select("tolerance").distinct().collect()} == {best}
    found.unpersist()


def clipped_area(rings, row, col):
    """The area of a polygon in a cell: each ring cut by four half planes, by the even-odd sign of its depth."""
    total = 0.0
    for k, ring in enumerate(rings):
        depth = sum(inside(ring[0], other) for j, other in enumerate(rings) if j != k)
        points = ring
        for axis, bound, sign in ((0, col, 1), (0, col + 1, -1), (1, row, 1), (1, row + 1, -1)):
            cut = []
            for p, q in zip(points, points[1:] + points[:1]):
                dp, dq = sign * (p[axis] - bound), sign * (q[axis] - bound)
                if dp >= 0:
                    cut.append(p)
                if dp * dq < 0:
                    t = dp / (dp - dq)
                    cut.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            points = cut
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1]))) / 2
        total += -area if depth % 2 else area
    return total


def inside(p, ring):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2


SHAPES = {
    "hole": [[(0.2, 0.3), (7.4, 0.9), (6.1, 5.7), (1.1, 6.2)], [(2.1, 2.2), (2.5, 4.4), (4.9, 3.1)]],
    "on lines": [[(1.0, 1.0), (1.0, 4.0), (3.0, 4.0), (3.0, 1.0)]],
    "diagonal": [[(0.0, 0.0), (4.0, 4.0), (0.0, 4.0)]],
    "below zero": [[(-2.5, -3.5), (-0.5, -3.0), (-1.0, 1.5)]],
    "tiny": [[(5.1, 5.1), (5.2, 5.1), (5.15, 5.2)]],
}


def polygons_of(spark):
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in SHAPES.items()]
    return spark.createDataFrame([*rows, ("nothing", [])], f"zone string, rings {zones.RINGS}")


def test_coverage_equals_clipping(spark):
    got = {(r.zone, r.row, r.col): r.fraction for r in shapes.coverage(polygons_of(spark), ["zone"]).collect()}
    for zone, rings in SHAPES.items():
        for row in range(-5, 9):
            for col in range(-5, 9):
                assert got.pop((zone, row, col), 0.0) == pytest.approx(clipped_area(rings, row, col), abs=1e-9), (zone, row, col)
    assert not got
    shares = {r.zone: r for r in shapes.share_in_box(polygons_of(spark), ["zone"], 0.0, 0.0, 4.0, 4.0).collect()}
    assert shares["on lines"].share == 1 and shares["diagonal"].share == pytest.approx(1) and shares["tiny"].share == 0
    assert shares["hole"].area == pytest.approx(sum(clipped_area(SHAPES["hole"], r, c) for r in range(9) for c in range(9)))


def test_coverage_tasks_follow_the_pieces(spark, monkeypatch):
    """More pieces make more tasks, so that none holds more as tables grow; the cells are the same."""
    rows = [(k, [[{"x": x + k % 9, "y": y + k % 7} for x, y in ((0.1, 0.2), (3.3, 0.2), (3.3, 2.7), (0.1, 2.7))]]) for k in range(300)]
    df = spark.createDataFrame(rows, f"k long, rings {zones.RINGS}")
    want = {tuple(r) for r in shapes.coverage(df, ["k"]).collect()}
    monkeypatch.setattr(shapes, "TASK", 400)
    monkeypatch.setattr(shapes, "POLYGONS", 100)
    found = shapes.coverage(df, ["k"])
    assert {tuple(r) for r in found.collect()} == want
    assert found.rdd.getNumPartitions() > 8


def meets(segment, row, col):
    """Whether a segment meets a half-open square: its part in the closed square is more than the far sides."""
    x1, y1, x2, y2 = segment
    t0, t1 = 0.0, 1.0
    for p, d, low in ((x1, x2 - x1, col), (y1, y2 - y1, row)):
        if d == 0:
            if not low <= p < low + 1:
                return False
        else:
            a, b = sorted(((low - p) / d, (low + 1 - p) / d))
            t0, t1 = max(t0, a), min(t1, b)
    if t0 > t1:
        return False
    places = [(x1 + t * (x2 - x1), y1 + t * (y2 - y1)) for t in (t0, (t0 + t1) / 2, t1)]
    return any(col <= round(x, 9) < col + 1 and row <= round(y, 9) < row + 1 for x, y in places)


def test_touched_cells_equal_intersection(spark):
    rng = random.Random(8)
    segments = [(0.5, 0.5, 3.5, 0.5), (0.5, 0.5, 1.0, 0.5), (1.0, 0.2, 1.0, 3.7), (0.0, 0.0, 3.0, 3.0), (2.5, 2.5, 2.5, 2.5), (3.0, 1.0, 1.0, 1.0), (-1.5, 2.2, 0.4, -1.1)]
    segments += [tuple(rng.uniform(-4, 6) for _ in range(4)) for _ in range(40)]
    lines = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(segments)], "k int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.k, r.row, r.col) for r in shapes.touched_cells(lines, ["k"]).collect()}
    assert got == {(k, r, c) for k, s in enumerate(segments) for r in range(-5, 8) for c in range(-5, 8) if meets(s, r, c)}


def test_dissolved_squares_keep_the_outline(spark):
    """The union of unit squares has the same rings as the polygons of the cells."""
    cells = random_cells(9, 4, "aab")
    square = lambda r, c: [[{"x": float(c + i), "y": float(r + j)} for i, j in ((0, 0), (0, 1), (1, 1), (1, 0))]]
    squares = spark.createDataFrame([(z, square(r, c)) for (r, c), z in cells.items()], f"zone string, rings {zones.RINGS}")
    areas = shapes.ring_areas(shapes.dissolved(squares, ["zone"]), ["zone"]).collect()
    assert Counter((r.zone, r.area) for r in areas) == Counter((z, float(a)) for z, _, a in traced(cells))


def test_buffers(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 5.0, float("nan")), (4, -7.5, 2.0)], "k int, x double, y double")
    points = spark.createDataFrame([(k, x / 2, y / 2) for k, (x, y) in enumerate((x, y) for x in range(-20, 9) for y in range(-5, 9))], "k int, x double, y double")
    good, faults = shapes.buffers(sites, "x", "y")
    assert {r.k for r in faults.collect()} == {2, 3} and {r.k for r in good.collect()} == {1, 4}
    got = [r.k for r in shapes.within_buffers(points, sites, "x", "y", 1.5).collect()]
    assert sorted(got) == sorted(p.k for p in points.collect() if min(math.hypot(p.x, p.y), math.hypot(p.x + 7.5, p.y - 2)) <= 1.5)


def test_linking(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30, 38)] + [(38, 4), (7, 9), (5, 5)], "a long, b long")
    assert {r.local: r.label for r in linking.smallest_linked(links).collect()} == {**{k: 4 for k in [4, *range(30, 39)]}, 7: 7, 9: 7}
    ring = [13, 2, 8, 21, 5, 34, 1]
    parts = spark.createDataFrame([(a, b, a) for a, b in zip(ring, ring[1:] + ring[:1])] + [(100, 100, 3)], "head long, next long, n long")
    assert {r.head: (r.ring, r.at) for r in linking.ring_order(parts).collect()} == {100: (100, 0), 1: (1, 0), 13: (1, 1), 2: (1, 14), 8: (1, 16), 21: (1, 24), 5: (1, 45), 34: (1, 50)}
