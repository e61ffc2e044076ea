"""From zones of cells to polygons (K4, K13, J27) and to shared, simplified boundaries.

Cells are rows (row, col, zone), rows and columns from 0 to 2**29; cells that aren't there lie outside every zone. A cell at
(row, col) is the square with corners (row, col) and (row + 1, col + 1). Tiles of cells, each with the next cells around it, are
worked on in one grouped pass; what crosses tiles is put together from a few numbers a tile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.checkpoints import checkpoint_dir
from tidemark.operators.grid import linked
from tidemark.operators.linking import ring_order, smallest_linked

TILE = 256
STRIDE = 1 << 29
#: Sides of a cell in the order in which a walk around it meets them, the cell on the right hand: top, right, bottom, left.
AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
OUT = ((-1, 0), (0, 1), (1, 0), (0, -1))
START = ((0, 0), (0, 1), (1, 1), (1, 0))


def with_halo(cells: DataFrame, zone: str, tile: int) -> DataFrame:
    """(tile_row, tile_col, row, col, zone): each cell in its tile and in those that it touches."""
    near = [F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile)) for c in ("row", "col")]
    own = cells.where(F.col(zone).isNotNull()).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col(zone).alias("zone"))
    return own.select(F.explode(near[0]).alias("tile_row"), "row", "col", "zone").select("tile_row", F.explode(near[1]).alias("tile_col"), "row", "col", "zone")


def _dense(pdf: pd.DataFrame, tile: int) -> tuple[np.ndarray, pd.Index, int, int]:
    """Zone numbers of the tile with a frame of one cell, -1 outside; numbers ascend with the zones."""
    top, left = int(pdf["tile_row"].iloc[0]) * tile, int(pdf["tile_col"].iloc[0]) * tile
    codes, zones = pd.factorize(pdf["zone"], sort=True)
    out = np.full((tile + 2, tile + 2), -1)
    out[pdf["row"].to_numpy() - top + 1, pdf["col"].to_numpy() - left + 1] = codes
    return out, zones, top, left


def chained(succ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of items that each have one successor or none (-1): the first item of each item's chain, its place there, and
    which chains' first items begin a ring; these are its smallest."""
    n = len(succ)
    has, every = succ >= 0, np.arange(n)
    pred = every.copy()
    pred[succ[has]] = every[has]
    heads = pred == every
    heads[succ[has]] = False
    back, low = pred.copy(), every.copy()
    for _ in range(max(1, n).bit_length()):
        low = np.minimum(low, low[back])
        back = back[back]
    rings = ~heads[back] & (low == every)
    pred[rings] = every[rings]
    back, place = pred, (pred != every).astype(np.int64)
    while (back[back] != back).any():
        place, back = place + place[back], back[back]
    return back, place, rings


def _number(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return row * STRIDE + col


def _trace(pdf: pd.DataFrame, tile: int) -> list[dict]:
    """Of one tile: its parts of rings, the labels of cells at its edge, and which cells beyond are of the same zone."""
    z, zones, top, left = _dense(pdf, tile)
    core = z[1:-1, 1:-1]

    def at(step: tuple[int, int]) -> np.ndarray:
        return z[1 + step[0] : 1 + step[0] + tile, 1 + step[1] : 1 + step[1] + tile]

    row, col, side, succ_row, succ_col, succ_side, corner = ([] for _ in range(7))
    for s in range(4):
        (ar, ac), (orow, oc) = AHEAD[s], OUT[s]
        r, c = np.nonzero((core >= 0) & (at(OUT[s]) != core))
        own = core[r, c]
        ahead, beyond = at((ar, ac))[r, c] == own, at((ar + orow, ac + oc))[r, c] == own
        behind, behind_out = at((-ar, -ac))[r, c] == own, at((orow - ar, oc - ac))[r, c] == own
        left_turn = ahead & beyond
        row.append(r), col.append(c), side.append(np.full(len(r), s))
        succ_row.append(r + np.where(ahead, ar, 0) + np.where(left_turn, orow, 0))
        succ_col.append(c + np.where(ahead, ac, 0) + np.where(left_turn, oc, 0))
        succ_side.append(np.where(left_turn, s + 3, np.where(ahead, s, s + 1)) % 4)
        corner.append(~(behind & ~behind_out))
    row, col, side, succ_row, succ_col, succ_side, corner = map(np.concatenate, (row, col, side, succ_row, succ_col, succ_side, corner))
    out = []
    # Cells of a zone that touch within the tile.
    r, c = np.nonzero(core >= 0)
    index = np.full((tile + 2, tile + 2), -1)
    index[r + 1, c + 1] = np.arange(len(r))
    pairs = [(index[1:-1, 1:-1], index[1:-1, 2:], z[1:-1, 2:]), (index[1:-1, 1:-1], index[2:, 1:-1], z[2:, 1:-1])]
    a, b = (np.concatenate(x) for x in zip(*[(i[m], j[m]) for i, j, other in pairs for m in [(i >= 0) & (j >= 0) & (other == core)]], strict=True))
    label = linked(a, b, len(r))
    cell = _number(r + top, c + left)
    label = cell[label]
    for step, edge in ((OUT[s], [r == 0, c == tile - 1, r == tile - 1, c == 0][s]) for s in range(4)):
        same = edge & (at(step)[r, c] == core[r, c])
        out += [{"kind": 2, "label": x, "cell": y} for x, y in zip(label[same].tolist(), _number(r[same] + top + step[0], c[same] + left + step[1]).tolist(), strict=True)]
    edges = (r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1)
    out += [{"kind": 1, "label": x, "cell": y} for x, y in zip(label[edges].tolist(), cell[edges].tolist(), strict=True)]
    if not len(row):
        return out
    place = np.full((4, tile + 2, tile + 2), -1)
    place[side, row + 1, col + 1] = np.arange(len(row))
    succ = place[succ_side, succ_row + 1, succ_col + 1]
    head, number, rings = chained(succ)
    order = np.lexsort((number, head))
    firsts = np.flatnonzero(number[order] == 0)
    name = _number(row + top, col + left) * 4 + side
    then = _number(succ_row + top, succ_col + left) * 4 + succ_side
    starts = np.array(START)[side]
    corner_row, corner_col = row + top + starts[:, 0], col + left + starts[:, 1]
    turned = np.where(side == 1, col + left + 1, np.where(side == 3, -(col + left), 0))
    cell_label = np.zeros((tile, tile), np.int64)
    cell_label[r, c] = label
    for x, y in zip(firsts, [*firsts[1:], len(order)], strict=True):
        own = order[x:y]
        k, bent = own[0], own[corner[own]]
        out.append({
            "kind": 0, "zone": zones[core[row[k], col[k]]], "label": int(cell_label[row[k], col[k]]), "head": int(name[k]), "next": int(name[k] if rings[k] else then[own[-1]]),
            "rows": corner_row[bent].tolist(), "cols": corner_col[bent].tolist(), "n_corners": len(bent), "area": int(turned[own].sum()), "sides": len(own),
        })
    return out


@dataclass
class Vectors:
    """parts: (zone, polygon, ring, at, rows, cols, n_corners, area, sides): pieces of rings with their corners in order, `at`
    being the number of corners before; no piece is longer than a tile's sides."""

    parts: DataFrame

    def rings(self) -> DataFrame:
        """(zone, polygon, ring, cells, corners, sides, hole): the signed area in cells; holes have a negative one."""
        sums = self.parts.groupBy("zone", "polygon", "ring").agg(F.sum("area").alias("cells"), F.sum("n_corners").alias("corners"), F.sum("sides").alias("sides"))
        return sums.withColumn("hole", F.col("cells") < 0)

    def corners(self) -> DataFrame:
        """(zone, polygon, ring, place, row, col): a row for each corner, in the order of a walk with the zone on the right."""
        zipped = self.parts.select("zone", "polygon", "ring", "at", F.posexplode(F.arrays_zip("rows", "cols")).alias("k", "c"))
        return zipped.select("zone", "polygon", "ring", (F.col("at") + F.col("k")).alias("place"), F.col("c.rows").alias("row"), F.col("c.cols").alias("col"))

    def polygons(self) -> DataFrame:
        """(zone, polygon, row, col, cells, n_holes, corners, sides): a row for each polygon; (row, col) is its first cell,
        which surely lies inside, where centroids may not (J27)."""
        sums = self.rings().groupBy("zone", "polygon").agg(F.sum("cells").alias("cells"), F.count_if("hole").alias("n_holes"), F.sum("corners").alias("corners"), F.sum("sides").alias("sides"))
        return sums.select("zone", "polygon", F.expr(f"polygon div {STRIDE}").alias("row"), (F.col("polygon") % STRIDE).alias("col"), "cells", "n_holes", "corners", "sides")

    def sampled(self, attributes: DataFrame) -> DataFrame:
        """The polygons with the attributes (row, col, ...) of their first cells (J27, K13); null where there are none."""
        return self.polygons().join(attributes, ["row", "col"], "left")

    def shapes(self, size: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
        """(zone, polygon, rings) with each polygon as one row of arrays of struct(x, y), for export; y falls with the row, as
        north is up. A polygon must fit into a row here; `corners` has no such bound."""
        point = F.transform(F.arrays_zip("rows", "cols"), lambda c: F.struct((c["cols"] * size + x0).alias("x"), (F.lit(y0) - c["rows"] * size).alias("y")))
        parts = self.parts.select("zone", "polygon", "ring", "at", point.alias("points"), "area")
        rings = parts.groupBy("zone", "polygon", "ring").agg(F.array_sort(F.collect_list(F.struct("at", "points"))).alias("parts"), (F.sum("area") < 0).alias("hole"))
        rings = rings.select("zone", "polygon", "ring", "hole", F.flatten(F.transform("parts", lambda p: p["points"])).alias("points"))
        return rings.groupBy("zone", "polygon").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "points"))), lambda r: r["points"]).alias("rings"))


def polygons(cells: DataFrame, zone: str = "zone", tile: int = TILE) -> Vectors:
    """Polygons of the 4-connected cells of each zone (K4). Each side of a cell towards another zone is a step of a walk with the
    zone on the right hand, and the cells around its end tell the next one. Tiles chain their steps; parts that cross tiles
    are put in order by doubling. A hole belongs to the polygon of the cells along it."""
    checkpoint_dir(cells.sparkSession)
    kind = cells.schema[zone].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("zone", kind), *[T.StructField(c, T.LongType()) for c in ("label", "cell", "head", "next", "n_corners", "area", "sides")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("rows", "cols")]])

    types = to_arrow_schema(schema)

    def trace(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_trace(table.to_pandas(), tile), types)

    found = with_halo(cells, zone, tile).groupBy("tile_row", "tile_col").applyInArrow(trace, schema).checkpoint()
    border = found.where("kind = 1").select("cell", F.col("label").alias("b"))
    labels = smallest_linked(found.where("kind = 2").select("cell", F.col("label").alias("a")).join(border, "cell").select("a", "b"))
    parts = found.where("kind = 0").drop("kind", "cell")
    whole, broken = parts.where("head = next"), parts.where("head <> next")
    order = whole.select("head", F.col("head").alias("ring"), F.lit(0).cast("long").alias("at"))
    if not broken.isEmpty():
        order = order.unionByName(ring_order(broken.select("head", "next", F.col("n_corners").alias("n"))))
    named = parts.join(labels.select(F.col("local").alias("label"), F.col("label").alias("first")), "label", "left").join(order, "head")
    return Vectors(named.select("zone", F.coalesce("first", "label").alias("polygon"), "ring", "at", "rows", "cols", "n_corners", "area", "sides"))


def _shortcuts(points: np.ndarray, tolerance: float, taken: np.ndarray, own: np.ndarray, top: int, left: int, tile: int) -> list[int]:
    """Which vertices of an arc stay. A run of vertices gives way to its chord if none is farther from it than the tolerance and
    no vertex of a boundary lies in what the run and the chord enclose, nor on the chord: so arcs never come to cross."""
    stays, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, run = points[a], points[b], points[a : b + 1]
        along = q - p
        length = float(np.hypot(*along))
        off = np.abs((run - p) @ np.array([along[1], -along[0]])) / length if length else np.hypot(*(run - p).T)
        far = int(off[1:-1].argmax()) + 1
        straight = length > 0 and off[far] == 0 and ((run[1:] - run[:-1]) @ along > 0).all()
        fits = straight or (length > 1 and off[far] <= tolerance and not _along_edge(p, q, top, left, tile) and not _encloses(run, taken, own, top, left))
        if not fits:
            stays.add(a + far)
            todo += [(a, a + far), (a + far, b)]
    return sorted(stays)


def _along_edge(p: np.ndarray, q: np.ndarray, top: int, left: int, tile: int) -> bool:
    """A chord on the tile's outline could meet one of the next tile."""
    return bool((p[0] == q[0] and p[0] in (top, top + tile)) or (p[1] == q[1] and p[1] in (left, left + tile)))


def _encloses(run: np.ndarray, taken: np.ndarray, own: np.ndarray, top: int, left: int) -> bool:
    """Whether a vertex of another boundary, or of another part of this one, lies in or on the ring of run and chord. own: numbers of
    the vertices along the arc, in taken's numbering."""
    low, high = run.min(0), run.max(0)
    r, c = np.nonzero(taken[low[0] - top : high[0] - top + 1, low[1] - left : high[1] - left + 1])
    r, c = r + low[0], c + low[1]
    width = taken.shape[1]
    foreign = ~np.isin((r - top) * width + (c - left), own)
    r, c = r[foreign], c[foreign]
    if not len(r):
        return False
    inside, on = np.zeros(len(r), bool), np.zeros(len(r), bool)
    for (r1, c1), (r2, c2) in zip(run, np.roll(run, -1, 0), strict=True):
        cross = (c2 - c1) * (r - r1) - (r2 - r1) * (c - c1)
        between = (np.minimum(r1, r2) <= r) & (r <= np.maximum(r1, r2)) & (np.minimum(c1, c2) <= c) & (c <= np.maximum(c1, c2))
        on |= (cross == 0) & between
        spans = (r1 > r) != (r2 > r)
        if r1 != r2:
            inside ^= spans & (c < (c2 - c1) * (r - r1) / (r2 - r1) + c1)
    return bool((inside | on).any())


def _unit_numbers(run: np.ndarray, top: int, left: int, width: int) -> np.ndarray:
    """Numbers of all grid vertices along a run of corners."""
    steps = np.abs(np.diff(run, axis=0)).sum(1)
    signs = np.sign(np.diff(run, axis=0))
    walked = np.repeat(run[:-1], steps, 0) + np.repeat(signs, steps, 0) * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))[:, None]
    walked = np.vstack((walked, run[-1:]))
    return (walked[:, 0] - top) * width + (walked[:, 1] - left)


def _arcs(pdf: pd.DataFrame, tile: int, tolerances: tuple[float, ...]) -> list[dict]:
    """The arcs of one tile at each tolerance."""
    z, zones, top, left = _dense(pdf, tile)
    # Side k of vertex (i, j): vertical sides go down from it, horizontal sides to the right of it.
    down, right = z[1:, 1:] != z[1:, :-1], z[1:, 1:] != z[:-1, 1:]
    v, h = down[:tile, :tile], right[:tile, :tile]
    degree = np.zeros((tile + 1, tile + 1), int)
    up = z[:-1, 1:] != z[:-1, :-1]
    west = z[1:, :-1] != z[:-1, :-1]
    degree += up[: tile + 1, : tile + 1].astype(int) + down[: tile + 1, : tile + 1] + west[: tile + 1, : tile + 1] + right[: tile + 1, : tile + 1]
    mine = np.zeros_like(degree)
    mine[:tile, :tile] += v.astype(int) + h
    mine[1:, :tile] += v
    mine[:tile, 1:] += h
    nodes = (degree != 2) | (mine != 2)
    # Each side is walked with the smaller zone on the right hand.
    vr, vc = np.nonzero(v)
    hr, hc = np.nonzero(h)
    west_zone, east_zone = z[vr + 1, vc], z[vr + 1, vc + 1]
    north_zone, south_zone = z[hr, hc + 1], z[hr + 1, hc + 1]
    goes_down, goes_right = west_zone < east_zone, south_zone < north_zone
    start = np.concatenate((np.stack((vr + ~goes_down, vc), 1), np.stack((hr, hc + ~goes_right), 1)))
    end = np.concatenate((np.stack((vr + goes_down, vc), 1), np.stack((hr, hc + goes_right), 1)))
    if not len(start):
        return []
    small = np.concatenate((np.minimum(west_zone, east_zone), np.minimum(north_zone, south_zone)))
    large = np.concatenate((np.maximum(west_zone, east_zone), np.maximum(north_zone, south_zone)))
    begins = np.full((tile + 1, tile + 1), -1)
    free = ~nodes[start[:, 0], start[:, 1]]
    begins[start[free, 0], start[free, 1]] = np.flatnonzero(free)
    succ = np.where(nodes[end[:, 0], end[:, 1]], -1, begins[end[:, 0], end[:, 1]])
    head, number, rings = chained(succ)
    order = np.lexsort((number, head))
    firsts = np.flatnonzero(number[order] == 0)
    taken = degree > 0
    arcs = []
    for x, y in zip(firsts, [*firsts[1:], len(order)], strict=True):
        own = order[x:y]
        walk = np.vstack((start[own], end[own[-1:]])) + (top, left)
        step = np.diff(walk, axis=0)
        bent = np.concatenate(([True], (step[1:] != step[:-1]).any(1), [True]))
        arcs.append((own[0], walk[bent], len(own), bool(rings[own[0]])))
    out = []
    for tolerance in tolerances:
        kept = []
        for _, points, _, closed in arcs:
            if not tolerance:
                kept.append(points)
                continue
            units = _unit_numbers(points, top, left, tile + 1)
            if closed:  # two runs: to the farthest corner and back
                middle = int(((points - points[0]) ** 2).sum(1).argmax())
                one = _shortcuts(points[: middle + 1], tolerance, taken, _unit_numbers(points[: middle + 1], top, left, tile + 1), top, left, tile)
                two = _shortcuts(points[middle:], tolerance, taken, _unit_numbers(points[middle:], top, left, tile + 1), top, left, tile)
                kept.append(points[[*one, *[middle + k for k in two[1:]]]])
            else:
                kept.append(points[_shortcuts(points, tolerance, taken, units, top, left, tile)])
        # Two arcs, or the two halves of one, may have taken the same chord: these stay as they were.
        while True:
            uses: dict[tuple, set[int]] = {}
            for k, points in enumerate(kept):
                for p, q in zip(points[:-1].tolist(), points[1:].tolist(), strict=True):
                    uses.setdefault((min(tuple(p), tuple(q)), max(tuple(p), tuple(q))), set()).add(k)
            counts = [sum(len(x) - 1 for x in kept), len(uses)]
            if counts[0] == counts[1]:
                break
            seen: set[tuple] = set()
            back = {k for ks in uses.values() if len(ks) > 1 for k in ks}
            for k, points in enumerate(kept):
                for p, q in zip(points[:-1].tolist(), points[1:].tolist(), strict=True):
                    side = (k, min(tuple(p), tuple(q)), max(tuple(p), tuple(q)))
                    if side in seen:
                        back.add(k)
                    seen.add(side)
            for k in back:
                kept[k] = arcs[k][1]
        for (k, points, n, closed), less in zip(arcs, kept, strict=True):
            twice = [int(((p[:-1, 1] + p[1:, 1]) * np.diff(p[:, 0])).sum()) for p in (points, less)]
            name = int(_number(start[k, 0] + top, start[k, 1] + left)) * 4 + int(k < len(vr)) * 2 + int((start[k] < end[k]).any())
            out.append({
                "arc": name, "zone": zones[small[k]] if small[k] >= 0 else None, "other": zones[large[k]], "closed": closed, "tolerance": tolerance, "length": n, "n_before": len(points), "n_after": len(less),
                "twice_before": twice[0], "twice_after": twice[1], "rows": less[:, 0].tolist(), "cols": less[:, 1].tolist(),
            })
    return out


def arcs(cells: DataFrame, tolerances: tuple[float, ...] = (0.0,), zone: str = "zone", tile: int = TILE) -> DataFrame:
    """Every boundary between two zones, or a zone and the outside (null), once, at each tolerance in cells.

    Boundaries are split where three zones meet or where they go from tile to tile; these vertices stay. An arc has the smaller
    zone on its right (`zone`) and is shared by both sides, so neighbours neither part nor overlap, whatever the tolerance. An
    arc lies within its tile, which is convex, so arcs of different tiles can't cross; within a tile no chord may pass a vertex.
    twice_before and twice_after: twice the sum of col x step in row, which the zone gains and the other loses."""
    kind = cells.schema[zone].dataType
    schema = T.StructType([T.StructField("arc", T.LongType()), T.StructField("zone", kind), T.StructField("other", kind), T.StructField("closed", T.BooleanType()), T.StructField("tolerance", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("length", "n_before", "n_after", "twice_before", "twice_after")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("rows", "cols")]])
    steps = tuple(float(t) for t in tolerances)

    types = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_arcs(table.to_pandas(), tile, steps), types)

    return with_halo(cells, zone, tile).groupBy("tile_row", "tile_col").applyInArrow(run, schema)


def areas(found: DataFrame) -> DataFrame:
    """(tolerance, zone, cells_before, cells_after, error_pct) from arcs: area of each zone before and after."""
    gains = found.select("tolerance", "zone", "twice_before", "twice_after")
    loses = found.select("tolerance", F.col("other").alias("zone"), (-F.col("twice_before")).alias("twice_before"), (-F.col("twice_after")).alias("twice_after"))
    sums = gains.unionByName(loses).where(F.col("zone").isNotNull()).groupBy("tolerance", "zone").agg((F.sum("twice_before") / 2).alias("cells_before"), (F.sum("twice_after") / 2).alias("cells_after"))
    return sums.withColumn("error_pct", F.try_divide(F.abs(F.col("cells_after") - F.col("cells_before")), F.col("cells_before")) * 100)


def simplified(found: DataFrame, most_pct: float) -> DataFrame:
    """The arcs at the largest tolerance at which no zone's area differs by more than `most_pct` percent; null errors don't count.
    Shared arcs have one tolerance, so it is one for all zones. found: arcs at several tolerances, 0 among them."""
    worst = areas(found).groupBy("tolerance").agg(F.max("error_pct").alias("worst"))
    best = worst.where(F.coalesce("worst", F.lit(0.0)) <= most_pct).agg(F.max("tolerance").alias("best"))
    return found.join(F.broadcast(best), F.col("tolerance") == F.col("best")).drop("best")  # one row
