"""Cells of a grid as rows (row, col): overlays, blocks, neighbourhoods, components.

A mask holds one row for each true cell. Neighbourhoods spread a cell to its offsets and count, which needs one shuffle and
no dense array."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import checkpoint_dir
from tidemark.operators.linking import smallest_linked

SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
#: Rows of a block in which nearest sources are looked up, at most, and its cells, about.
BLOCK_ROWS, BLOCK_CELLS = 256, 1 << 18


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets within a radius, without the centre."""
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]


def spread(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(row, col) of every offset of every cell, as often as cells reach it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    return mask.select("row", "col", F.explode(steps).alias("s")).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))


def inside(height: int, width: int) -> Column:
    return F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)


def neighbours(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(row, col, n): how many true cells lie at the offsets of a cell; cells without any are left out."""
    return spread(mask, [(-i, -j) for i, j in offsets]).groupBy("row", "col").agg(F.count("*").alias("n"))


def density(mask: DataFrame, radius: int) -> DataFrame:
    offsets = disc(radius)
    return neighbours(mask, offsets).select("row", "col", (F.col("n") / len(offsets)).alias("density"))


def growth_type(before: DataFrame, after: DataFrame, radius: int, infill: float = 0.5) -> DataFrame:
    """New cells as infill (density at least `infill`), edge, or leapfrog (no old cell near)."""
    new = after.select("row", "col").join(before.select("row", "col"), ["row", "col"], "left_anti")
    d = new.join(density(before, radius), ["row", "col"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    return d.withColumn("type", F.when(F.col("density") >= infill, "infill").when(F.col("density") == 0, "leapfrog").otherwise("edge"))


def majority(mask: DataFrame, height: int, width: int, needed: int = 5) -> DataFrame:
    """Cells of whose 3 x 3 square `needed` are true, the grid's edge repeated outwards (G3); true cells outside the grid don't count."""
    rows = F.concat(F.array(F.col("row")), F.when(F.col("row") == 0, F.array(F.col("row") - 1)).otherwise(F.array().cast("array<bigint>")), F.when(F.col("row") == height - 1, F.array(F.col("row") + 1)).otherwise(F.array().cast("array<bigint>")))
    cols = F.concat(F.array(F.col("col")), F.when(F.col("col") == 0, F.array(F.col("col") - 1)).otherwise(F.array().cast("array<bigint>")), F.when(F.col("col") == width - 1, F.array(F.col("col") + 1)).otherwise(F.array().cast("array<bigint>")))
    padded = mask.select(F.col("row").cast("long"), F.col("col").cast("long")).where(inside(height, width)).select(F.explode(rows).alias("row"), "col").select("row", F.explode(cols).alias("col"))
    return neighbours(padded, SQUARE).where((F.col("n") >= needed) & inside(height, width)).select("row", "col")


def eroded(mask: DataFrame) -> DataFrame:
    """Cells whose 3 x 3 square is true; outside is false."""
    return neighbours(mask, SQUARE).where(F.col("n") == 9).select("row", "col")


def dilated(mask: DataFrame, reach: int = 1, height: int | None = None, width: int | None = None) -> DataFrame:
    """Cells within a square of a true cell, by rows and then by columns."""
    side = range(-reach, reach + 1)
    out = spread(spread(mask, [(i, 0) for i in side]).distinct(), [(0, j) for j in side]).distinct()
    return out.where(inside(height, width)) if height is not None and width is not None else out


def closed(mask: DataFrame, domain: DataFrame) -> DataFrame:
    """Dilation, then erosion, within a domain."""
    return eroded(dilated(mask)).join(domain.select("row", "col"), ["row", "col"], "left_semi")


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """(both, only_a, only_b) of two masks, in one pass over both."""
    sides = a.select("row", "col", F.lit(1).alias("side")).unionByName(b.select("row", "col", F.lit(2).alias("side")))
    cells = sides.groupBy("row", "col").agg(F.bit_or("side").alias("in"))
    return cells.agg(F.count_if(F.col("in") == 3).alias("both"), F.count_if(F.col("in") == 1).alias("only_a"), F.count_if(F.col("in") == 2).alias("only_b"))


def blocks(df: DataFrame, factor: int, value: str) -> DataFrame:
    """(block_row, block_col, total, n) of factor x factor blocks, part blocks at the edge included (A5)."""
    return df.groupBy(F.floor(F.col("row") / factor).alias("block_row"), F.floor(F.col("col") / factor).alias("block_col")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def block_fractions(df: DataFrame, factor: int, value: str) -> DataFrame:
    """`fraction` of each block; 0 for blocks that aren't complete."""
    full = factor * factor
    return blocks(df, factor, value).withColumn("fraction", F.when(F.col("n") == full, F.col("total") / full).otherwise(F.lit(0.0)))


def linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n numbers is linked with, by links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def components(mask: DataFrame, offsets: list[tuple[int, int]] = SQUARE, width: int | None = None, tile: int = 256) -> DataFrame:
    """(row, col, component): the smallest cell number of the connected cells, row * width + col; without a width, that of the
    extent, columns counted from the smallest. Tiles are labelled on their own, in one grouped pass; then only the links between
    tiles are followed, by labels that spread and jump, so the steps grow with the logarithm of the tiles crossed; each step is
    a checkpoint. Offsets reach the next cell at most."""
    checkpoint_dir(mask.sparkSession)
    first = 0
    cells = mask.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    if width is None:
        low, high = cells.agg(F.min("col"), F.max("col")).first()
        first, width = (low or 0), (high or 0) - (low or 0) + 1

    def inside_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        place = (row - row.min()) * (tile + 2) + col - (col.min() - 1)
        a, b = [], []
        for i, j in offsets:
            other = place + i * (tile + 2) + j
            at = np.minimum(np.searchsorted(place, other), len(place) - 1)
            hit = np.flatnonzero(place[at] == other)
            a.append(hit), b.append(at[hit])
        label = linked(np.concatenate(a), np.concatenate(b), len(place))
        number = row * width + col - first
        return pd.DataFrame({"row": row, "col": col, "local": number[label]})

    dealt = cells.groupBy(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))
    local = dealt.applyInPandas(inside_tiles, "row long, col long, local long").checkpoint()
    edge = F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1)
    border = local.where(edge)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    reached = border.select(F.col("local").alias("a"), F.explode(steps).alias("s"), "row", "col").select("a", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    links = reached.join(border.withColumnRenamed("local", "b"), ["row", "col"]).where(F.col("a") != F.col("b")).select("a", "b").distinct()
    labels = smallest_linked(links)
    return local.join(labels, "local", "left").select("row", "col", F.coalesce("label", "local").alias("component"))


def patch_metrics(labelled: DataFrame, size_m: float, height: int, width: int) -> DataFrame:
    """One row: patches, mean area (ha), largest patch (% of the landscape), edge density (m a ha of the landscape) and mean shape
    index, from the components of a mask in a grid of height x width cells (A36, A37). The landscape's outer boundary is no
    edge, though it counts in the perimeters of the shape index."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in CROSS])
    reached = labelled.select("component", F.explode(steps).alias("s"), "row", "col").select("component", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    open_edges = reached.join(labelled.select("row", "col"), ["row", "col"], "left_anti").groupBy("component").agg(F.count("*").alias("edges"), F.count_if(inside(height, width)).alias("inner"))
    patches = labelled.groupBy("component").agg(F.count("*").alias("cells")).join(open_edges, "component", "left").na.fill(0)
    area, edge = F.col("cells") * (size_m * size_m), F.col("edges") * size_m
    landscape = height * width * size_m * size_m
    return patches.agg(F.count("*").alias("patches"), (F.avg(area) / 1e4).alias("mean_area_ha"), F.median(area / 1e4).alias("median_area_ha"), (100 * F.max(area) / landscape).alias("largest_patch_pct"), (F.sum(F.col("inner")) * size_m / (landscape / 1e4)).alias("edge_density"), F.avg(edge / (4 * F.sqrt(area))).alias("mean_shape"))


def distance(cells: DataFrame, mask: DataFrame, size_m: float) -> DataFrame:
    """The cells with `distance_m` to the nearest cell of the mask, however far; null without any."""
    near = nearest_value(cells, mask.withColumn("v__", F.lit(0)), "v__").select("row", "col", (F.sqrt("d2") * size_m).alias("distance_m"))
    return cells.join(near, ["row", "col"], "left")


def rings(cells: DataFrame, mask: DataFrame, size_m: float, bounds_m: tuple[float, ...] = (1000.0, 3000.0)) -> DataFrame:
    """`distance_m` and `ring`: 0 in the mask, then 1, 2 ... by the distance to it, upper bounds included."""
    ring = F.when(F.col("distance_m") == 0, 0)
    for k, bound in enumerate(bounds_m):
        ring = ring.when(F.col("distance_m") <= bound, k + 1)
    return distance(cells, mask, size_m).withColumn("ring", ring.otherwise(len(bounds_m) + 1))


def composite(scenes: DataFrame, bands: list[str]) -> DataFrame:
    """The median of each band and its number of valid observations by cell (A1, A2); null bands don't count."""
    return scenes.groupBy("row", "col").agg(*[F.median(b).alias(b) for b in bands], *[F.count(b).alias(f"n_{b}") for b in bands])


def nearest_value(cells: DataFrame, sources: DataFrame, value: str) -> DataFrame:
    """(row, col, value, d2) of the nearest source cell, however far; ties go to the smaller row, then column (G8). Rows go in blocks.
    A block gets its own sources and, of each column with a source, the last one above and the first one below it, which windows over
    the blocks of a column find. In a block the nearest source of each column is looked up for each row, then the lower envelope of one
    parabola a column gives the nearest of all: so the work grows with the rows of cells times the columns of sources, and a task
    holds one block at a time. Without any source there are no rows."""
    own = cells.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    known = sources.groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.min(value).alias("v"))
    width = own.select("col").unionByName(known.select("col")).agg(F.approx_count_distinct("col")).first()[0]
    height = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, width)))
    block = F.expr(f"(row - pmod(row, {height}L)) div {height}L")
    own, inner = own.withColumn("block", block), known.withColumn("block", block)
    source = F.struct("row", "v")
    ends = inner.groupBy("block", "col").agg(F.min(source).alias("first"), F.max(source).alias("last")).withColumn("asked", F.lit(False))
    none = F.lit(None).cast(ends.schema["first"].dataType)
    lines = own.select("block").distinct().crossJoin(known.select("col").distinct()).select("block", "col", none.alias("first"), none.alias("last"), F.lit(True).alias("asked"))
    marked = lines.unionByName(ends).groupBy("block", "col").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.max("asked").alias("asked"))
    w = Window.partitionBy("col").rowsBetween(Window.unboundedPreceding, -1)
    above, below = F.last("last", ignorenulls=True).over(w.orderBy("block")), F.last("first", ignorenulls=True).over(w.orderBy(F.desc("block")))
    carried = marked.select("block", "col", "asked", F.array(above, below).alias("s")).where("asked").select("block", "col", F.explode("s").alias("s")).where("s IS NOT NULL")
    near = inner.select("block", "row", "col", "v").unionByName(carried.select("block", "s.row", "col", "s.v"))
    schema = f"row long, col long, `{value}` {dict(known.dtypes)['v']}, d2 long"
    names = ["row", "col", value, "d2"]

    def across(line: pa.Table, places: pa.Table) -> pa.Table:
        if not len(line) or not len(places):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), places.schema.field("v").type, pa.int64())], names)
        line = line.sort_by([("row", "ascending"), ("col", "ascending")])
        rows, asked = line.column("row").to_numpy(), line.column("col").to_numpy()
        source, d2 = nearest_in_block(rows, asked, places.column("row").to_numpy(), places.column("col").to_numpy())
        return pa.table([line.column("row"), line.column("col"), places.column("v").combine_chunks().take(pa.array(source)), pa.array(d2)], names)

    return own.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(across, schema)


def nearest_in_block(rows: np.ndarray, asked: np.ndarray, source_rows: np.ndarray, source_cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell (rows, asked), in order of rows and columns, which source is nearest, and the squared distance."""
    order = np.lexsort((source_rows, source_cols))
    high, (cols, starts) = source_rows[order], np.unique(source_cols[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    levels = np.unique(np.concatenate((rows, high)))  # rows by their rank, so that numbers of column and row fit
    number = np.repeat(np.arange(len(cols)), ends - starts) * len(levels) + np.searchsorted(levels, high)
    source, d2 = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    each, begins = np.unique(rows, return_index=True)
    for row, rank, a, b in zip(each.tolist(), np.searchsorted(levels, each).tolist(), begins, np.append(begins[1:], len(rows)), strict=True):
        after = np.searchsorted(number, np.arange(len(cols)) * len(levels) + rank)
        up, down = after > starts, after < ends
        before, after = np.maximum(after - 1, 0), np.minimum(after, len(order) - 1)
        at = np.where(up & (~down | (row - high[before] <= high[after] - row)), before, after)
        which, d2[a:b] = lowest(asked[a:b], cols, high[at], row)
        source[a:b] = order[at[which]]
    return source, d2


def lowest(asked: np.ndarray, cols: np.ndarray, rows: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked column (ascending) which of the sources (rows, cols), one a column and ascending, is nearest to it in a row,
    and the squared distance; ties go to the smaller row, then column. Numbers are whole, so ties are exact."""
    heights = [(int(r) - row) ** 2 for r in rows]
    cols, rows = cols.tolist(), rows.tolist()
    # The envelope: sources in order, each with the point (as a fraction) from which it is no farther than the one before.
    kept: list[int] = [0]
    starts: list[tuple[int, int]] = [(0, 0)]
    for j in range(1, len(cols)):
        while True:
            i = kept[-1]
            top, bottom = heights[j] + cols[j] ** 2 - heights[i] - cols[i] ** 2, 2 * (cols[j] - cols[i])
            if len(kept) > 1 and top * starts[-1][1] < starts[-1][0] * bottom:
                kept.pop()
                starts.pop()
            else:
                break
        kept.append(j)
        starts.append((top, bottom))
    at, d2, k = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), 0
    for n, x in enumerate(asked.tolist()):
        while k + 1 < len(kept) and starts[k + 1][0] < x * starts[k + 1][1]:
            k += 1
        found, m = None, k
        while m < len(kept) and (m == k or starts[m][0] <= x * starts[m][1]):
            j = kept[m]
            one = (heights[j] + (x - cols[j]) ** 2, rows[j], cols[j], j)
            found, m = one if found is None else min(found, one), m + 1
        at[n], d2[n] = found[3], found[0]
    return at, d2
