"""Queries on raster tiles: windows, mosaics and their mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.checkpoints import shared_path
from tidemark.operators.geobox import GeoBox, refined
from tidemark.plans._tables import part_grid, r4, table
from tidemark.sources import raster_tiles


def tile_window(spark, d):
    """The parts' grid written as tiles; of these the cells of a window."""
    folder = shared_path(spark, "tiles").removeprefix("file:")
    folder = "/" + folder.lstrip("/") if "://" not in folder else folder
    grid = part_grid(spark, d).select("row", "col", F.col("p_size").cast("double").alias("v"))
    raster_tiles.write_tiles(grid, folder, "v", west=0.0, north=0.0, size=30.0, tile=16)
    read = raster_tiles.read_tiles(spark, folder, (300.0, -900.0, 900.0, -30.0), block_rows=8)
    row, col = GeoBox(0.0, 0.0, 30.0, 1, 1).cell(F.col("x"), F.col("y"))
    return read.where("value IS NOT NULL").select(row.alias("row"), col.alias("col"), F.col("value").cast("long").alias("size"))


def _mosaic(spark, d):
    """Line items as overlapping tiles of quantities; returned ones have no value."""
    li = table(spark, d, "lineitem")
    value = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("value")
    cells = li.select((F.col("l_partkey") % 60).alias("row"), (F.col("l_suppkey") % 50).alias("col"), "l_linenumber", "l_orderkey", value)
    return raster_tiles.mosaic(cells, [F.col("l_linenumber"), F.col("l_orderkey")])


def tile_mosaic(spark, d):
    """One value for each cell of overlapping tiles, the first that there is."""
    return _mosaic(spark, d)


def _mapped(spark, d, how):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1.17 + 0.21).alias("y"), (F.col("p_partkey") % 47 + 0.37).alias("x"))
    return raster_tiles.inverse_mapped(p, _mosaic(spark, d), F.col("y"), F.col("x"), how=how).select("p_partkey", r4(F.col("value")).alias("value"))


def mosaic_nearest(spark, d):
    """The mosaic on another grid, nearest cells."""
    return _mapped(spark, d, "nearest")


def mosaic_bilinear(spark, d):
    """The mosaic on another grid, four cells each."""
    return _mapped(spark, d, "bilinear")


def refined_cells(spark, d):
    """Cells of the coarse grid as 8 x 8 fine ones, with what they add up to by fine row."""
    coarse = part_grid(spark, d).select("row", "col", "p_size")
    return refined(coarse, 8).groupBy("row").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"), F.max("col").alias("last"))


QUERIES = {f.__name__: f for f in (tile_window, tile_mosaic, mosaic_nearest, mosaic_bilinear, refined_cells)}

_MOSAIC = """m AS (SELECT l_partkey % 60 AS row, l_suppkey % 50 AS col, arg_min(l_quantity, (l_linenumber, l_orderkey, l_quantity)) FILTER (WHERE l_returnflag <> 'R') AS value FROM lineitem GROUP BY 1, 2),
  p AS (SELECT p_partkey, p_size * 1.17::DOUBLE + 0.21::DOUBLE AS y, p_partkey % 47 + 0.37::DOUBLE AS x FROM part)"""

SQL = {
    "tile_window": """SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, CAST(p_size AS BIGINT) AS size FROM part
      WHERE (p_partkey % 45 + 0.5) * 30 BETWEEN 300 AND 900 AND -(p_partkey // 45 + 0.5) * 30 BETWEEN -900 AND -30""",
    "tile_mosaic": f"WITH {_MOSAIC} SELECT row, col, value FROM m",
    "mosaic_nearest": f"WITH {_MOSAIC} SELECT p_partkey, round(value, 4) AS value FROM p LEFT JOIN m ON row = floor(y + 0.5::DOUBLE) AND col = floor(x + 0.5::DOUBLE)",
    "mosaic_bilinear": f"""WITH {_MOSAIC}, q AS (SELECT p_partkey, x, y, floor(y) + i AS r, floor(x) + j AS c FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
      w AS (SELECT p_partkey, value, (1 - abs(y - r)) * (1 - abs(x - c)) AS w FROM q LEFT JOIN m ON row = r AND col = c)
      SELECT p_partkey, round(sum(value * w) / nullif(sum(w) FILTER (WHERE value IS NOT NULL AND w > 0), 0), 4) AS value FROM w GROUP BY 1""",
    "refined_cells": """WITH f AS (SELECT p_partkey // 45 * 8 + i AS row, p_partkey % 45 * 8 + j AS col, p_size FROM part, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))
      SELECT row, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes, max(col) AS last FROM f GROUP BY 1""",
}
