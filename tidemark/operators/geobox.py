"""The place of a grid: corner, cell size and extent, and what follows from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GeoBox:
    """west, north: the corner of the first cell; size: the side of a cell."""

    west: float
    north: float
    size: float
    height: int
    width: int

    @classmethod
    def around(cls, west: float, south: float, east: float, north: float, size: float) -> GeoBox:
        """The smallest grid with corners at multiples of the size that holds a box."""
        left, right = math.floor(west / size), math.ceil(east / size)
        bottom, top = math.floor(south / size), math.ceil(north / size)
        return cls(left * size, top * size, size, top - bottom, right - left)

    def scaled(self, factor: int) -> GeoBox:
        """The grid of blocks of factor x factor cells from the same corner; part blocks at the edge count."""
        return GeoBox(self.west, self.north, self.size * factor, -(-self.height // factor), -(-self.width // factor))

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        """x and y of a cell's centre."""
        return self.west + (col + 0.5) * self.size, self.north - (row + 0.5) * self.size

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of the cell that holds a point."""
        return F.floor((self.north - y) / self.size), F.floor((x - self.west) / self.size)

    def holds(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def faults(self, cells: DataFrame) -> DataFrame:
        """(row, col) of cells outside the grid, without a row or column, or there more than once."""
        n = cells.groupBy("row", "col").agg(F.count("*").alias("n"))
        wrong = F.col("row").isNull() | F.col("col").isNull() | ~self.holds(F.col("row"), F.col("col")) | (F.col("n") > 1)
        return n.where(wrong).select("row", "col", "n")


def refined(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell as factor x factor cells with its values."""
    steps = F.sequence(F.lit(0).cast("long"), F.lit(factor - 1).cast("long"))
    rest = [c for c in cells.columns if c not in ("row", "col")]
    rows = cells.select((F.col("row") * factor).alias("r__"), (F.col("col") * factor).alias("c__"), *rest).withColumn("i__", F.explode(steps)).withColumn("j__", F.explode(steps))
    return rows.select((F.col("r__") + F.col("i__")).alias("row"), (F.col("c__") + F.col("j__")).alias("col"), *rest)
