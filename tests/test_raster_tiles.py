"""Tiles written, found and read by window; mosaics and mappings against plain arrays."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.geobox import GeoBox, refined
from tidemark.sources import raster_tiles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles"))
    rows = [(r, c, None if (r * 7 + c) % 11 == 0 else float(r * 100 + c)) for r in range(20) for c in range(30)]
    raster_tiles.write_tiles(spark.createDataFrame(rows, "row long, col long, v double"), path, "v", west=500.0, north=900.0, size=10.0, tile=8)
    return path


def value(r, c):
    return None if r >= 20 or c >= 30 or (r * 7 + c) % 11 == 0 else float(r * 100 + c)


def test_round_trip(spark, folder):
    assert sorted(os.listdir(folder)) == sorted(f"r{i}c{j}{end}" for i in range(3) for j in range(4) for end in (".bil", ".hdr"))
    got = {(r.x, r.y): r.value for r in raster_tiles.read_tiles(spark, folder).collect()}
    assert got == {(505.0 + 10 * c, 895.0 - 10 * r): value(r, c) for r in range(24) for c in range(32)}


def test_windows_read_their_blocks_only(spark, folder):
    box = (505.0, 745.0, 585.0, 775.0)  # rows 12 to 15, columns 0 to 8
    frame = raster_tiles.read_tiles(spark, folder, box, block_rows=4)
    assert frame.rdd.getNumPartitions() == 2  # of twelve tiles with two blocks each
    got = {(r.x, r.y): r.value for r in frame.collect()}
    assert got == {(505.0 + 10 * c, 895.0 - 10 * r): value(r, c) for r in range(12, 16) for c in range(9)}
    reader = raster_tiles.TileReader({"path": folder, "west": "505", "south": "745", "east": "585", "north": "775", "block_rows": "4"})
    assert [(b.top, b.bottom, b.left, b.right) for b in reader.partitions()] == [(4, 8, 0, 8), (4, 8, 0, 1)]


def test_a_frame_can_be_used_again(spark, folder):
    whole = raster_tiles.read_tiles(spark, folder, block_rows=4)
    some = whole.where((F.col("x") > 585) & (F.col("x") <= 605) & (F.col("y") >= 895))
    assert sorted((r.x, r.value) for r in some.collect()) == [(595.0, value(0, 9)), (605.0, value(0, 10))]
    assert whole.count() == 24 * 32 and whole.where("x > 10000").count() == 0
    assert raster_tiles.read_tiles(spark, folder, (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_index_and_names(spark, folder):
    index = raster_tiles.tile_index(spark, folder)
    assert index.count() == 12
    assert {r.tile for r in raster_tiles.meeting(index, 575.0, 815.0, 585.0, 825.0).collect()} == {"r0c0", "r0c1", "r1c0", "r1c1"}
    assert {r.tile for r in raster_tiles.meeting(index, 500.0, 820.0, 580.0, 900.0).collect()} == {"r0c0"}  # edges alone don't meet
    name = spark.range(1).select(raster_tiles.tile_name(F.lit(33.4), F.lit(-16.1), -180.0, 90.0, 10.0).alias("n")).first().n
    assert name == "R11_C22"


def test_headers_of_others():
    text = "BYTEORDER M\nLAYOUT BIL\nNROWS 2\nNCOLS 3\nNBANDS 1\nNBITS 16\nPIXELTYPE SIGNEDINT\nULXMAP 10.5\nULYMAP 20.5\nXDIM 1\nYDIM 1\nNODATA -32768\n"
    tile = raster_tiles.Tile.parse("a.bil", text)
    assert (tile.kind, tile.nodata, tile.rows) == (">i2", -32768.0, 2) and raster_tiles.Tile.parse("a.bil", tile.header()) == tile
    with pytest.raises(ValueError):
        raster_tiles.Tile.parse("a.bil", text.replace("NBANDS 1", "NBANDS 3"))


def test_mosaics_equal_one_raster(spark, folder):
    """Overlapping tiles by precedence; then both mappings across the tiles' edges."""
    rng = np.random.default_rng(2)
    layers = {k: {(r, c): (None if rng.random() < 0.2 else float(rng.integers(100))) for r in range(a, a + 6) for c in range(b, b + 6)} for k, (a, b) in enumerate([(0, 0), (0, 4), (4, 0), (3, 3)])}
    rows = [(k, r, c, v) for k, own in layers.items() for (r, c), v in own.items()]
    cells = spark.createDataFrame(rows, "tile int, row long, col long, value double").repartition(5)
    joined = raster_tiles.mosaic(cells, [F.col("tile")])
    big = {}
    for _, own in sorted(layers.items()):
        for cell, v in own.items():
            if big.get(cell) is None:
                big[cell] = v
    assert {(r.row, r.col): r.value for r in joined.collect()} == big
    target = spark.createDataFrame([(k, float(y), float(x)) for k, (y, x) in enumerate(rng.uniform(-1, 10, (60, 2)))] + [(60, 2.0, 5.0), (61, 2.5, 4.5)], "k int, at_y double, at_x double")
    near = {r.k: r.value for r in raster_tiles.inverse_mapped(target, joined, F.col("at_y"), F.col("at_x")).collect()}
    mean = {r.k: r.value for r in raster_tiles.inverse_mapped(target, joined, F.col("at_y"), F.col("at_x"), how="bilinear").collect()}
    for k, y, x in target.collect():
        assert near[k] == big.get((math.floor(y + 0.5), math.floor(x + 0.5)))
        weights = [((1 - abs(y - r)) * (1 - abs(x - c)), big.get((r, c))) for r in (math.floor(y), math.floor(y) + 1) for c in (math.floor(x), math.floor(x) + 1)]
        known = [(w, v) for w, v in weights if v is not None and w > 0]
        want = sum(w * v for w, v in known) / sum(w for w, _ in known) if known else None
        assert mean[k] == (None if want is None else pytest.approx(want))


def test_geobox(spark):
    box = GeoBox.around(501.0, 845.0, 549.0, 899.0, 10.0)
    assert box == GeoBox(500.0, 900.0, 10.0, 6, 5) and box.scaled(4) == GeoBox(500.0, 900.0, 40.0, 2, 2)
    cells = spark.createDataFrame([(0, 0, 1), (5, 4, 2), (6, 0, 3), (0, 0, 4), (None, 1, 5)], "row long, col long, v int")
    x, y = box.centre(F.col("row"), F.col("col"))
    row, col = box.cell(F.col("x"), F.col("y"))
    back = cells.where("v = 2").select(x.alias("x"), y.alias("y")).select("x", "y", row.alias("row"), col.alias("col")).first()
    assert tuple(back) == (545.0, 845.0, 5, 4)
    assert sorted(((r.row, r.col, r.n) for r in box.faults(cells).collect()), key=str) == sorted([(6, 0, 1), (0, 0, 2), (None, 1, 1)], key=str)
    assert sorted((r.row, r.col, r.v) for r in refined(cells.where("v = 2"), 2).collect()) == [(10, 8, 2), (10, 9, 2), (11, 8, 2), (11, 9, 2)]
