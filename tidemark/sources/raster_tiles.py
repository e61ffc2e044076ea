"""Raster tiles on disk as a Spark data source, read by window, and their index and mosaics.

A tile is a pair of files as many tools write them: `name.bil`, the cells row by row from the north-west, and `name.hdr`, a short
text with the size, place and kind of the cells. The format `tiles` plans its own partitions: a block of rows of each tile
that the window meets, of which the bytes of the window's columns are read. The window comes from options: a pushed-down filter
would stay with the frame that it came from, and other uses of that frame would miss rows. Any file system that pyarrow opens
will do.

Options: west, south, east, north (the window of cell centres, bounds included), block_rows. Columns: tile, row, col (within the
tile), x, y (the cell's centre), value; cells without data are null. Writing takes (tile_row, tile_col, row, col, value) with options
west, north (the corner of the whole grid), size, tile, nodata; files appear when the job commits."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "tile string, row long, col long, x double, y double, value double"
BLOCK_ROWS = 256
#: Fixed values of the header: kinds of cells by name and bits.
KINDS = {("FLOAT", 32): "<f4", ("FLOAT", 64): "<f8", ("UNSIGNEDINT", 8): "u1", ("UNSIGNEDINT", 16): "<u2", ("SIGNEDINT", 16): "<i2", ("SIGNEDINT", 32): "<i4"}


def _opened(path: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Tile:
    """One tile as its header has it; x0, y0: the centre of the north-west cell."""

    path: str
    rows: int
    cols: int
    kind: str
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None

    @classmethod
    def parse(cls, path: str, text: str) -> Tile:
        found = {k.upper(): v for k, v in (line.split(None, 1) for line in text.splitlines() if len(line.split(None, 1)) == 2)}
        kind = (found.get("PIXELTYPE", "UNSIGNEDINT").strip().upper(), int(found.get("NBITS", 8)))
        if kind not in KINDS or int(found.get("NBANDS", 1)) != 1 or int(found.get("SKIPBYTES", 0)):
            raise ValueError(f"{path}: one band of {sorted(KINDS)} without a preamble is read")
        swapped = KINDS[kind].replace("<", ">") if found.get("BYTEORDER", "I").strip().upper() == "M" else KINDS[kind]
        nodata = float(found["NODATA"]) if "NODATA" in found else None
        return cls(path, int(found["NROWS"]), int(found["NCOLS"]), swapped, *(float(found[k]) for k in ("ULXMAP", "ULYMAP", "XDIM", "YDIM")), nodata)

    def header(self) -> str:
        (name, bits), order = next(((k, b), "M" if self.kind[0] == ">" else "I") for (k, b), v in KINDS.items() if v == self.kind.replace(">", "<"))
        lines = {"NROWS": self.rows, "NCOLS": self.cols, "NBANDS": 1, "NBITS": bits, "PIXELTYPE": name, "BYTEORDER": order, "LAYOUT": "BIL", "ULXMAP": repr(self.x0), "ULYMAP": repr(self.y0), "XDIM": repr(self.dx), "YDIM": repr(self.dy)}
        return "".join(f"{k} {v}\n" for k, v in lines.items()) + (f"NODATA {self.nodata!r}\n" if self.nodata is not None else "")

    def window(self, west: float, south: float, east: float, north: float) -> tuple[int, int, int, int]:
        """First row, last row + 1, first column, last column + 1 of the cells whose centres lie in a box."""
        tiny = 1e-9
        cut = lambda v, most: int(min(max(v, 0), most))
        top, bottom = np.ceil((self.y0 - north) / self.dy - tiny), np.floor((self.y0 - south) / self.dy + tiny) + 1
        left, right = np.ceil((west - self.x0) / self.dx - tiny), np.floor((east - self.x0) / self.dx + tiny) + 1
        return cut(top, self.rows), cut(bottom, self.rows), cut(left, self.cols), cut(right, self.cols)


def tiles_of(folder: str) -> list[Tile]:
    """The tiles of a folder, by their headers."""
    from pyarrow import fs

    files, path = _opened(folder)
    found = []
    for info in files.get_file_info(fs.FileSelector(path, recursive=False)):
        if info.path.endswith(".hdr"):
            with files.open_input_stream(info.path) as f:
                found.append(Tile.parse(posixpath.join(folder, posixpath.basename(info.path)[:-4] + ".bil"), f.read().decode("ascii")))
    return sorted(found, key=lambda t: t.path)


@dataclass
class Block(InputPartition):
    """Rows of one tile and the columns of the window."""

    tile: Tile
    top: int
    bottom: int
    left: int
    right: int


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step = int(options.get("block_rows", BLOCK_ROWS))
        self.low = {"x": float(options.get("west", "-inf")), "y": float(options.get("south", "-inf"))}
        self.high = {"x": float(options.get("east", "inf")), "y": float(options.get("north", "inf"))}

    def partitions(self) -> list[Block]:
        out = []
        for tile in tiles_of(self.folder):
            top, bottom, left, right = tile.window(self.low["x"], self.low["y"], self.high["x"], self.high["y"])
            if left < right:
                # Blocks begin at multiples of the step, so a window reads the same blocks as its neighbour.
                out += [Block(tile, max(a, top), min(a + self.step, bottom), left, right) for a in range(top // self.step * self.step, bottom, self.step)]
        return out or [Block(Tile("", 0, 0, "u1", 0, 0, 1, 1, None), 0, 0, 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        tile, n = block.tile, block.right - block.left
        if block.top >= block.bottom or not n:
            return
        files, path = _opened(tile.path)
        width = np.dtype(tile.kind).itemsize
        name = posixpath.basename(tile.path)[:-4]
        with files.open_input_file(path) as f:
            for row in range(block.top, block.bottom):
                raw = f.read_at(n * width, (row * tile.cols + block.left) * width)
                value = np.frombuffer(raw, tile.kind).astype(np.float64)
                col = np.arange(block.left, block.right)
                gone = np.isnan(value) if tile.nodata is None else np.isnan(value) | (value == tile.nodata)
                columns = [pa.array([name] * n), pa.array(np.full(n, row)), pa.array(col), pa.array(tile.x0 + col * tile.dx), pa.array(np.full(n, tile.y0 - row * tile.dy)), pa.array(value, mask=gone)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TileWriter(DataSourceArrowWriter):
    """A tile at a time in memory; files get their names when the job commits, so a lost task leaves nothing that is read."""

    def __init__(self, options: dict):
        self.folder, self.mark = options["path"], uuid.uuid4().hex
        self.west, self.north, self.size = (float(options[k]) for k in ("west", "north", "size"))
        self.tile, self.nodata = int(options["tile"]), float(options.get("nodata", "-9999"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, path = _opened(self.folder)
        files.create_dir(path, recursive=True)
        held: tuple[int, int] | None = None
        cells, written = np.zeros(0), []

        def flush() -> None:
            if held is None:
                return
            half = self.size / 2
            tile = Tile("", self.tile, self.tile, "<f4", self.west + held[1] * self.tile * self.size + half, self.north - held[0] * self.tile * self.size - half, self.size, self.size, self.nodata)
            name = posixpath.join(path, f"_{self.mark}-{uuid.uuid4().hex}-r{held[0]}c{held[1]}")
            for end, raw in ((".bil", cells.astype("<f4").tobytes()), (".hdr_", tile.header().encode("ascii"))):
                with files.open_output_stream(name + end) as f:
                    f.write(raw)
                written.append(name + end)

        for batch in batches:
            names = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            tr, tc, row, col = (names[k].to_numpy().astype(np.int64) for k in ("tile_row", "tile_col", "row", "col"))
            value = names["value"].cast(pa.float64()).fill_null(self.nodata).to_numpy()
            cuts = np.flatnonzero(np.append(True, (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1]))) if len(tr) else []
            for a, b in zip(cuts, [*cuts[1:], len(tr)], strict=True):
                if held != (int(tr[a]), int(tc[a])):
                    flush()
                    held, cells = (int(tr[a]), int(tc[a])), np.full((self.tile, self.tile), self.nodata)
                cells[row[a:b] - held[0] * self.tile, col[a:b] - held[1] * self.tile] = value[a:b]
        flush()
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.folder)
        # Headers come last: a tile without a header isn't read.
        for end in (".bil", ".hdr_"):
            for name in (n for m in messages if m for n in m.files if n.endswith(end)):
                last = posixpath.basename(name).rsplit("-", 1)[1].removesuffix("_")
                files.move(name, posixpath.join(posixpath.dirname(name), last))

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.folder)
        for name in (n for m in messages if m for n in m.files):
            files.delete_file(name)


class TileSource(DataSource):
    """The format `tiles`."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known."""
    spark.dataSource.register(TileSource)


def read_tiles(spark: SparkSession, folder: str, box: tuple[float, float, float, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The cells of a folder's tiles, of a window (west, south, east, north) only if there is one."""
    register(spark)
    source = spark.read.format("tiles").option("block_rows", block_rows)
    for name, value in zip(("west", "south", "east", "north"), box or (), strict=False):
        source = source.option(name, repr(float(value)))
    return source.load(folder)


def write_tiles(cells: DataFrame, folder: str, value: str, west: float, north: float, size: float, tile: int = 256, nodata: float = -9999.0) -> None:
    """Cells (row, col, value) of a grid as tiles of 32-bit numbers, missing cells without data (K1-K3)."""
    register(cells.sparkSession)
    at = [F.floor(F.col(c) / tile).alias(f"tile_{c}") for c in ("row", "col")]
    dealt = cells.select(*at, F.col("row").cast("long"), F.col("col").cast("long"), F.col(value).cast("double").alias("value"))
    dealt = dealt.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col")
    options = {"west": west, "north": north, "size": size, "tile": tile, "nodata": nodata}
    dealt.write.format("tiles").mode("append").options(**{k: repr(v) for k, v in options.items()}).save(folder)


def tile_index(spark: SparkSession, folder: str) -> DataFrame:
    """(tile, path, west, south, east, north, rows, cols): a row for each tile, from its header."""
    rows = [(posixpath.basename(t.path)[:-4], t.path, t.x0 - t.dx / 2, t.y0 - (t.rows - 0.5) * t.dy, t.x0 + (t.cols - 0.5) * t.dx, t.y0 + t.dy / 2, t.rows, t.cols) for t in tiles_of(folder)]
    return spark.createDataFrame(rows, "tile string, path string, west double, south double, east double, north double, rows long, cols long")


def meeting(index: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The tiles of an index that share more than an edge with a box."""
    return index.where((F.col("west") < east) & (F.col("east") > west) & (F.col("south") < north) & (F.col("north") > south))


def tile_name(x: Column, y: Column, x0: float, y0: float, size: float) -> Column:
    """Row and column of the tile that holds a point, counted from 1 at the north-west corner, as R1_C1."""
    return F.concat(F.lit("R"), (F.floor((F.lit(y0) - y) / size) + 1).cast("string"), F.lit("_C"), (F.floor((x - F.lit(x0)) / size) + 1).cast("string"))


def mosaic(cells: DataFrame, by: list[Column], value: str = "value") -> DataFrame:
    """(row, col, value): one value for each cell of overlapping tiles, that of the first tile in order of `by` that has one; null
    where none has (S9, S12). Partial minima travel, one a cell and task."""
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(*[c.alias(f"k{k}") for k, c in enumerate(by)], F.col(value).alias("v"))))
    return cells.groupBy("row", "col").agg(first.alias("first")).select("row", "col", F.col("first.v").alias(value))


def inverse_mapped(target: DataFrame, cells: DataFrame, y: Column, x: Column, value: str = "value", how: str = "nearest") -> DataFrame:
    """The target's cells with a value from a mosaic at (y, x), in the mosaic's cells with centres at whole numbers.
    nearest: the cell whose centre is nearest, halves going up; bilinear: the four around, missing ones without weight. Each target
    cell asks for its sources by join, so it doesn't matter in which tile they lie."""
    asked = target.withColumns({"y__": y, "x__": x})
    source = cells.select(F.col("row").alias("r__"), F.col("col").alias("c__"), F.col(value).alias("v__"))
    if how == "nearest":
        keyed = asked.withColumns({"r__": F.floor(F.col("y__") + 0.5), "c__": F.floor(F.col("x__") + 0.5)})
        return keyed.join(source, ["r__", "c__"], "left").select(*target.columns, F.col("v__").alias(value))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = asked.withColumn("s__", F.explode(corners)).withColumns({"r__": F.floor("y__") + F.col("s__.i"), "c__": F.floor("x__") + F.col("s__.j")})
    weight = (1 - F.abs(F.col("y__") - F.col("r__"))) * (1 - F.abs(F.col("x__") - F.col("c__")))
    met = spread.withColumn("w__", weight).join(source, ["r__", "c__"], "left")
    sums = met.groupBy(*target.columns).agg(F.try_divide(F.sum(F.col("v__") * F.col("w__")), F.sum(F.when(F.col("v__").isNotNull() & (F.col("w__") > 0), F.col("w__")))).alias(value))
    return sums
