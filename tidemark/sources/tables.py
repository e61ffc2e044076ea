"""Readers and writers of tables, fragments, features and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.contracts import LONG_TABLE, BrokenContractError

#: One feature of a GeoJSON collection.
FEATURES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; column names are trimmed, empty cells are null."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    found = {c.strip().lstrip("﻿"): c for c in raw.columns}
    fields = T.StructType.fromDDL(schema).fields
    if lost := [f.name for f in fields if f.name not in found]:
        raise BrokenContractError(f"{path} lacks columns {lost}")
    return raw.select(*[F.col(f"`{found[f.name]}`").try_cast(f.dataType).alias(f.name) for f in fields])


def long_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All fragments of the long table under some paths (S60); texts that are missing are empty, numbers null."""
    out = csv(spark, paths, LONG_TABLE)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("source", "method", "note")})


def write_long_table(df: DataFrame, path: str) -> None:
    """The long table with its declared columns, partitioned by family and year; a second write replaces the partitions that
    it holds and leaves the others (K5)."""
    columns = [x.split()[0] for x in LONG_TABLE.split(", ")]
    df.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family", "year").parquet(path)


def catalogue(scenes: DataFrame, cloud_most: float, platform: str, box: tuple[float, float, float, float], start: str, end: str) -> DataFrame:
    """Scenes of a catalogue (id, platform, cloud, ts, west, south, east, north) that a search finds, in order of id (S4); all
    conditions reach the scan."""
    west, south, east, north = box
    near = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return scenes.where((F.col("cloud") <= cloud_most) & (F.col("platform") == platform) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & near).orderBy("id")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, type, coordinates) of the features of collections, one collection a file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", FEATURES).alias("c"))
    return raw.select(F.explode("c.features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, tags, points) of an element list (S33): a closed way of four points or more is a polygon, other ways are
    lines, nodes are points."""
    schema = "elements array<struct<id: bigint, type: string, lat: double, lon: double, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["elements"]).alias("e")).select("e.*")
    points = F.when(F.col("type") == "node", F.array(F.struct("lat", "lon"))).otherwise(F.col("geometry"))
    closed = (F.size("geometry") >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    kind = F.when(F.col("type") == "node", "Point").when(closed, "Polygon").otherwise("LineString")
    return e.select("id", kind.alias("kind"), "tags", points.alias("points"))


def rounded_points(points: Column, digits: int = 6) -> Column:
    """Coordinates as they are published (K9)."""
    return F.transform(points, lambda p: F.struct(F.round(p["lat"], digits).alias("lat"), F.round(p["lon"], digits).alias("lon")))


def buildings(spark: SparkSession, path: str, box: tuple[float, float, float, float], confidence: float = 0.0) -> DataFrame:
    """Building points within a box (S21, S31); the file may be compressed."""
    west, south, east, north = box
    rows = csv(spark, path, "latitude double, longitude double, area_in_meters double, confidence double, full_plus_code string")
    return rows.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east) & (F.col("confidence") >= confidence))


def layer(spark: SparkSession, path: str, name: str, year: int) -> DataFrame:
    """(row, col, v) of a layer and year out of a table that is partitioned by both (S7): other partitions aren't read."""
    return spark.read.parquet(path).where((F.col("layer") == name) & (F.col("year") == year)).select("row", "col", "v")


def write_layers(df: DataFrame, path: str) -> None:
    """Cells of layers (layer, year, row, col, v), one partition for each layer and year (K1-K3)."""
    df.repartition("layer", "year").sortWithinPartitions("row", "col").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "year").parquet(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of files, for manifests."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def resampled(cells: DataFrame, value: str, affine: tuple[float, float, float, float], how: str = "average") -> DataFrame:
    """A layer on another aligned grid (S9-S11): target = source * scale + shift for rows and columns. average: the mean of the
    source cells in a target cell; nearest: the cell at its centre."""
    row_scale, row_shift, col_scale, col_shift = affine
    r, c = F.col("row") * row_scale + row_shift, F.col("col") * col_scale + col_shift
    target = cells.select(F.floor(r).alias("row"), F.floor(c).alias("col"), (F.abs(r - F.floor(r) - 0.5) + F.abs(c - F.floor(c) - 0.5)).alias("off"), F.col(value))
    if how == "average":
        return target.groupBy("row", "col").agg(F.avg(value).alias(value))
    return target.groupBy("row", "col").agg(F.min_by(value, F.struct("off", value)).alias(value))


def bilinear(cells: DataFrame, value: str, points: DataFrame) -> DataFrame:
    """(…, value) of a layer at points (y, x) in cell units, cell centres at whole numbers (S11): each point asks its four
    neighbours, missing ones don't weigh."""
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    asked = points.withColumn("s", F.explode(corner)).withColumn("row", F.floor("y") + F.col("s.i")).withColumn("col", F.floor("x") + F.col("s.j"))
    weight = (1 - F.abs(F.col("y") - F.col("row"))) * (1 - F.abs(F.col("x") - F.col("col")))
    met = asked.withColumn("w", weight).join(cells.select("row", "col", value), ["row", "col"]).where(F.col("w") > 0)
    return met.groupBy(*points.columns).agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum(F.when(F.col(value).isNotNull(), F.col("w")))).alias(value))
