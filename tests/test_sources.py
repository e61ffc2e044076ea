import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, learning
from tidemark.sources import tables
from tidemark.streaming import windows


def test_csv_and_long_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿family, unit,year,variable,value,measure,flag,level,source,method,note\nf,u,2000,v,1.5,m,observed,A,,,x\nf,u,bad,v,,m,observed,A,s,,\n")
    df = tables.long_tables(spark, str(tmp_path / "a.csv"))
    assert [(r.year, r.value, r.source, r.note) for r in df.collect()] == [(2000, 1.5, "", "x"), (None, None, "s", "")]
    assert contracts.canonical_order(df).first().year is None
    with pytest.raises(contracts.BrokenContractError):
        tables.csv(spark, str(tmp_path / "a.csv"), "other string")
    path = str(tmp_path / "out")
    tables.write_long_table(df, path)
    tables.write_long_table(df.where("year = 2000").withColumn("value", F.lit(9.0)), path)
    assert sorted((r.year, r.value) for r in spark.read.parquet(path).where("year is not null").collect()) == [(2000, 9.0)]
    assert spark.read.parquet(path).count() == 2


def test_buildings_and_features(spark, tmp_path):
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("latitude,longitude,area_in_meters,confidence,geometry,full_plus_code\n-16,33.5,10,0.9,x,p\n-16,40,10,0.9,x,q\n-16,33.6,10,0.1,x,r\n")
    assert [r.full_plus_code for r in tables.buildings(spark, str(tmp_path / "b.csv.gz"), (33, -17, 34, -15), 0.5).collect()] == ["p"]
    way = lambda *p: {"id": len(p), "type": "way", "geometry": [{"lat": a, "lon": b} for a, b in p]}
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"id": 9, "type": "node", "lat": 1.23456789, "lon": 2.0}, way((0, 0), (0, 1), (1, 1), (0, 0)), way((0, 0), (1, 1))]}))
    got = tables.osm_elements(spark, str(tmp_path / "o.json"))
    assert {(r.id, r.kind) for r in got.collect()} == {(9, "Point"), (4, "Polygon"), (2, "LineString")}
    assert got.where("id = 9").select(tables.rounded_points(F.col("points")).alias("p")).first().p[0].lat == 1.234568
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    assert tables.geojson(spark, str(tmp_path / "g.json")).first().type == "Point"


def test_layers_are_pruned(spark, tmp_path):
    path = str(tmp_path / "layers")
    tables.write_layers(spark.createDataFrame([("a", 2000, 0, 0, 1.0), ("b", 2000, 0, 0, 2.0), ("a", 2005, 3, 4, 3.0)], "layer string, year int, row int, col int, v double"), path)
    got = tables.layer(spark, path, "a", 2005)
    assert [tuple(r) for r in got.collect()] == [(3, 4, 3.0)] and "PartitionFilters: [isnotnull(layer" in got._jdf.queryExecution().toString()


def test_resampling(spark):
    cells = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(4) for c in range(4)], "row int, col int, v double")
    assert {(r.row, r.col): r.v for r in tables.resampled(cells, "v", (0.5, 0, 0.5, 0)).collect()}[1, 1] == 27.5
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 3.0)], "k int, y double, x double")
    assert {r.k: r.v for r in tables.bilinear(cells, "v", points).collect()} == {1: 5.5, 2: 33.0}


def test_catalogue(spark):
    scenes = spark.sql("select 'b' id, 'p' platform, 5.0D cloud, timestamp'2020-06-01' ts, 33.0D west, -17.0D south, 34.0D east, -16.0D north union all select 'a', 'p', 50.0D, timestamp'2020-06-01', 33.0D, -17.0D, 34.0D, -16.0D")
    assert [r.id for r in tables.catalogue(scenes, 20, "p", (33.5, -16.5, 35, -15), "2020-05-01", "2020-07-01").collect()] == ["b"]


def test_draws(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("usual").alias("c"), (F.col("id") % 7).cast("double").alias("x"))
    n = {r.c: r.n for r in learning.training_sample(df, ["id"], "c", 2000, 150).groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert 1700 < n["usual"] < 2300 and 100 < n["rare"] <= 200
    drawn = learning.stratified_draw(df, ["id"], "c", 24, 7)
    assert {r.c: r["count"] for r in drawn.groupBy("c").count().collect()} == {"rare": 24, "usual": 24}
    assert sorted(r.id for r in drawn.collect()) == sorted(r.id for r in learning.stratified_draw(df.repartition(3), ["id"], "c", 24, 7).collect())


def test_forest(spark):
    df = spark.range(600).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumn("c", F.when(F.col("a") > 9, "high").otherwise("low"))
    model = learning.forest(df, ["a", "b"], "c", trees=10)
    out = learning.classified(model, df.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), ["a", "b"])
    assert out.where("id = 5").first()["class"] is None and out.where("class = c").count() > 590 and learning.importances(model, ["a", "b"])["a"] > 0.8


def test_stream_equals_batch(spark, data, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{data}/events.parquet").repartition(1).write.parquet(path)
    stream = windows.windowed_sums(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.start, r.event_type): r.n for r in windows.windowed_sums(spark.read.parquet(path)).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("sums").collect()} == batch
