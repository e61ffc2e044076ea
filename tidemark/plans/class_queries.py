"""Queries on classes of cells, zones and accuracy of maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import agreement, classes, grid, spatial, zones
from tidemark.plans._tables import part_grid, r4, table


def _cells(spark, d):
    """Parts as cells with made-up bands and masks."""
    p, k = part_grid(spark, d), F.col("row") * 45 + F.col("col")
    return p.select(
        "row", "col", (F.col("p_size") <= 14).alias("built"), (F.expr("row div 9 + col div 7") % 7 == 0).alias("industrial"), (F.expr("row div 6 + col div 6") % 5 == 0).alias("resettled"),
        F.element_at(F.array(F.lit("vegetation"), F.lit("bare_soil"), F.lit("water"), F.lit("other")), (k % 4 + 1).cast("int")).alias("label"),
        F.when(F.col("p_size") <= 20, F.col("p_size")).otherwise(0).alias("first_year"), (k % 11 > 0).alias("valid"), (k % 13 == 0).alias("excluded"),
        (F.col("p_retailprice") / 2500).alias("ndvi"), ((k % 7 - 4) / 10.0).alias("mndwi"), ((k % 5 - 2) / 10.0).alias("ndwi"), ((k % 17) / 20.0).alias("wet"), ((k % 23) / 30.0).alias("amplitude"),
    )


def exclusive_layers(spark, d):
    out = classes.exclusive_layers(_cells(spark, d), "label", "built", "industrial", "resettled")
    areas = classes.class_areas(out.where("layer IS NOT NULL"), [], "layer", 0.0009)
    return areas.select("layer", "n", r4(F.col("km2")).alias("km2"), F.col("place").cast("long").alias("place"))


def training_labels(spark, d):
    out = classes.training_labels(_cells(spark, d), "first_year", 18, "valid", "excluded", guard=0)
    return out.groupBy("training_label").agg(F.count("*").alias("n"))


def phenology_split(spark, d):
    c = _cells(spark, d).withColumn("vegetation", F.col("label") == "vegetation").withColumn("soil", F.col("label") == "bare_soil")
    return classes.phenology(c, "vegetation", "soil", "ndvi", "wet", "amplitude").groupBy("crop").agg(F.count("*").alias("n"))


def floodplain_cells(spark, d):
    cells = part_grid(spark, d).select("row", "col", (F.col("p_retailprice") / 40).alias("z"))
    river = part_grid(spark, d).where("p_size = 7").select("row", "col", (F.col("p_retailprice") / 40).alias("river_z"))
    near = cells.join(grid.nearest_value(cells, river, "river_z"), ["row", "col"])
    out = near.withColumn("flooded", classes.floodplain(F.col("z") - F.col("river_z"), F.sqrt("d2") * 240))
    return out.groupBy("flooded").agg(F.count("*").alias("n"), F.max("d2").cast("long").alias("farthest"))


def seven_classes(spark, d):
    p = part_grid(spark, d)
    k = F.col("row") * 45 + F.col("col")
    c = p.select(
        "row", "col", (k % 10 > 0).alias("domain"), ((k % 10 > 0) & (F.col("p_size") > 3)).alias("occupied"), (F.col("p_size") / 50).alias("before"), ((F.col("p_size") + k % 6) / 55).alias("after"),
        (k % 19 / 19.0).alias("s1"), (k % 29 / 29.0 - 0.2).alias("s2"), (k % 31 / 31.0).alias("s3"), (F.greatest(k % 41 - 30, F.lit(0)) / 10.0).alias("industrial"),
    )
    out = classes.densification(c, "domain", "occupied", "before", "after", ["s1", "s2", "s3"], "industrial", 0.6, 0.8, 0.1, 0.5)
    return out.groupBy(F.col("class").cast("long").alias("class")).agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))


def _years(spark, d):
    c = _cells(spark, d).withColumn("year", F.explode(F.array(*[F.lit(y) for y in (2000, 2005, 2010, 2015)])))
    turned = F.pmod(F.col("row") * 45 + F.col("col") + F.col("year"), F.lit(9)) / 9.0
    return c.withColumn("ndvi", F.col("ndvi") * turned).withColumn("ndvi_wet", F.col("wet") * turned).withColumn("domain", F.col("resettled") | F.col("built")).withColumn("built", (F.col("first_year") > 0) & (F.col("first_year") <= F.col("year") - 1995))


def footprints_by_year(spark, d):
    return classes.footprints(_years(spark, d), "year", "domain", 2005).groupBy("year").agg(F.count("*").alias("n"), F.sum("row").alias("rows"))


def footprint_sweep(spark, d):
    out = classes.footprint_sweep(_years(spark, d), "year", {"any": "domain"}, 2005, [0.4, 0.8], 0.0009)
    return out.select("domain", "ratio", "lasting", "year", r4(F.col("km2")).alias("km2"))


#: Zones of the unit square around 0: one with a hole, one in two parts, one small.
ZONES = {
    "ring": [[(-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2)], [(-0.05, -0.05), (0.05, -0.05), (0.0, 0.06)]],
    "parts": [[(0.0, 0.0), (0.12, 0.01), (0.1, 0.13)], [(-0.1, -0.1), (-0.03, -0.11), (-0.06, -0.02)]],
    "small": [[(0.01, 0.01), (0.03, 0.01), (0.02, 0.04)]],
}


def _polygons(spark):
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in ZONES.items()]
    return spark.createDataFrame(rows, f"zone string, rings {zones.RINGS}")


def _points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("label") - 2).cast("double").alias("value"))


def zonal_statistics(spark, d):
    out = zones.zonal(zones.located(_points(spark, d), _polygons(spark), "x", "y", 0.05), ["zone"], "value")
    return out.select("zone", "n", "n_lit", *[r4(F.col(c)).alias(c) for c in ("total", "mean", "largest", "share_lit")])


def polygon_guard(spark, d):
    near = zones.located(_points(spark, d), _polygons(spark), "x", "y", 0.05, buffer=0.02).groupBy("zone").agg(F.count("*").alias("n"))
    small = _polygons(spark).where("zone = 'small'")
    rest = zones.outside(_points(spark, d), small, ["vec_id"], "x", "y", 0.05, 0.02).agg(F.lit("outside small").alias("zone"), F.count("*").alias("n"))
    return near.unionByName(rest)


def building_statistics(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 37).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"), "c_nationkey", (F.col("c_acctbal") + 1000).alias("area"))
    near = spatial.nearest_neighbour(c, "c_custkey", "x", "y", 4.0)
    km2 = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") * 2.0).alias("km2"))
    out = zones.building_statistics(c.join(near, "c_custkey"), "c_nationkey", "area", "d2", km2)
    return out.select("c_nationkey", "n", *[r4(F.col(k)).alias(k) for k in ("density_km2", "mean_area", "cv_area", "mean_neighbour")])


def _sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 1500, "long").when(F.col("n_chars") > 500, "middle").otherwise("short").alias("mapped"))
    sizes = docs.groupBy("lang").agg((F.count("*") / 1000).alias("weight"))
    truth = F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, "long").when(F.col("doc_id") % 3 == 0, "middle").otherwise("short")
    return table(spark, d, "labels").select("doc_id", truth.alias("truth")).join(docs.where("lang IS NOT NULL"), "doc_id").join(sizes, "lang"), docs


def area_matrix(spark, d):
    sample, _ = _sample(spark, d)
    return agreement.area_matrix(sample, "lang", "weight", "mapped", "truth").select("mapped", "truth", "n", r4(F.col("share")).alias("share"))


ACCURACY = ("overall", "overall_ci", "kappa", "users", "users_ci", "producers", "producers_ci", "leverage")


def estimated_accuracy(spark, d):
    sample, _ = _sample(spark, d)
    out = agreement.estimated_accuracy(sample, "lang", "weight", "mapped", "truth", "long")
    return out.select(*[r4(F.col(c)).alias(c) for c in ACCURACY], "n", "n_undecided")


def mapped_strata_accuracy(spark, d):
    sample, docs = _sample(spark, d)
    weights = docs.groupBy(F.col("mapped").alias("class")).agg((F.count("*") / F.lit(docs.count())).alias("weight"))
    out = agreement.mapped_strata_accuracy(sample, weights, "mapped", "truth")
    return out.select("class", "n", *[r4(F.col(c)).alias(c) for c in ("weight", "users", "users_ci", "producers", "leverage", "overall", "overall_ci", "kappa")])


QUERIES = {
    f.__name__: f
    for f in (
        exclusive_layers, training_labels, phenology_split, floodplain_cells, seven_classes, footprints_by_year, footprint_sweep,
        zonal_statistics, polygon_guard, building_statistics, area_matrix, estimated_accuracy, mapped_strata_accuracy,
    )
}

_CELLS = """cells AS (SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, p_partkey AS k, p_size, p_size <= 14 AS built, (p_partkey // 45 // 9 + p_partkey % 45 // 7) % 7 = 0 AS industrial, (p_partkey // 45 // 6 + p_partkey % 45 // 6) % 5 = 0 AS resettled,
  ['vegetation', 'bare_soil', 'water', 'other'][p_partkey % 4 + 1] AS label, CASE WHEN p_size <= 20 THEN p_size ELSE 0 END AS first_year, p_partkey % 11 > 0 AS valid, p_partkey % 13 = 0 AS excluded,
  p_retailprice / 2500 AS ndvi, (p_partkey % 7 - 4) / 10.0::DOUBLE AS mndwi, (p_partkey % 5 - 2) / 10.0::DOUBLE AS ndwi, (p_partkey % 17) / 20.0::DOUBLE AS wet, (p_partkey % 23) / 30.0::DOUBLE AS amplitude,
  p_retailprice FROM part)"""
_SQUARE = "off AS (SELECT i, j FROM (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j))"


def _footprints(ratio: str) -> str:
    return f"""turned AS (SELECT c.* REPLACE (ndvi * ((k + year) % 9 / 9.0::DOUBLE) AS ndvi, first_year > 0 AND first_year <= year - 1995 AS built), wet * ((k + year) % 9 / 9.0::DOUBLE) AS ndvi_wet, resettled OR built AS domain, year
        FROM cells c, (SELECT unnest([2000, 2005, 2010, 2015]) AS year)),
      cuts AS (SELECT year, median(ndvi) AS dry, median(ndvi_wet) AS wet_cut FROM turned WHERE valid AND NOT mndwi > 0 AND NOT domain GROUP BY 1),
      seed AS (SELECT year, row, col FROM turned LEFT JOIN cuts USING (year) WHERE domain AND year >= 2005 AND (built OR (valid AND mndwi <= 0 AND ndvi_wet < {ratio} * wet_cut AND ndvi < {ratio} * dry))),
      wider AS (SELECT DISTINCT year, row + i AS row, col + j AS col FROM seed, off),
      filled AS (SELECT year, row + i AS row, col + j AS col FROM wider, off GROUP BY 1, 2, 3 HAVING count(*) = 9),
      prints AS (SELECT * FROM filled SEMI JOIN (SELECT row, col FROM turned WHERE domain) USING (row, col))"""


def _sweep(ratio: str) -> str:
    return f"""SELECT 'any' AS domain, {ratio}::DOUBLE AS ratio, lasting, year, round(n * 0.0009::DOUBLE, 4) AS km2 FROM (WITH {_CELLS}, {_SQUARE}, {_footprints(ratio + "::DOUBLE")},
      years AS (SELECT unnest([2000, 2005, 2010, 2015]) AS year), first AS (SELECT row, col, min(year) AS since FROM prints GROUP BY 1, 2)
      SELECT false AS lasting, y.year, count(p.row) AS n FROM years y LEFT JOIN prints p USING (year) GROUP BY 1, 2 UNION ALL SELECT true, y.year, count(f.row) FROM years y LEFT JOIN first f ON f.since <= y.year GROUP BY 1, 2)"""


_EDGES = ", ".join(
    f"('{k}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)"
    for k, rings in ZONES.items()
    for ring in rings
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True)
)
_LOCATED = f"""e(zone, x1, y1, x2, y2) AS (VALUES {_EDGES}), points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label - 2 AS DOUBLE) AS value FROM embeddings),
  sides AS (SELECT vec_id, zone, value, (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 AS crossed,
    greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS s, sqrt((x - x1 - s * (x2 - x1)) ** 2 + (y - y1 - s * (y2 - y1)) ** 2) AS d FROM points, e),
  located AS (SELECT vec_id, zone, max(value) AS value, count(*) FILTER (WHERE crossed) % 2 = 1 AS inside, min(d) <= 0.02 AS near FROM sides GROUP BY 1, 2)"""
_SAMPLE = """docs AS (SELECT doc_id, lang, CASE WHEN n_chars > 1500 THEN 'long' WHEN n_chars > 500 THEN 'middle' ELSE 'short' END AS mapped FROM documents), sizes AS (SELECT lang, count(*) / 1000 AS w FROM documents GROUP BY 1),
  every AS (SELECT lang, w, mapped, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'long' WHEN doc_id % 3 = 0 THEN 'middle' ELSE 'short' END AS truth FROM labels JOIN docs USING (doc_id) JOIN sizes USING (lang)),
  sample AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n_h FROM every WHERE truth IS NOT NULL)"""

SQL = {
    "exclusive_layers": f"""WITH {_CELLS}, l AS (SELECT CASE WHEN industrial THEN 'industrial' WHEN resettled THEN 'resettled' WHEN built THEN 'built_up' WHEN label <> 'other' THEN label END AS layer FROM cells)
      SELECT layer, count(*) AS n, round(count(*) * 0.0009::DOUBLE, 4) AS km2, row_number() OVER (ORDER BY count(*) DESC, layer) AS place FROM l WHERE layer IS NOT NULL GROUP BY 1""",
    "training_labels": f"""WITH {_CELLS}, {_SQUARE}, seen AS (SELECT row, col FROM cells WHERE first_year BETWEEN 1 AND 18),
      core AS (SELECT row + i AS row, col + j AS col FROM seen, off GROUP BY 1, 2 HAVING count(*) = 9),
      m AS (SELECT c.*, core.row IS NOT NULL AS core, valid AND first_year = 0 AND NOT excluded AS pool, mndwi > 0 AND ndwi > 0 AS water FROM cells c LEFT JOIN core USING (row, col)),
      q AS (SELECT median(ndvi) AS cut FROM m WHERE pool AND NOT water),
      l AS (SELECT CASE WHEN NOT valid THEN NULL WHEN core THEN 'built' WHEN NOT pool THEN NULL WHEN water THEN 'water' WHEN ndvi >= 1.3::DOUBLE * cut THEN 'vegetation' ELSE 'bare_soil' END AS training_label FROM m, q)
      SELECT training_label, count(*) AS n FROM l GROUP BY 1""",
    "phenology_split": f"""WITH {_CELLS}, q AS (SELECT median(amplitude) AS a, median(wet) AS w FROM cells WHERE label IN ('vegetation', 'bare_soil')),
      l AS (SELECT CASE WHEN label = 'vegetation' AND amplitude <= 0.5::DOUBLE * a THEN 'irrigated' WHEN label = 'bare_soil' AND amplitude >= 1.3::DOUBLE * a AND wet >= w THEN 'rainfed' END AS crop FROM cells, q)
      SELECT crop, count(*) AS n FROM l GROUP BY 1""",
    "floodplain_cells": f"""WITH {_CELLS}, r AS (SELECT row AS rr, col AS rc, p_retailprice / 40 AS rz FROM cells WHERE p_size = 7),
      n AS (SELECT row, col, p_retailprice / 40 AS z, (row - rr) ** 2 + (col - rc) ** 2 AS d2, rr, rc, rz FROM cells, r),
      b AS (SELECT row, col, z, arg_min(rz, (d2, rr, rc)) AS rz, CAST(min(d2) AS BIGINT) AS d2 FROM n GROUP BY 1, 2, 3)
      SELECT z - rz BETWEEN -2 AND 10 AND sqrt(d2) * 240 <= 1000 AS flooded, count(*) AS n, max(d2) AS farthest FROM b GROUP BY 1""",
    "seven_classes": """WITH c AS (SELECT p_partkey % 10 > 0 AS domain, p_partkey % 10 > 0 AND p_size > 3 AS own, p_size / 50 AS f0, (p_size + p_partkey % 6) / 55 AS f1, p_partkey % 19 / 19.0::DOUBLE AS s1,
        p_partkey % 29 / 29.0::DOUBLE - 0.2::DOUBLE AS s2, p_partkey % 31 / 31.0::DOUBLE AS s3, greatest(p_partkey % 41 - 30, 0) / 10.0::DOUBLE AS ind FROM part),
      q AS (SELECT quantile_cont(s1, 0.6) FILTER (WHERE own) AS c1, quantile_cont(s2, 0.6) FILTER (WHERE own) AS c2, quantile_cont(s3, 0.6) FILTER (WHERE own) AS c3, quantile_cont(f0, 0.8) FILTER (WHERE own) AS hi,
        quantile_cont(f0, 0.1) FILTER (WHERE own) AS lo, quantile_cont(ind, 0.5) FILTER (WHERE domain AND ind > 0) AS qi FROM c),
      v AS (SELECT *, (own AND s1 > 0 AND s1 >= c1)::INT + (own AND s2 > 0 AND s2 >= c2)::INT + (own AND s3 > 0 AND s3 >= c3)::INT AS votes FROM c, q)
      SELECT CAST(CASE WHEN NOT domain THEN 0 WHEN ind >= qi THEN 6 WHEN f0 >= hi THEN 5 WHEN f0 < lo AND f1 >= lo THEN 4 WHEN f0 >= lo AND f0 < hi THEN CASE WHEN votes >= 2 THEN 3 ELSE 2 END ELSE 1 END AS BIGINT) AS class,
        count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM v GROUP BY 1""",
    "footprints_by_year": f"""WITH {_CELLS}, {_SQUARE}, {_footprints("0.6::DOUBLE")} SELECT year, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows FROM prints GROUP BY 1""",
    "footprint_sweep": _sweep("0.4") + " UNION ALL " + _sweep("0.8"),
    "zonal_statistics": f"""WITH {_LOCATED} SELECT zone, count(*) AS n, count(*) FILTER (WHERE value > 0) AS n_lit, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(max(value), 4) AS largest,
      round(count(*) FILTER (WHERE value > 0) / count(*), 4) AS share_lit FROM located WHERE inside GROUP BY 1""",
    "polygon_guard": f"""WITH {_LOCATED} SELECT zone, count(*) AS n FROM located WHERE inside OR near GROUP BY 1
      UNION ALL SELECT 'outside small', count(*) FROM located WHERE zone = 'small' AND NOT (inside OR near)""",
    "building_statistics": """WITH c AS (SELECT c_custkey AS k, CAST(c_custkey % 37 AS DOUBLE) AS x, c_acctbal / 100 AS y, c_nationkey AS u, c_acctbal + 1000 AS area FROM customer),
      n AS (SELECT a.k, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM c a JOIN c b ON a.k <> b.k GROUP BY 1)
      SELECT u AS c_nationkey, count(*) AS n, round(count(*) / nullif(max(n_regionkey) * 2.0::DOUBLE, 0), 4) AS density_km2, round(avg(area), 4) AS mean_area, round(stddev_samp(area) / nullif(avg(area), 0), 4) AS cv_area,
        round(avg(sqrt(d2)), 4) AS mean_neighbour FROM c JOIN n USING (k) JOIN nation ON u = n_nationkey GROUP BY 1""",
    "area_matrix": f"""WITH {_SAMPLE} SELECT mapped, truth, count(*) AS n, round(sum(w / n_h), 4) AS share FROM sample GROUP BY 1, 2""",
    "estimated_accuracy": f"""WITH {_SAMPLE}, x AS (SELECT lang, w, n_h, (mapped = truth)::INT::DOUBLE AS g, (mapped = 'long' AND truth = 'long')::INT::DOUBLE AS h, (mapped = 'long')::INT::DOUBLE AS m, (truth = 'long')::INT::DOUBLE AS t FROM sample),
      r AS (SELECT sum(w / n_h * g) AS o, sum(w / n_h * h) AS h, sum(w / n_h * m) AS m, sum(w / n_h * t) AS t FROM x),
      v AS (SELECT lang, max(x.w) AS w, max(n_h) AS n, var_samp(x.g) AS vg, var_samp(x.h - r.h / r.m * x.m) AS vu, var_samp(x.h - r.h / r.t * x.t) AS vp FROM x, r GROUP BY 1),
      s AS (SELECT sum(w * w * vg / n) FILTER (WHERE n > 1) AS vg, sum(w * w * vu / n) FILTER (WHERE n > 1) AS vu, sum(w * w * vp / n) FILTER (WHERE n > 1) AS vp, max(w / n) AS leverage, CAST(sum(n) AS BIGINT) AS n FROM v),
      a AS (SELECT mapped AS c, sum(w / n_h) AS a FROM sample GROUP BY 1), b AS (SELECT truth AS c, sum(w / n_h) AS b FROM sample GROUP BY 1), e AS (SELECT sum(a * b) AS e FROM a JOIN b USING (c))
      SELECT round(o, 4) AS overall, round(1.959964::DOUBLE * sqrt(vg), 4) AS overall_ci, round((o - e) / (1 - e), 4) AS kappa, round(h / m, 4) AS users, round(1.959964::DOUBLE * sqrt(greatest(vu, 0)) / m, 4) AS users_ci,
        round(h / t, 4) AS producers, round(1.959964::DOUBLE * sqrt(greatest(vp, 0)) / t, 4) AS producers_ci, round(leverage, 4) AS leverage, n, (SELECT count(*) FROM every WHERE truth IS NULL) AS n_undecided FROM r, s, e""",
    "mapped_strata_accuracy": f"""WITH {_SAMPLE}, w AS (SELECT mapped AS class, count(*) / (SELECT count(*) FROM docs) AS weight FROM docs GROUP BY 1),
      s AS (SELECT w.class, w.weight, count(truth) AS n, count(*) FILTER (WHERE truth = w.class) AS ok FROM w LEFT JOIN sample ON mapped = w.class GROUP BY 1, 2),
      p AS (SELECT truth AS class, sum(weight / n) AS real FROM sample JOIN s ON s.class = mapped GROUP BY 1),
      t AS (SELECT s.*, ok / n AS u, coalesce(real, 0) AS real FROM s LEFT JOIN p USING (class)),
      o AS (SELECT sum(weight * u) AS o, sum(weight * real) FILTER (WHERE n > 0) AS e, sum(weight * weight * u * (1 - u) / (n - 1)) FILTER (WHERE n > 1) AS v FROM t)
      SELECT class, n, round(weight, 4) AS weight, round(u, 4) AS users, round(CASE WHEN n > 1 THEN 1.959964::DOUBLE * sqrt(u * (1 - u) / (n - 1)) END, 4) AS users_ci, round(weight * u / nullif(real, 0), 4) AS producers,
        (SELECT round(max(z.weight / z.n), 4) FROM t z WHERE z.class <> t.class) AS leverage, round(o, 4) AS overall, round(1.959964::DOUBLE * sqrt(v), 4) AS overall_ci, round((o - e) / (1 - e), 4) AS kappa FROM t, o""",
}
