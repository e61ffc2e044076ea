"""Queries on the end-to-end runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import assessment
from tidemark.plans._tables import part_grid, r4

SITES = [("east", 38.0, 9.0), ("north", 12.0, 4.0), ("south", 20.0, 31.0)]
YEARS = [1985, 1990, 2000, 2005, 2015]


def _sites(spark):
    return spark.createDataFrame(SITES, "site string, x double, y double")


def unit_growth(spark, d):
    """Areas and growth by the nearest site, from the years in which parts' cells were first seen."""
    cells = part_grid(spark, d).select("row", "col", F.when(F.col("p_size") <= 36, F.col("p_size") + 1979).otherwise(0).alias("first_year"))
    out = assessment.area_and_growth(cells, _sites(spark), "site", ("x", "y"), "first_year", YEARS, 0.0009, F.col("col") < 3)
    return out.select("unit", "metric", F.coalesce("start_year", "year").alias("start_year"), "year", r4(F.col("value")).alias("value"))


def unit_layer_areas(spark, d):
    """Areas of layers by nearest site and year."""
    year = F.element_at(F.array(*[F.lit(y) for y in YEARS]), (F.col("p_size") % 5 + 1).cast("int")).cast("long")
    layer = F.when(F.col("row") % 7 == 0, "resettled").when(F.col("p_size") > 40, "industrial").when(F.col("p_size") > 15, "built_up")
    out = assessment.layer_areas(part_grid(spark, d).select("row", "col", year.alias("year"), layer.alias("layer")), _sites(spark), "site", ("x", "y"), "year", "layer", 0.0009)
    return out.select("unit", "layer", "year", r4(F.col("km2")).alias("km2"))


def _run(spark, d):
    """Two years of made-up bands over the parts' grid: a town of discs around two places that grows."""
    p = part_grid(spark, d).withColumn("year", F.explode(F.array(F.lit(2000).cast("long"), F.lit(2005).cast("long"))))
    near = F.least(*[F.sqrt((F.col("row") - i) * (F.col("row") - i) + (F.col("col") - j) * (F.col("col") - j)) for i, j in ((9, 9), (11, 30))])
    town = near <= F.when(F.col("year") == 2000, 4).otherwise(6)
    noise = F.pmod(F.col("row") * 31 + F.col("col") * 17 + F.col("year"), F.lit(10)) / 100.0
    water = F.col("col") == 44
    # NDVI separates built-up cells, MNDWI water.
    ndvi = F.when(town, 0.15).when(F.col("p_size") > 25, 0.7).otherwise(0.4) + noise
    mndwi = F.when(water, 0.4).otherwise(-0.3) + noise / 10
    return p.select(
        "row", "col", "year", ndvi.alias("ndvi"), (ndvi - 0.05).alias("ndvi_wet"), mndwi.alias("mndwi"), (mndwi - 0.05).alias("ndwi"), F.when(near <= 4, 1999).when(near <= 6, 2004).otherwise(0).alias("first_year"),
        (F.col("p_size") != 50).alias("valid"), F.lit(False).alias("excluded"), ((F.col("row") >= 18) & (F.col("col") < 8)).alias("domain"), (near <= 2).alias("resettled"),
    )


def classification_areas(spark, d):
    """The layers' cells and polygons of the later year, from bands to vectors."""
    height = part_grid(spark, d).agg(F.max("row") + 1).first()[0]
    run = assessment.classification_run(_run(spark, d), [2000, 2005], ["ndvi", "mndwi", "ndwi"], height, 45, 2005, sample=1500, floor=50, trees=12, guard=1)
    found = assessment.layer_polygons(run, 2005).polygons().groupBy("zone")
    return found.agg(F.sum("cells").alias("cells"), F.count("*").alias("polygons"))


QUERIES = {f.__name__: f for f in (unit_growth, unit_layer_areas, classification_areas)}

_SITES = f"sites(site, x, y) AS (VALUES {', '.join(f'({n!r}, {x}::DOUBLE, {y}::DOUBLE)' for n, x, y in SITES)}), years AS (SELECT unnest({YEARS}) AS year)"
_NEAREST = "(SELECT arg_min(site, ((x - col - 0.5) ** 2 + (y - row - 0.5) ** 2, site)) FROM sites)"

SQL = {
    "unit_growth": f"""WITH {_SITES}, cells AS (SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, p_size + 1979 AS first FROM part WHERE p_size <= 36 AND p_partkey % 45 >= 3),
      u AS (SELECT {_NEAREST} AS unit, first FROM cells), a AS (SELECT site AS unit, year, (SELECT count(*) FROM u WHERE u.unit = site AND first <= year) * 0.0009::DOUBLE AS km2 FROM sites, years),
      p AS (SELECT unit, year, km2, lag(year) OVER w AS y0, lag(km2) OVER w AS k0 FROM a WINDOW w AS (PARTITION BY unit ORDER BY year)), s AS (SELECT unit, min(year) AS y0, max(year) AS y1, arg_min(km2, year) AS k0, arg_max(km2, year) AS k1 FROM a GROUP BY 1)
      SELECT unit, 'area_km2' AS metric, year AS start_year, year, round(km2, 4) AS value FROM a
      UNION ALL SELECT unit, 'growth_pct', y0, year, round(CASE WHEN km2 > 0 AND k0 > 0 THEN ((km2 / k0) ** (1.0::DOUBLE / (year - y0)) - 1) * 100 END, 4) FROM p WHERE y0 IS NOT NULL
      UNION ALL SELECT unit, 'span_growth_pct', y0, y1, round(CASE WHEN k0 > 0 AND k1 > 0 THEN ((k1 / k0) ** (1.0::DOUBLE / (y1 - y0)) - 1) * 100 END, 4) FROM s""",
    "unit_layer_areas": f"""WITH {_SITES}, cells AS (SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, {YEARS}[p_size % 5 + 1] AS year,
        CASE WHEN p_partkey // 45 % 7 = 0 THEN 'resettled' WHEN p_size > 40 THEN 'industrial' WHEN p_size > 15 THEN 'built_up' END AS layer FROM part), k AS (SELECT * FROM cells WHERE layer IS NOT NULL),
      u AS (SELECT {_NEAREST} AS unit, layer, year FROM k), e AS (SELECT site AS unit, layer, year FROM sites, (SELECT DISTINCT layer FROM k), (SELECT DISTINCT year FROM k))
      SELECT unit, layer, year, round(count(u.unit) * 0.0009::DOUBLE, 4) AS km2 FROM e LEFT JOIN u USING (unit, layer, year) GROUP BY ALL""",
}
