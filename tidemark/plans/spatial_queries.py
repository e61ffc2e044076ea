"""Queries on sites, ranges, grids and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import spectral
from tidemark.operators import grid, population, spatial
from tidemark.plans._tables import PART_GRID, part_grid, r4, table, year_of

RADIUS = 3


def block_aggregate_partial_edges(spark, d):
    out = grid.blocks(part_grid(spark, d), 4, "p_size")
    return out.select("block_row", "block_col", F.col("total").cast("long").alias("total"), "n")


def block_fractions(spark, d):
    cells = part_grid(spark, d).withColumn("v", (F.col("p_size") > 25).cast("int"))
    return grid.block_fractions(cells, 4, "v").select("block_row", "block_col", r4(F.col("fraction").cast("double")).alias("fraction"))


def nearest_site(spark, d):
    sites = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 400.0).alias("x"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = spatial.nearest_site(c, sites, (F.col("c_acctbal"),), ("x",), "n_name")
    return out.groupBy("site").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def nearest_year_anchor(spark, d):
    o = table(spark, d, "orders").select(year_of("o_orderdate").alias("year"), "o_totalprice")
    return o.groupBy(spatial.nearest_key(F.col("year"), [1995, 1997, 2000]).cast("long").alias("anchor")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def nearest_year_join(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), year_of("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    census = table(spark, d, "orders").where(F.year("o_orderdate").isin(1996, 1999)).groupBy(F.col("o_orderstatus").alias("status"), year_of("o_orderdate").alias("census")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_price"))
    return population.nearest_year(o, census, ["status"], "year", "census").select("status", "year", "n", "census", "mean_price")


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def nearest_neighbour(spark, d):
    out = spatial.nearest_neighbour(_points(spark, d), "vec_id", "x", "y", 0.02)
    return out.select("vec_id", F.round("d2", 9).alias("d2"))


def range_band_lookup(spark, d):
    bands = spark.createDataFrame([(0, 9, "small"), (10, 29, "medium"), (25, 40, "overlap"), (45, 60, "large")], "low int, high int, band string")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return spatial.range_band(p, bands, F.col("p_size"), "low", "high", "band").select("p_partkey", "band")


def interval_overlap(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min(F.dayofmonth("ts")).cast("long").alias("start"), F.max(F.dayofmonth("ts")).cast("long").alias("stop"))
    return spatial.overlapping(e, "start", "stop", 3, 20)


def point_in_polygon(spark, d):
    ring = [(-0.1, -0.1), (0.12, -0.08), (0.05, 0.02), (0.11, 0.13), (-0.09, 0.1)]
    p = _points(spark, d)
    return p.groupBy("label").agg(F.count_if(spatial.in_polygon(F.col("x"), F.col("y"), ring)).alias("inside"), F.count("*").alias("n"))


def circular_direction(spark, d):
    out = _points(spark, d).groupBy("label").agg(*spatial.direction("x", "y"))
    return out.select("label", r4(F.col("mean_direction")).alias("mean_direction"), r4(F.col("resultant")).alias("resultant"))


def sector_histogram(spark, d):
    return _points(spark, d).groupBy("label", spatial.sector(F.col("x"), F.col("y")).alias("sector")).agg(F.count("*").alias("n"))


def grid_sum_preserving(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return spatial.grid_sums(li, "l_partkey", "l_suppkey", 50, "l_quantity").select("col", "row", F.round("total", 2).alias("total"), "n")


def _old(spark, d):
    return part_grid(spark, d).where("p_size <= 20").select("row", "col")


def _new(spark, d):
    return part_grid(spark, d).where("p_size <= 28").select("row", "col")


def neighbour_density(spark, d):
    return grid.density(_old(spark, d), RADIUS).select("row", "col", r4(F.col("density")).alias("density"))


def growth_typology(spark, d):
    return grid.growth_type(_old(spark, d), _new(spark, d), 1, 0.5).groupBy("type").agg(F.count("*").alias("n"))


def majority_filter(spark, d):
    return grid.majority(_old(spark, d), 45, 45)


def morphology_open_close(spark, d):
    return grid.closed(_old(spark, d), part_grid(spark, d))


def mask_overlay(spark, d):
    return grid.overlay(_old(spark, d), part_grid(spark, d).where("p_retailprice > 1000"))


def rings_by_distance(spark, d):
    mask = part_grid(spark, d).where("p_size = 7").select("row", "col")
    out = grid.rings(part_grid(spark, d).select("row", "col"), mask, 30.0, (60.0, 120.0))
    return out.groupBy("ring").agg(F.count("*").alias("n"))


def components_8conn(spark, d):
    out = grid.components(part_grid(spark, d).where("p_size <= 14").select("row", "col"), width=45)
    return out.groupBy("component").agg(F.count("*").alias("n"))


def _height(spark, d):
    return part_grid(spark, d).agg(F.max("row") + 1).first()[0]


def landscape_metrics(spark, d):
    out = grid.patch_metrics(grid.components(part_grid(spark, d).where("p_size <= 14").select("row", "col"), width=45), 30.0, _height(spark, d), 45)
    return out.select("patches", *[r4(F.col(c)).alias(c) for c in ("mean_area_ha", "median_area_ha", "largest_patch_pct", "edge_density", "mean_shape")])


def median_composite(spark, d):
    valid = spectral.qa_valid(F.col("l_linenumber"), (2,))
    li = table(spark, d, "lineitem").select(F.expr("l_partkey div 100").alias("row"), F.col("l_suppkey").alias("col"), F.when(valid, F.col("l_quantity")).alias("band"))
    return grid.composite(li, ["band"]).select("row", "col", r4(spectral.gated(F.col("band"), F.col("n_band"))).alias("band"), "n_band")


def normalised_difference(spark, d):
    band = {"nir": F.col("l_quantity"), "red": F.col("l_linenumber") * 5.0, "swir16": F.col("l_tax") * 100, "green": F.col("l_discount") * 100, "blue": F.col("l_linenumber") * 1.0}
    out = table(spark, d, "lineitem").select("l_returnflag", *[f(band.__getitem__).alias(k) for k, f in spectral.INDICES.items()])
    return out.groupBy("l_returnflag").agg(*[r4(F.avg(k)).alias(k) for k in spectral.INDICES], *[F.count(k).alias(f"n_{k}") for k in spectral.INDICES])


def envelope_radius(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("step"), "l_quantity")
    target = F.when(F.col("l_returnflag") == "A", 1e4).when(F.col("l_returnflag") == "N", 3e5).otherwise(1e12)
    return spatial.smallest_reaching(li, ["l_returnflag"], "step", "l_quantity", target)


def height_above_nearest(spark, d):
    cells, river = part_grid(spark, d).select("row", "col", F.col("p_retailprice").alias("z")), part_grid(spark, d).where("p_size = 7").select("row", "col", F.col("p_retailprice").alias("z"))
    near = grid.nearest_value(cells, river, "z").withColumnRenamed("z", "river_z")
    return cells.join(near, ["row", "col"]).select("row", "col", F.round(F.col("z") - F.col("river_z"), 2).alias("hand"), F.col("d2").cast("long").alias("d2"))


QUERIES = {f.__name__: f for f in (block_aggregate_partial_edges, block_fractions, nearest_site, nearest_year_anchor, nearest_year_join, nearest_neighbour, range_band_lookup, interval_overlap, point_in_polygon, circular_direction, sector_histogram, grid_sum_preserving, neighbour_density, growth_typology, majority_filter, morphology_open_close, mask_overlay, rings_by_distance, components_8conn, landscape_metrics, median_composite, normalised_difference, envelope_radius, height_above_nearest)}

_POINTS = "points AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_SQUARE = "off AS (SELECT i, j FROM (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j))"
_COMPONENTS = f"""WITH RECURSIVE {PART_GRID}, m AS MATERIALIZED (SELECT row, col, row * 45 + col AS id FROM part_grid WHERE p_size <= 14),
  near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
  reach AS (SELECT id AS a, id AS b FROM m UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
  labelled AS MATERIALIZED (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""

SQL = {
    "block_aggregate_partial_edges": f"""WITH {PART_GRID} SELECT row // 4 AS block_row, col // 4 AS block_col, CAST(sum(p_size) AS BIGINT) AS total, count(*) AS n FROM part_grid GROUP BY 1, 2""",
    "block_fractions": f"""WITH {PART_GRID} SELECT row // 4 AS block_row, col // 4 AS block_col, CASE WHEN count(*) = 16 THEN round(sum((p_size > 25)::INT) / 16.0::DOUBLE, 4) ELSE 0.0::DOUBLE END AS fraction FROM part_grid GROUP BY 1, 2""",
    "nearest_site": """WITH n AS (SELECT c_custkey, c_acctbal, arg_min(n_name, ((c_acctbal - n_nationkey * 400.0::DOUBLE) ** 2, n_name)) AS site FROM customer, nation GROUP BY 1, 2)
      SELECT site, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM n GROUP BY 1""",
    "nearest_year_anchor": """WITH y AS (SELECT year(o_orderdate) AS y, o_totalprice FROM orders)
      SELECT CAST(CASE WHEN y <= 1996 THEN 1995 WHEN y <= 1998 THEN 1997 ELSE 2000 END AS BIGINT) AS anchor, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM y GROUP BY 1""",
    "nearest_year_join": """WITH o AS (SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, round(avg(o_totalprice), 2) AS p FROM orders GROUP BY 1, 2)
      SELECT a.status, a.year, a.n, arg_min(b.year, (abs(a.year - b.year), b.year)) AS census, arg_min(b.p, (abs(a.year - b.year), b.year)) AS mean_price FROM o a JOIN o b ON a.status = b.status AND b.year IN (1996, 1999) GROUP BY 1, 2, 3""",
    "nearest_neighbour": f"""WITH {_POINTS} SELECT a.vec_id, round(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS d2 FROM points a JOIN points b ON a.vec_id <> b.vec_id GROUP BY 1""",
    "range_band_lookup": """SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 9 THEN 'small' WHEN p_size BETWEEN 10 AND 29 THEN 'medium' WHEN p_size BETWEEN 25 AND 40 THEN 'overlap' WHEN p_size BETWEEN 45 AND 60 THEN 'large' END AS band FROM part""",
    "interval_overlap": """SELECT * FROM (SELECT user_id, CAST(min(day(ts)) AS BIGINT) AS start, CAST(max(day(ts)) AS BIGINT) AS stop FROM events GROUP BY 1) WHERE stop > 3 AND start < 20""",
    "point_in_polygon": f"""WITH {_POINTS}, e(x1, y1, x2, y2) AS (VALUES (-0.1::DOUBLE, -0.1::DOUBLE, 0.12::DOUBLE, -0.08::DOUBLE), (0.12, -0.08, 0.05, 0.02), (0.05, 0.02, 0.11, 0.13), (0.11, 0.13, -0.09, 0.1), (-0.09, 0.1, -0.1, -0.1)),
      c AS (SELECT vec_id, label, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM points, e GROUP BY 1, 2)
      SELECT label, count(*) FILTER (WHERE inside) AS inside, count(*) AS n FROM c GROUP BY 1""",
    "circular_direction": f"""WITH {_POINTS}, u AS (SELECT label, x / sqrt(x * x + y * y) AS s, y / sqrt(x * x + y * y) AS c FROM points)
      SELECT label, round((degrees(atan2(sum(s), sum(c))) + 360) % 360, 4) AS mean_direction, round(sqrt(sum(s) ** 2 + sum(c) ** 2) / count(*), 4) AS resultant FROM u GROUP BY 1""",
    "sector_histogram": f"""WITH {_POINTS} SELECT label, CAST(floor((degrees(atan2(x, y)) + 360) % 360 / 22.5) AS INT) AS sector, count(*) AS n FROM points GROUP BY 1, 2""",
    "grid_sum_preserving": """WITH c AS (SELECT min(l_partkey) AS x0, min(l_suppkey) AS y0 FROM lineitem)
      SELECT (l_partkey - x0) // 50 AS col, (l_suppkey - y0) // 50 AS row, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem, c GROUP BY 1, 2""",
    "neighbour_density": f"""WITH {PART_GRID}, m AS (SELECT * FROM part_grid WHERE p_size <= 20), o AS (SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j BETWEEN 1 AND 9)
      SELECT row + i AS row, col + j AS col, round(count(*) / 28.0::DOUBLE, 4) AS density FROM m, o GROUP BY 1, 2""",
    "growth_typology": f"""WITH {PART_GRID}, a AS (SELECT row, col FROM part_grid WHERE p_size <= 20), b AS (SELECT row, col FROM part_grid WHERE p_size BETWEEN 21 AND 28),
      n AS (SELECT b.row, b.col, count(a.row) / 4.0::DOUBLE AS dens FROM b LEFT JOIN a ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2)
      SELECT CASE WHEN dens >= 0.5 THEN 'infill' WHEN dens = 0 THEN 'leapfrog' ELSE 'edge' END AS type, count(*) AS n FROM n GROUP BY 1""",
    "majority_filter": f"""WITH {PART_GRID}, {_SQUARE}, m AS (SELECT row, col FROM part_grid WHERE p_size <= 20), c AS (SELECT r AS row, q AS col FROM (SELECT unnest(range(45)) AS r), (SELECT unnest(range(45)) AS q)),
      n AS (SELECT c.row, c.col, greatest(0, least(44, c.row + i)) AS r, greatest(0, least(44, c.col + j)) AS q FROM c, off)
      SELECT n.row, n.col FROM n JOIN m ON m.row = r AND m.col = q GROUP BY 1, 2 HAVING count(*) >= 5""",
    "morphology_open_close": f"""WITH {PART_GRID}, {_SQUARE}, m AS (SELECT row, col FROM part_grid WHERE p_size <= 20), dil AS (SELECT DISTINCT row + i AS row, col + j AS col FROM m, off),
      ero AS (SELECT row + i AS row, col + j AS col FROM dil, off GROUP BY 1, 2 HAVING count(*) = 9) SELECT row, col FROM ero SEMI JOIN part_grid USING (row, col)""",
    "mask_overlay": f"""WITH {PART_GRID} SELECT count(*) FILTER (WHERE p_size <= 20 AND p_retailprice > 1000) AS both, count(*) FILTER (WHERE p_size <= 20 AND NOT p_retailprice > 1000) AS only_a, count(*) FILTER (WHERE p_size > 20 AND p_retailprice > 1000) AS only_b FROM part_grid""",
    "rings_by_distance": f"""WITH {PART_GRID}, m AS (SELECT row, col FROM part_grid WHERE p_size = 7), n AS (SELECT g.row, g.col, min((g.row - m.row) ** 2 + (g.col - m.col) ** 2) AS d2 FROM part_grid g, m GROUP BY 1, 2)
      SELECT CAST(CASE WHEN d2 = 0 THEN 0 WHEN sqrt(d2) * 30 <= 60 THEN 1 WHEN sqrt(d2) * 30 <= 120 THEN 2 ELSE 3 END AS INT) AS ring, count(*) AS n FROM n GROUP BY 1""",
    "components_8conn": _COMPONENTS + " SELECT component, count(*) AS n FROM labelled GROUP BY 1",
    "landscape_metrics": _COMPONENTS + """, e AS (SELECT l.component, count(*) AS cells, sum((SELECT 4 - count(*) FROM m o WHERE abs(o.row - m.row) + abs(o.col - m.col) = 1)) AS edges,
        sum((m.row = 0)::INT + (m.row = h.h - 1)::INT + (m.col = 0)::INT + (m.col = 44)::INT) AS outer_edges FROM labelled l JOIN m USING (id), (SELECT max(row) + 1 AS h FROM part_grid) h GROUP BY 1)
      SELECT count(*) AS patches, round(avg(cells * 900.0::DOUBLE) / 10000, 4) AS mean_area_ha, round(median(cells * 900.0::DOUBLE / 10000), 4) AS median_area_ha,
        round(100.0::DOUBLE * max(cells) / (max(h) * 45), 4) AS largest_patch_pct, round(sum((edges - outer_edges) * 30.0::DOUBLE) / (max(h) * 45 * 900.0::DOUBLE / 10000), 4) AS edge_density, round(avg(edges * 30.0::DOUBLE / (4 * sqrt(cells * 900.0::DOUBLE))), 4) AS mean_shape FROM e, (SELECT max(row) + 1 AS h FROM part_grid)""",
    "median_composite": """SELECT l_partkey // 100 AS row, l_suppkey AS col, CASE WHEN count(*) FILTER (WHERE l_linenumber & 4 = 0 AND l_linenumber <> 0) >= 2
      THEN round(median(l_quantity) FILTER (WHERE l_linenumber & 4 = 0 AND l_linenumber <> 0), 4) END AS band, count(*) FILTER (WHERE l_linenumber & 4 = 0 AND l_linenumber <> 0) AS n_band FROM lineitem GROUP BY 1, 2""",
    "normalised_difference": """WITH b AS (SELECT l_returnflag, l_quantity AS nir, l_linenumber * 5.0::DOUBLE AS red, l_tax * 100 AS swir, l_discount * 100 AS green, l_linenumber * 1.0::DOUBLE AS blue FROM lineitem),
      x AS (SELECT l_returnflag, CASE WHEN nir > 0 AND red > 0 THEN (nir - red) / (nir + red) END AS ndvi, CASE WHEN swir > 0 AND nir > 0 THEN (swir - nir) / (swir + nir) END AS ndbi,
        CASE WHEN green > 0 AND swir > 0 THEN (green - swir) / (green + swir) END AS mndwi, CASE WHEN green > 0 AND nir > 0 THEN (green - nir) / (green + nir) END AS ndwi,
        CASE WHEN nir > 0 AND red > 0 AND blue > 0 AND abs(nir + 6 * red - 7.5::DOUBLE * blue + 1) > 0.1 THEN 2.5::DOUBLE * (nir - red) / (nir + 6 * red - 7.5::DOUBLE * blue + 1) END AS evi FROM b)
      SELECT l_returnflag, round(avg(ndvi), 4) AS ndvi, round(avg(ndbi), 4) AS ndbi, round(avg(mndwi), 4) AS mndwi, round(avg(ndwi), 4) AS ndwi, round(avg(evi), 4) AS evi,
        count(ndvi) AS n_ndvi, count(ndbi) AS n_ndbi, count(mndwi) AS n_mndwi, count(ndwi) AS n_ndwi, count(evi) AS n_evi FROM x GROUP BY 1""",
    "envelope_radius": """WITH s AS (SELECT l_returnflag, l_suppkey AS step, sum(l_quantity) AS a FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(a) OVER (PARTITION BY l_returnflag ORDER BY step) AS t FROM s)
      SELECT l_returnflag, coalesce(min(step) FILTER (WHERE t >= CASE l_returnflag WHEN 'A' THEN 1e4 WHEN 'N' THEN 3e5 ELSE 1e12 END), max(step)) AS radius FROM c GROUP BY 1""",
    "height_above_nearest": f"""WITH {PART_GRID}, m AS (SELECT row AS r, col AS q, p_retailprice AS z FROM part_grid WHERE p_size = 7),
      n AS (SELECT row, col, p_retailprice, (row - r) ** 2 + (col - q) ** 2 AS d2, r, q, z FROM part_grid, m)
      SELECT row, col, round(p_retailprice - arg_min(z, (d2, r, q)), 2) AS hand, CAST(min(d2) AS BIGINT) AS d2 FROM n GROUP BY row, col, p_retailprice""",
}
