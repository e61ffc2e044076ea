"""Queries on polygons of cells, their boundaries, coverage and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import shapes, vector, zones
from tidemark.plans._tables import part_grid, r4, table


def _zoned(spark, d):
    """Parts as cells of three zones; the largest sizes are no zone."""
    zone = F.when(F.col("p_size") <= 20, "low").when(F.col("p_size") <= 36, "middle").when(F.col("p_size") <= 46, "high")
    return part_grid(spark, d).select("row", "col", zone.alias("zone"), "p_retailprice")


def zone_polygons(spark, d):
    """By zone: cells, sides and corners of its polygons, and how many more outlines than holes there are."""
    out = vector.polygons(_zoned(spark, d)).rings().groupBy("zone")
    outlines = F.count_if(~F.col("hole")) - F.count_if("hole")
    return out.agg(F.sum("cells").alias("cells"), F.sum("sides").alias("sides"), F.sum("corners").alias("corners"), outlines.alias("outlines_less_holes"))


def polygon_samples(spark, d):
    """The polygons of one zone with the price at their first cell."""
    cells = _zoned(spark, d)
    found = vector.polygons(cells.where("zone = 'high'")).sampled(cells.select("row", "col", "p_retailprice"))
    return found.select("row", "col", "cells", r4(F.col("p_retailprice")).alias("price"))


def shared_boundaries(spark, d):
    """By pair of neighbours: the length of their boundary and what its columns and steps add up to."""
    found = vector.arcs(_zoned(spark, d))
    return found.groupBy("zone", "other").agg(F.sum("length").alias("length"), F.sum("twice_before").alias("twice"))


def simplified_areas(spark, d):
    """Zones by tolerance with their areas, and the tolerance that keeps within 3 %: two discs and the land around them, in which
    the largest parts are holes."""
    far = [F.sqrt((F.col("row") - i) * (F.col("row") - i) + (F.col("col") - j) * (F.col("col") - j)) for i, j in ((12, 14), (30, 28))]
    zone = F.when(F.col("p_size") == 50, None).when(far[0] <= 9, "one").when(far[1] <= 13, "two").otherwise("land")
    found = vector.arcs(part_grid(spark, d).select("row", "col", zone.alias("zone")), (0.0, 0.8, 1.5, 3.0))
    best = vector.simplified(found, 3.0).agg(F.max("tolerance").alias("chosen"))
    return vector.areas(found).crossJoin(F.broadcast(best)).select("tolerance", "zone", "cells_before", "cells_after", r4(F.col("error_pct")).alias("error_pct"), "chosen")  # one row


def _rectangles(spark, d):
    c = table(spark, d, "customer")
    x, y = (F.col("c_custkey") % 61).cast("double") * 0.7031, (F.col("c_acctbal") + 1000) / 300
    w, h = 0.4137 + (F.col("c_nationkey") % 7) * 0.9, 0.3219 + (F.col("c_custkey") % 5) * 1.1
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))
    return c.select("c_custkey", F.array(ring).cast(zones.RINGS).alias("rings"))


def covered_cells(spark, d):
    """How much of each cell customers' rectangles cover."""
    out = shapes.coverage(_rectangles(spark, d), ["c_custkey"])
    return out.groupBy("row", "col").agg(F.count("*").alias("n"), r4(F.sum("fraction")).alias("covered"))


def triangle_shares(spark, d):
    """Triangles of vectors by the area that a box holds, and by their own."""
    e = table(spark, d, "embeddings")
    v = [F.col("embedding")[k].cast("double") for k in range(6)]
    ring = F.array(*[F.struct(v[k].alias("x"), v[k + 1].alias("y")) for k in (0, 2, 4)])
    polygons = e.select("vec_id", F.array(ring).cast(zones.RINGS).alias("rings"))
    quarter = [shapes.share_in_box(polygons, ["vec_id"], *box).select("vec_id", "area", "share") for box in ((-9.0, -9.0, 0.0, 0.0), (0.0, -9.0, 9.0, 0.0), (-9.0, 0.0, 0.0, 9.0), (0.0, 0.0, 9.0, 9.0))]
    parts = quarter[0].unionByName(quarter[1]).unionByName(quarter[2]).unionByName(quarter[3])
    return parts.groupBy("vec_id").agg((F.round(F.max("area") * 1e6) / 1e6).alias("area"), F.round(F.sum("share"), 6).alias("shares"))


def line_cells(spark, d):
    """Cells of a grid that the way from vector to vector meets."""
    e = table(spark, d, "embeddings")
    lines = e.select("label", *[(F.col("embedding")[k].cast("double") * 40 + 0.013).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])
    return shapes.touched_cells(lines, ["label"]).groupBy("label").agg(F.count("*").alias("cells"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


def dissolved_squares(spark, d):
    """The union of the squares of a zone's cells: area, sides and outlines less holes."""
    c = _zoned(spark, d).where("zone IS NOT NULL")
    corner = lambda i, j: F.struct((F.col("col") + i).cast("double").alias("x"), (F.col("row") + j).cast("double").alias("y"))
    squares = c.select("zone", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))
    found = shapes.ring_areas(shapes.dissolved(squares, ["zone"]), ["zone"])
    outlines = F.count_if(F.col("area") > 0) - F.count_if(F.col("area") < 0)
    return found.groupBy("zone").agg(F.sum("area").cast("long").alias("cells"), F.sum("n").alias("sides"), outlines.alias("outlines_less_holes"))


def buffered_sites(spark, d):
    """Parts' cells within reach of suppliers' places; suppliers in debt have no place."""
    p = part_grid(spark, d).select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 220).alias("x"), (F.col("s_suppkey") % 45).cast("double").alias("y"))
    inside = shapes.within_buffers(p, s, "x", "y", 1.5).agg(F.count("*").alias("n"), F.coalesce(F.sum("row"), F.lit(0)).alias("rows"))
    return inside.select(F.lit("inside").alias("what"), "n", "rows").unionByName(shapes.buffers(s, "x", "y")[1].agg(F.lit("no place").alias("what"), F.count("*").alias("n"), F.coalesce(F.sum("s_suppkey"), F.lit(0)).alias("rows")))


QUERIES = {f.__name__: f for f in (zone_polygons, polygon_samples, shared_boundaries, simplified_areas, covered_cells, triangle_shares, line_cells, dissolved_squares, buffered_sites)}

_ZONED = """zoned AS (SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, CASE WHEN p_size <= 20 THEN 'low' WHEN p_size <= 36 THEN 'middle' WHEN p_size <= 46 THEN 'high' END AS zone, p_retailprice FROM part),
  cells AS (SELECT * FROM zoned WHERE zone IS NOT NULL)"""
#: Sides by direction, and the neighbours of each corner of each cell: along one side, along the other, and across.
_OUTLINES = f"""{_ZONED}, steps(i, j) AS (VALUES (-1, 0), (0, 1), (1, 0), (0, -1)),
  sides AS (SELECT c.zone, count(*) AS sides FROM cells c, steps LEFT JOIN cells o ON o.row = c.row + i AND o.col = c.col + j WHERE o.zone IS DISTINCT FROM c.zone GROUP BY 1),
  turns(i, j) AS (VALUES (-1, -1), (-1, 1), (1, 1), (1, -1)),
  bends AS (SELECT c.zone, a.zone IS NOT DISTINCT FROM c.zone AS a, b.zone IS NOT DISTINCT FROM c.zone AS b, o.zone IS NOT DISTINCT FROM c.zone AS o FROM cells c, turns
    LEFT JOIN cells a ON a.row = c.row + i AND a.col = c.col LEFT JOIN cells b ON b.row = c.row AND b.col = c.col + j LEFT JOIN cells o ON o.row = c.row + i AND o.col = c.col + j),
  corners AS (SELECT zone, count(*) FILTER (WHERE NOT a AND NOT b) AS convex, count(*) FILTER (WHERE a AND b AND NOT o) AS concave FROM bends GROUP BY 1),
  sizes AS (SELECT zone, count(*) AS cells FROM cells GROUP BY 1)"""
_OUTLINES_SQL = "(convex - concave) // 4 AS outlines_less_holes FROM sizes JOIN sides USING (zone) JOIN corners USING (zone)"

SQL = {
    "zone_polygons": f"WITH {_OUTLINES} SELECT zone, cells, sides, convex + concave AS corners, {_OUTLINES_SQL}",
    "dissolved_squares": f"WITH {_OUTLINES} SELECT zone, cells, sides, {_OUTLINES_SQL}",
    "polygon_samples": f"""WITH RECURSIVE {_ZONED}, m AS MATERIALIZED (SELECT row, col, row * 45 + col AS id, p_retailprice FROM cells WHERE zone = 'high'),
      near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) <= 1),
      reach AS (SELECT id AS a, id AS b FROM m UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
      first AS (SELECT a AS id, min(b) AS head FROM reach GROUP BY 1)
      SELECT row, col, cells, round(p_retailprice, 4) AS price FROM (SELECT head, count(*) AS cells FROM first GROUP BY 1) JOIN m ON id = head""",
    "shared_boundaries": f"""WITH {_ZONED}, every AS (SELECT row, col FROM cells UNION SELECT row, col + 1 FROM cells UNION SELECT row + 1, col FROM cells),
      v AS (SELECT e.row, e.col, a.zone AS west, b.zone AS here, c.zone AS north FROM every e LEFT JOIN cells a ON a.row = e.row AND a.col = e.col - 1 LEFT JOIN cells b ON b.row = e.row AND b.col = e.col LEFT JOIN cells c ON c.row = e.row - 1 AND c.col = e.col),
      sides AS (SELECT CASE WHEN here IS NULL OR west < here THEN west ELSE here END AS x, CASE WHEN here IS NULL OR west < here THEN here ELSE west END AS y, CASE WHEN west IS NULL OR west < here THEN 2 * col ELSE -2 * col END AS twice FROM v WHERE west IS DISTINCT FROM here
        UNION ALL SELECT CASE WHEN here IS NULL OR north < here THEN north ELSE here END, CASE WHEN here IS NULL OR north < here THEN here ELSE north END, 0 FROM v WHERE north IS DISTINCT FROM here)
      SELECT CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE x END AS zone, coalesce(y, x) AS other, count(*) AS length, CAST(sum(twice) AS BIGINT) AS twice FROM sides GROUP BY 1, 2""",
    "covered_cells": """WITH r AS (SELECT (c_custkey % 61) * 0.7031::DOUBLE AS x, (c_acctbal + 1000) / 300 AS y, 0.4137::DOUBLE + (c_nationkey % 7) * 0.9::DOUBLE AS w, 0.3219::DOUBLE + (c_custkey % 5) * 1.1::DOUBLE AS h FROM customer),
      c AS (SELECT *, unnest(range(CAST(floor(x) AS BIGINT), CAST(floor(x + w) AS BIGINT) + 1)) AS col FROM r), g AS (SELECT *, unnest(range(CAST(floor(y) AS BIGINT), CAST(floor(y + h) AS BIGINT) + 1)) AS row FROM c),
      f AS (SELECT row, col, (least(x + w, col + 1) - greatest(x, col)) * (least(y + h, row + 1) - greatest(y, row)) AS f FROM g)
      SELECT row, col, count(*) AS n, round(sum(f), 4) AS covered FROM f WHERE f > 1e-13 GROUP BY 1, 2""",
    "triangle_shares": """WITH e AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS v FROM embeddings)
      SELECT vec_id, round(abs((v[3] - v[1]) * (v[6] - v[2]) - (v[5] - v[1]) * (v[4] - v[2])) / 2 * 1e6) / 1e6 AS area, 1.0::DOUBLE AS shares FROM e""",
    "line_cells": """WITH l AS (SELECT vec_id, label, embedding[1]::DOUBLE * 40 + 0.013::DOUBLE AS x1, embedding[2]::DOUBLE * 40 + 0.013::DOUBLE AS y1, embedding[3]::DOUBLE * 40 + 0.013::DOUBLE AS x2, embedding[4]::DOUBLE * 40 + 0.013::DOUBLE AS y2 FROM embeddings),
      r AS (SELECT *, unnest(range(CAST(floor(least(y1, y2)) AS BIGINT), CAST(floor(greatest(y1, y2)) AS BIGINT) + 1)) AS row FROM l),
      s AS (SELECT *, greatest(0, least((row - y1) / (y2 - y1), (row + 1 - y1) / (y2 - y1))) AS t0, least(1, greatest((row - y1) / (y2 - y1), (row + 1 - y1) / (y2 - y1))) AS t1 FROM r),
      x AS (SELECT label, row, x1 + t0 * (x2 - x1) AS a, x1 + t1 * (x2 - x1) AS b FROM s WHERE t0 <= t1),
      c AS (SELECT DISTINCT label, row, unnest(range(CAST(floor(least(a, b)) AS BIGINT), CAST(floor(greatest(a, b)) AS BIGINT) + 1)) AS col FROM x)
      SELECT label, count(*) AS cells, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM c GROUP BY 1""",
    "buffered_sites": """WITH p AS (SELECT p_partkey // 45 AS row, p_partkey % 45 AS col FROM part), s AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal / 220 END AS x, CAST(s_suppkey % 45 AS DOUBLE) AS y FROM supplier)
      SELECT 'inside' AS what, count(*) AS n, CAST(coalesce(sum(row), 0) AS BIGINT) AS rows FROM p WHERE EXISTS (SELECT 1 FROM s WHERE (x - col) ** 2 + (y - row) ** 2 <= 2.25)
      UNION ALL SELECT 'no place', count(*), CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) FROM s WHERE x IS NULL""",
}
