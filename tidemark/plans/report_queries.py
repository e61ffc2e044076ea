"""Queries on facts that reports state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reports, series
from tidemark.plans._tables import NATION_YEARS, PART_GRID, nation_years, part_grid, r4, table, year_of

FLAGS = """flagged AS (
  SELECT *, CASE WHEN (year + length(nation)) % 3 = 0 THEN 'modelled' ELSE 'observed' END AS flag FROM nation_years
)"""


def _flagged(spark, d):
    modelled = (F.col("year") + F.length("nation")) % 3 == 0
    return nation_years(spark, d).withColumn("flag", F.when(modelled, "modelled").otherwise("observed"))


def census_and_projection(spark, d):
    out = reports.census_and_projection(_flagged(spark, d), ["nation"], "year", "total", "flag")
    return out.withColumn("projection_year", F.col("projection_year").cast("double"))


def solid_dashed_series(spark, d):
    return reports.solid_and_dashed(_flagged(spark, d), ["nation"], "year", "total", "flag").select("nation", "year", "solid", "dashed")


def growth_rate_ratio(spark, d):
    totals = nation_years(spark, d).where("year IN (1996, 2000)")
    growth = series.pairwise_growth(totals, ["nation"], "year", "total").withColumn("growth", F.col("growth") + 2)
    out = reports.ratio_to_unit(growth, "nation", "NATION_1", ["first_year", "last_year"], "growth")
    return out.select("nation", "first_year", "last_year", r4(F.col("ratio")).alias("ratio"))


def missing_reasons(spark, d):
    known = F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice"))
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", year_of("o_orderdate").cast("string").alias("variable"), known.alias("value"))
    out = reports.missing_reasons(o, "o_orderpriority", "o_orderstatus", "variable", "value")
    return out.select("o_orderpriority", "o_orderstatus", F.array_join("variables", "|").alias("variables"))


def extremes_with_years(spark, d):
    out = reports.extremes(nation_years(spark, d), ["nation"], "total", "year")
    return out.withColumn("median", F.round("median", 1))


def latest_interval(spark, d):
    year = year_of("o_orderdate")
    name = F.concat(F.lit("share_sector_"), F.lpad((F.col("o_custkey") % 16).cast("string"), 2, "0"), F.lit("_since_"), (year - 1 - F.col("o_custkey") % 3).cast("string"))
    o = table(spark, d, "orders").select("o_orderpriority", year.alias("year"), F.when(F.col("o_custkey") % 5 > 0, name).otherwise("area").alias("variable"))
    return reports.latest_pair(o, ["o_orderpriority"], "year", "variable", r"^share_sector_\d{2}_since_(\d{4})$")


def declared_order(spark, d):
    return reports.declared_order(table(spark, d, "part"), "p_brand", ["Brand#5", "Brand#99", "Brand#11", "Brand#23"])


def _deviations(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long")).alias("a"), F.count("*").alias("b"))
    return p.select("p_brand", F.when(F.col("b") % 2 == 0, F.col("a")).alias("dev_own_area"), F.col("b").alias("dev_own"), (F.col("a") - F.col("b")).alias("dev_other"))


def columns_by_prefix(spark, d):
    return reports.by_prefix(_deviations(spark, d), ["p_brand"], "dev_", ["own_area_built", "other_built"])


def restricted_range(spark, d):
    return reports.restricted_range(_deviations(spark, d), ["p_brand"], "dev_", ["own", "other"])


def coverage_by_row(spark, d):
    out = reports.coverage(part_grid(spark, d), ["row"], "p_size", 25)
    return out.select("row", r4(F.col("share")).alias("share"), F.col("median").cast("double").alias("median"))


def exclusivity_by_row(spark, d):
    p = part_grid(spark, d)
    c = p.select("row", (F.greatest(F.col("p_size") - 20, F.lit(0)) / 64.0).alias("a"), ((F.col("p_size") % 4) / 16.0).alias("b"), ((F.col("col") % 2) / 8.0).alias("c"))
    out = reports.exclusivity(c, ["row"], ["a", "b", "c"])
    return out.select("row", r4(F.col("highest_sum")).alias("highest_sum"), "n_shared")


def centroids_by_size(spark, d):
    out = reports.centroids(part_grid(spark, d), ["p_size"], F.col("col") + 0.5, F.col("row") + 0.5)
    return out.select(F.col("p_size").cast("long").alias("p_size"), r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"), "n")


def shares_within(spark, d):
    out = reports.shares_within(table(spark, d, "part"), ["p_brand"], F.col("p_size") <= 10)
    return out.withColumn("share", r4(F.col("share")))


def growth_contrast(spark, d):
    n = nation_years(spark, d).withColumn("side", F.when(F.col("nation") < "NATION_2", "inside").otherwise("outside"))
    out = reports.growth_contrast(n, "side", "year", "total", 1996, 2000)
    return out.select("side", F.round("first", 1).alias("first"), F.round("last", 1).alias("last"), r4(F.col("growth")).alias("growth"))


def indexed_pair(spark, d):
    n = nation_years(spark, d)
    out = reports.indexed_pair(n.where("nation = 'NATION_1'"), n.where("nation = 'NATION_2' AND year > 1996"), "year", "total")
    return out.select("year", r4(F.col("left_index")).alias("left_index"), r4(F.col("right_index")).alias("right_index"))


QUERIES = {
    f.__name__: f
    for f in (
        census_and_projection, solid_dashed_series, growth_rate_ratio, missing_reasons, extremes_with_years, latest_interval, declared_order, columns_by_prefix,
        restricted_range, coverage_by_row, exclusivity_by_row, centroids_by_size, shares_within, growth_contrast, indexed_pair,
    )
}

DEVIATIONS = """deviations AS (
  SELECT p_brand, CASE WHEN count(*) % 2 = 0 THEN CAST(sum(p_size) AS BIGINT) END AS dev_own_area, count(*) AS dev_own,
    CAST(sum(p_size) AS BIGINT) - count(*) AS dev_other FROM part GROUP BY 1
)"""

SQL = {
    "census_and_projection": f"""WITH {NATION_YEARS}, {FLAGS}, backwards AS (
  SELECT *, row_number() OVER (PARTITION BY nation ORDER BY year DESC) AS back, count(*) OVER (PARTITION BY nation) AS n FROM flagged
), last AS (SELECT *, flag = 'modelled' AND n > 1 AS projected FROM backwards WHERE back = 1)
SELECT last.nation, CASE WHEN projected THEN b.year ELSE last.year END AS census_year, CASE WHEN projected THEN b.total ELSE last.total END AS census,
  CAST(CASE WHEN projected THEN last.year END AS DOUBLE) AS projection_year, CASE WHEN projected THEN last.total END AS projection
FROM last LEFT JOIN backwards b ON b.nation = last.nation AND b.back = 2""",
    "solid_dashed_series": f"""WITH {NATION_YEARS}, {FLAGS}
SELECT nation, year, CASE WHEN flag <> 'modelled' THEN total END AS solid,
  CASE WHEN flag = 'modelled' OR year = (SELECT max(year) FROM flagged g WHERE g.nation = f.nation AND g.flag <> 'modelled') THEN total END AS dashed
FROM flagged f""",
    "growth_rate_ratio": f"""WITH {NATION_YEARS}, growths AS (
  SELECT a.nation, a.year AS first_year, b.year AS last_year, pow(b.total / a.total, 0.25) + 1 AS growth
  FROM nation_years a JOIN nation_years b ON a.nation = b.nation AND a.year = 1996 AND b.year = 2000
)
SELECT g.nation, g.first_year, g.last_year, round(g.growth / f.growth, 4) AS ratio
FROM growths g LEFT JOIN growths f ON f.nation = 'NATION_1' AND f.first_year = g.first_year WHERE g.nation <> 'NATION_1'""",
    "missing_reasons": """SELECT o_orderpriority, o_orderstatus, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), '|' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS variables
FROM orders WHERE o_totalprice < 50000 GROUP BY 1, 2""",
    "extremes_with_years": f"""WITH {NATION_YEARS}
SELECT nation, min(total) AS low, arg_min(year, total) AS low_at, max(total) AS high, arg_max(year, total) AS high_at, round(median(total), 1) AS median, count(*) AS n
FROM nation_years GROUP BY 1""",
    "latest_interval": """WITH named AS (
  SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(year(o_orderdate) - 1 - o_custkey % 3 AS BIGINT) AS base FROM orders WHERE o_custkey % 5 > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY year DESC, base) AS place FROM named)
SELECT o_orderpriority, year, base FROM ranked WHERE place = 1""",
    "declared_order": """SELECT DISTINCT p_brand, CAST(CASE p_brand WHEN 'Brand#5' THEN 1 WHEN 'Brand#99' THEN 2 WHEN 'Brand#11' THEN 3 WHEN 'Brand#23' THEN 4 ELSE 5 END AS BIGINT) AS place
FROM part""",
    "columns_by_prefix": f"""WITH {DEVIATIONS}
SELECT p_brand, 'own_area_built' AS variant, CASE WHEN dev_own_area IS NOT NULL THEN 'dev_own_area' ELSE 'dev_own' END AS "column",
  CAST(coalesce(dev_own_area, dev_own) AS DOUBLE) AS value FROM deviations
UNION ALL SELECT p_brand, 'other_built', 'dev_other', CAST(dev_other AS DOUBLE) FROM deviations""",
    "restricted_range": f"""WITH {DEVIATIONS}
SELECT p_brand, CAST(least(dev_own_area, dev_own, dev_other) AS DOUBLE) AS lowest, CAST(greatest(dev_own_area, dev_own, dev_other) AS DOUBLE) AS highest FROM deviations""",
    "coverage_by_row": f"""WITH {PART_GRID}
SELECT row, round(avg(CASE WHEN p_size >= 25 THEN 1.0 ELSE 0.0 END), 4) AS share, CAST(median(p_size) AS DOUBLE) AS median FROM part_grid GROUP BY 1""",
    "exclusivity_by_row": f"""WITH {PART_GRID}, parts AS (
  SELECT row, greatest(p_size - 20, 0) / 64.0 AS a, (p_size % 4) / 16.0 AS b, (col % 2) / 8.0 AS c FROM part_grid
)
SELECT row, CAST(round(max(a + b + c), 4) AS DOUBLE) AS highest_sum, count(*) FILTER (CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT) >= 2) AS n_shared
FROM parts GROUP BY 1""",
    "centroids_by_size": f"""WITH {PART_GRID}
SELECT CAST(p_size AS BIGINT) AS p_size, round(avg(col + 0.5), 4) AS x, round(avg(row + 0.5), 4) AS y, count(*) AS n FROM part_grid GROUP BY 1""",
    "shares_within": """SELECT p_brand, count(*) AS n, count(*) FILTER (p_size <= 10) AS n_inside, round(count(*) FILTER (p_size <= 10) / count(*), 4) AS share FROM part GROUP BY 1""",
    "growth_contrast": f"""WITH {NATION_YEARS}, sides AS (
  SELECT CASE WHEN nation < 'NATION_2' THEN 'inside' ELSE 'outside' END AS side, year, total FROM nation_years UNION ALL SELECT 'total', year, total FROM nation_years
), ends AS (SELECT side, sum(total) FILTER (year = 1996) AS a, sum(total) FILTER (year = 2000) AS b FROM sides GROUP BY 1)
SELECT side, round(a, 1) AS first, round(b, 1) AS last, round(b / a - 1, 4) AS growth FROM ends""",
    "indexed_pair": f"""WITH {NATION_YEARS}, left_side AS (
  SELECT year, total / first_value(total) OVER (ORDER BY year) * 100 AS i FROM nation_years WHERE nation = 'NATION_1'
), right_side AS (SELECT year, total / first_value(total) OVER (ORDER BY year) * 100 AS i FROM nation_years WHERE nation = 'NATION_2' AND year > 1996)
SELECT l.year, round(l.i, 4) AS left_index, round(r.i, 4) AS right_index FROM left_side l LEFT JOIN right_side r USING (year)""",
}
