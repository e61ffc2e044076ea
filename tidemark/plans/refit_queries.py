"""Queries on unit roots, parallel trends, synthetic controls with units left out and fake breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import causal, refits
from tidemark.plans._tables import r4, table


def _months(spark, d):
    """(series, t, total): orders by priority and month."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("t"), "o_totalprice")
    return o.groupBy("series", "t").agg(F.sum("o_totalprice").alias("total"))


def unit_root_tests(spark, d):
    """Whether monthly totals return to their mean: the statistic without lags, for each priority."""
    return causal.unit_root(_months(spark, d), "series", "t", "total", lags=0).select("series", r4(F.col("t")).alias("t"), "n")


def _panel(spark, d):
    """(region, nation, quarter, total): orders of customers."""
    o = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("quarter"), "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"))
    # Each region's first nation is the treated one.
    first = n.groupBy("region").agg(F.min("n_name").alias("first"))
    named = n.join(F.broadcast(first), "region").select("n_nationkey", "region", F.when(F.col("n_name") == F.col("first"), "treated").otherwise(F.col("n_name")).alias("nation"))
    return o.join(c, "o_custkey").join(F.broadcast(named), "n_nationkey").groupBy("region", "nation", "quarter").agg(F.sum("o_totalprice").alias("total"))


def panel_trend_tests(spark, d):
    """Parallel trends of each region's nations before 1998 and the leads of its first one."""
    logs = _panel(spark, d).withColumn("total", F.log("total"))
    out = refits.trend_tests(logs, ["region"], "nation", "quarter", "total", "treated", 1997 * 4 + 3, 1997 * 4 + 3)
    return out.select("region", "test", r4(F.col("f")).alias("f"), "p", "n", "n_clusters", "longest", "fires", "reason")


def synthetic_effects(spark, d):
    """The first nation of each region against a mix of the others, with every control left out once, at two breaks."""
    fits = refits.control_fits(_panel(spark, d), ["region"], "nation", "quarter", "total", "treated", [1997 * 4, 1999 * 4 + 2])
    out = refits.control_effects(fits, ["region"], "treated")
    return out.select("region", "break_year", "n_before", "n_after", r4(F.col("gap")).alias("gap"), r4(F.col("ratio")).alias("ratio"), "rank", "n_units", "p", "n_left_out", r4(F.col("did")).alias("did"), "fired", "reason")


def fake_break_placebos(spark, d):
    """The step of monthly totals in 1999 against fake ones in the years before."""
    out = refits.fake_breaks(_months(spark, d), "series", "t", "total", [(1999 * 12, 1997 * 12), (1999 * 12, 1995 * 12 + 1)], log=True)
    return out.select("series", "break_year", "fake_year", r4(F.col("coef")).alias("coef"), r4(F.col("fake_coef")).alias("fake_coef"), "repeats", "reason")


def panel_effects(spark, d):
    """The effect on each region's first nation at two breaks, beside effects of nations and quarters, in logs."""
    fits = refits.control_fits(_panel(spark, d), ["region"], "nation", "quarter", "total", "treated", [1997 * 4, 1999 * 4 + 2])
    return fits.where("target = 'treated' AND left_out IS NULL").select("region", F.col("break_year").alias("break_quarter"), "n_before", "n_after", r4(F.col("did")).alias("effect"))


def fake_break_steps(spark, d):
    """The steps themselves, at real and fake breaks; null where a side has fewer than three months."""
    return fake_break_placebos(spark, d).select("series", "break_year", "fake_year", "coef", "fake_coef")


QUERIES = {f.__name__: f for f in (unit_root_tests, panel_trend_tests, synthetic_effects, panel_effects, fake_break_placebos, fake_break_steps)}

SQL = {
    "unit_root_tests": """WITH m AS (SELECT o_orderpriority AS series, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
      l AS (SELECT series, y - lag(y) OVER w AS d, lag(y) OVER w AS x FROM m WINDOW w AS (PARTITION BY series ORDER BY t)),
      r AS (SELECT series, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, count(d) AS n FROM l GROUP BY 1)
      SELECT series, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) AS t, n + 1 AS n FROM r""",
    "panel_effects": """WITH n AS (SELECT n_nationkey, n_regionkey AS region, n_name = min(n_name) OVER (PARTITION BY n_regionkey) AS treated FROM nation),
      q AS (SELECT region, n_nationkey, treated, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS t, ln(sum(o_totalprice)) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey GROUP BY ALL),
      full_q AS (SELECT q.* FROM q JOIN (SELECT region, t FROM q GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT n_nationkey) FROM q x WHERE x.region = q.region)) USING (region, t)),
      b AS (SELECT unnest([7988, 7998]) AS b)
      SELECT region, b AS break_quarter, CAST(count(DISTINCT t) FILTER (WHERE t < b) AS INTEGER) AS n_before, CAST(count(DISTINCT t) FILTER (WHERE t >= b) AS INTEGER) AS n_after,
        round(avg(y) FILTER (WHERE treated AND t >= b) - avg(y) FILTER (WHERE treated AND t < b) - (avg(y) FILTER (WHERE NOT treated AND t >= b) - avg(y) FILTER (WHERE NOT treated AND t < b)), 4) AS effect FROM full_q, b GROUP BY 1, 2""",
    "fake_break_steps": """WITH m AS (SELECT o_orderpriority AS series, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, ln(sum(o_totalprice)) AS y FROM orders GROUP BY 1, 2),
      s AS (SELECT series, b, CASE WHEN least(count(*) FILTER (WHERE t < b), count(*) FILTER (WHERE t >= b)) >= 3 THEN round(regr_intercept(y, t - b) FILTER (WHERE t >= b) - regr_intercept(y, t - b) FILTER (WHERE t < b), 4) END AS step
        FROM m, (SELECT unnest([23988, 23964, 23941]) AS b) GROUP BY 1, 2)
      SELECT x.series, x.b AS break_year, z.b AS fake_year, x.step AS coef, z.step AS fake_coef FROM s x JOIN s z ON x.series = z.series AND x.b = 23988 AND z.b <> 23988""",
}
