"""Queries on composites with substitution, thinned scenes and estimators of population."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import composites, population
from tidemark.plans._tables import part_grid, r4, table


def _scenes(spark, d):
    """Line items as observations: cells by part and supplier, years by shipping, sources by mode, scenes by month."""
    li = table(spark, d, "lineitem")
    source = F.when(F.col("l_linenumber") <= 2, "first").when(F.col("l_linenumber") <= 4, "second").otherwise("third")
    value = F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 50)
    when = F.month("l_shipdate").cast("long")
    return li.select((F.col("l_partkey") % 12).alias("row"), (F.col("l_suppkey") % 10).alias("col"), F.year("l_shipdate").cast("long").alias("year"), source.alias("source"), F.concat_ws("-", source, F.format_string("%02d", when)).alias("scene"), when.alias("month"), value.alias("ndvi"))


ORDER = ["first", "second", "third"]


def source_viability(spark, d):
    """Whether each year's sources have scenes and cells enough, and which one is taken."""
    found = composites.viability(_scenes(spark, d), ["year", "source"], "ndvi", 120, 3, 2, 0.3)
    taken = composites.chosen_sources(found, "year", "source", ORDER).select("year", F.col("source").alias("taken"), "substituted")
    return found.join(taken, "year").select("year", "source", "n_scenes", r4(F.col("share")).alias("share"), "viable", "taken", "substituted")


def composite_with_substitution(spark, d):
    """The median of each cell and year from the first source that saw it often enough."""
    out = composites.substituted_composite(_scenes(spark, d), "year", "source", ["ndvi"], ORDER, 3)
    return out.select("row", "col", "year", "source", "n_seen", r4(F.col("ndvi")).alias("ndvi"))


def capacity_experiment(spark, d):
    """The area above a threshold when a year is built from all, six or two months."""
    median = lambda s, keys: s.groupBy(*keys, "row", "col").agg(F.median("ndvi").alias("ndvi"))
    out = composites.capacity_experiment(_scenes(spark, d).where("source = 'first'"), ["year"], "scene", "month", {"all": None, "six": 6, "two": 2}, median, lambda m, _: F.col("ndvi") > 0.5, 0.0009, "all")
    return out.select("scenario", "year", "cells", r4(F.col("km2")).alias("km2"), r4(F.col("valid_share")).alias("valid_share"), r4(F.col("change_pct")).alias("change_pct"))


def _clusters(spark, d):
    g = part_grid(spark, d)
    k = F.col("row") * 45 + F.col("col")
    return g.select(F.floor(F.col("col") / 15).alias("cluster"), (F.col("row") % 4).alias("fold"), (F.col("p_retailprice") - 1000).alias("people"), (F.greatest(k % 23 - 9, F.lit(0)) / 13.0).alias("share"), (k % 17 / 16.0).alias("other"), F.col("p_size").cast("double").alias("weight"))


def population_estimators(spark, d):
    """Five estimators of each cluster's total with floor, ceiling and deviation from the plain one as long rows."""
    own = population.estimators(_clusters(spark, d), ["cluster"], "people", "share", "other")
    seen = _clusters(spark, d).where("cluster = 1").groupBy("cluster").agg((F.sum(F.greatest("people", F.lit(0.0))) * 0.9).alias("observed"))
    rows = population.sensitivity_rows(own, population.deviations(own, seen, ["cluster"], "observed"), ["cluster"])
    return rows.select("cluster", "kind", "name", r4(F.col("value")).alias("value"))


def held_out_folds(spark, d):
    """Each fold of a cluster from the rate of its other folds."""
    out = population.left_out(_clusters(spark, d), ["cluster"], "fold", "people", "weight")
    return out.select("cluster", "fold", *[r4(F.col(c)).alias(c) for c in ("observed", "predicted", "deviation_pct")])


QUERIES = {f.__name__: f for f in (source_viability, composite_with_substitution, capacity_experiment, population_estimators, held_out_folds)}

_SCENES = """scenes AS (SELECT l_partkey % 12 AS row, l_suppkey % 10 AS col, year(l_shipdate) AS year, CASE WHEN l_linenumber <= 2 THEN 'first' WHEN l_linenumber <= 4 THEN 'second' ELSE 'third' END AS source,
    month(l_shipdate) AS month, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50 END AS ndvi FROM lineitem)"""
_CLUSTERS = """c AS (SELECT p_partkey % 45 // 15 AS cluster, p_partkey // 45 % 4 AS fold, p_retailprice - 1000 AS people, greatest(p_partkey % 23 - 9, 0) / 13.0::DOUBLE AS share, p_partkey % 17 / 16.0::DOUBLE AS other, p_size::DOUBLE AS weight FROM part)"""

SQL = {
    "source_viability": f"""WITH {_SCENES}, cells AS (SELECT year, source, row, col, count(ndvi) AS seen FROM scenes GROUP BY ALL), s AS (SELECT year, source, count(*) FILTER (WHERE seen >= 2) / 120 AS share FROM cells GROUP BY ALL),
      n AS (SELECT year, source, count(DISTINCT month) AS n_scenes FROM scenes GROUP BY ALL), v AS (SELECT *, n_scenes >= 3 AND share >= 0.3 AS viable FROM n JOIN s USING (year, source)),
      t AS (SELECT year, min(source) FILTER (WHERE viable) AS taken FROM v GROUP BY 1)
      SELECT year, source, n_scenes, round(share, 4) AS share, viable, taken, taken <> 'first' AS substituted FROM v JOIN t USING (year)""",
    "composite_with_substitution": f"""WITH {_SCENES}, p AS (SELECT row, col, year, source, count(ndvi) AS n, median(ndvi) AS m FROM scenes GROUP BY ALL),
      b AS (SELECT row, col, year, arg_min({{'s': source, 'n': n, 'm': m}}, source) FILTER (WHERE n >= 3) AS b FROM p GROUP BY ALL)
      SELECT row, col, year, b.s AS source, coalesce(b.n, 0) AS n_seen, round(b.m, 4) AS ndvi FROM b""",
    "capacity_experiment": f"""WITH {_SCENES}, first AS (SELECT * FROM scenes WHERE source = 'first'), months AS (SELECT year, month, row_number() OVER (PARTITION BY year ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY year) AS n FROM (SELECT DISTINCT year, month FROM first)),
      cases(scenario, most) AS (VALUES ('all', NULL), ('six', 6), ('two', 2)), places AS (SELECT scenario, most, unnest(range(most)) AS k FROM cases WHERE most IS NOT NULL),
      kept AS (SELECT scenario, year, month FROM months, cases WHERE most IS NULL OR n <= most UNION ALL SELECT DISTINCT scenario, year, month FROM months JOIN places ON n > most AND floor(k * (n - 1) / greatest(most - 1, 1) + 0.5::DOUBLE) = i),
      made AS (SELECT scenario, year, row, col, median(ndvi) AS m FROM first JOIN kept USING (year, month) GROUP BY ALL),
      a AS (SELECT scenario, year, count(*) FILTER (WHERE m > 0.5) AS cells, count(*) FILTER (WHERE m > 0.5) * 0.0009::DOUBLE AS km2, count(m) / count(*) AS valid_share FROM made GROUP BY ALL)
      SELECT a.scenario, a.year, a.cells, round(a.km2, 4) AS km2, round(a.valid_share, 4) AS valid_share, round((a.km2 - b.km2) / nullif(b.km2, 0) * 100, 4) AS change_pct FROM a JOIN a b ON a.year = b.year AND b.scenario = 'all'""",
    "population_estimators": f"""WITH {_CLUSTERS}, v AS (SELECT cluster, greatest(people, 0) AS p, share AS s, other AS o, median(share) FILTER (WHERE share > 0) OVER (PARTITION BY cluster) AS m FROM c),
      e AS (SELECT cluster, sum(p * s) AS own_share, sum(p * o) AS other_share, coalesce(sum(p) FILTER (WHERE s > 0), 0) AS any_built, coalesce(sum(p) FILTER (WHERE s > 0 AND s >= m), 0) AS median_built, sum(p) AS whole FROM v GROUP BY 1),
      l AS (SELECT cluster, 'estimate' AS kind, name, value FROM (UNPIVOT e ON own_share, other_share, any_built, median_built, whole INTO NAME name VALUE value)),
      f AS (SELECT cluster, min(value) AS low FROM l WHERE name <> 'whole' GROUP BY 1),
      r AS (SELECT * FROM l UNION ALL SELECT cluster, 'bound', 'floor', low FROM f UNION ALL SELECT cluster, 'bound', 'ceiling', whole FROM e UNION ALL SELECT cluster, 'bound', 'spread_pct', (whole - low) / nullif(low, 0) * 100 FROM e JOIN f USING (cluster)
        UNION ALL SELECT l.cluster, 'deviation_pct', name, (value - whole * 0.9::DOUBLE) / (whole * 0.9::DOUBLE) * 100 FROM l JOIN e USING (cluster) WHERE l.cluster = 1)
      SELECT cluster, kind, name, round(value, 4) AS value FROM r""",
    "held_out_folds": f"""WITH {_CLUSTERS}, s AS (SELECT cluster, fold, sum(people) AS observed, sum(weight) AS w FROM c GROUP BY ALL), t AS (SELECT cluster, sum(observed) AS a, sum(w) AS aw FROM s GROUP BY 1),
      p AS (SELECT *, w * (a - observed) / (aw - w) AS predicted FROM s JOIN t USING (cluster))
      SELECT cluster, fold, round(observed, 4) AS observed, round(predicted, 4) AS predicted, round((predicted - observed) / observed * 100, 4) AS deviation_pct FROM p""",
}
