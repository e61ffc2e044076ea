"""Queries on agreement, contracts, allocation, markers, extraction and small-sample estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import words
from tidemark.operators import agreement, causal, contracts, markers, population, series, timeline, verdicts
from tidemark.plans._tables import NATION_YEARS, nation_years, r4, table, year_of
from tidemark.sources import html


def jaccard_at_cuts(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 250000).alias("seen"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("score"))
    out = agreement.jaccard_at_cuts(a, b, ["k"], "seen", "score", [50.0, 100.0, 150.0])
    return out.select("cut", "shared", "only_a", "only_b", *[r4(F.col(c)).alias(c) for c in ("jaccard", "recall", "area_error")])


def stratified_accuracy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 800).alias("mapped"))
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") > 0).alias("truth"))
    sizes = docs.groupBy("lang").agg(F.count("*").cast("double").alias("weight"))
    sample = contracts.resolved(labels, docs, ["doc_id"]).join(sizes, "lang")
    out = agreement.stratified_accuracy(sample, "lang", "weight", "mapped", "truth")
    return out.select(*[r4(F.col(c)).alias(c) for c in ("overall", "se", "users", "producers", "kappa")], "n")


def confusion_matrix(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 800).alias("mapped"))
    return agreement.confusion(labels.join(docs, "doc_id"), "mapped", "quality")


def positional_lookup(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("rich"))
    return agreement.looked_up(o, c, ["o_custkey"], "rich", F.lit(False)).groupBy("rich").agg(F.count("*").alias("n"))


def key_conflict_detection(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    other = n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit("x"))).otherwise(F.col("n_name")).alias("n_name"))
    return contracts.key_conflicts(n.unionByName(other), ["n_nationkey"], "n_name")


def orphan_keys(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return contracts.orphans(c, table(spark, d, "orders").where("o_totalprice > 400000"), ["o_custkey"])


def missing_families(spark, d):
    every = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return contracts.missing(every, table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("k")))


def ragged_union(spark, d):
    out = contracts.ragged_union(table(spark, d, "region"), table(spark, d, "nation"))
    return out.select("r_name", "n_name", *[F.col(c).cast("double").alias(c) for c in ("r_regionkey", "n_nationkey", "n_regionkey")])


def name_key_join(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", words.plain_name(F.concat(F.lit("  Área  "), F.lower("n_name"))).alias("key"))
    other = table(spark, d, "nation").select(words.plain_name(F.concat(F.lit("AREA "), F.col("n_name"))).alias("key"), "n_regionkey")
    return n.join(other, "key").select("n_nationkey", "key", "n_regionkey")


def dasymetric_allocate(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = population.allocated(c, ["c_nationkey"], "c_acctbal", (F.col("c_nationkey") + 1) * F.lit(1000.0))
    return out.select("c_custkey", r4(F.col("allocated")).alias("allocated"))


def floor_ceiling_decomposition(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", (F.lit(1.0) - F.col("l_discount") - F.col("l_tax")).alias("rest"))
    out = population.floor_and_ceiling(li, ["l_returnflag"], "l_quantity", {"built": "l_discount", "farmed": "l_tax", "other": "rest"})
    return out.select("l_returnflag", "class", F.round("floor", 2).alias("floor"), F.round("ceiling", 2).alias("ceiling"))


def scenario_cross_product(spark, d):
    units = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("base"))
    out = population.scenarios(units, "base", {"low": 0.01, "mid": 0.02, "high": 0.03}, [0.0, 0.005, 0.01], [5, 15])
    return out.select("c_nationkey", "scenario", "migration", "years", F.round("projected", 2).alias("projected"))


def estimator_envelope(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("a"), F.round(F.median("c_acctbal"), 4).alias("b"), F.round((F.min("c_acctbal") + F.max("c_acctbal")) / 2, 4).alias("c"))
    return population.envelope(s, ["c_nationkey"], ["a", "b", "c"]).withColumn("spread_pct", r4(F.col("spread_pct")))


MARKERS = {
    "asia": {"table": "region", "column": "r_regionkey", "where": {"r_name": "ASIA"}},
    "top": {"table": "nation", "column": "n_nationkey", "statistic": "max", "where": {"n_regionkey": "2.0"}},
    "bottom": {"table": "nation", "column": "n_nationkey", "statistic": "min", "where_not": {"n_regionkey": 0}},
    "many": {"table": "nation", "column": "n_nationkey", "where": {"n_regionkey": 1}},
    "count": {"table": "nation", "statistic": "count", "where": {"n_regionkey": 3}},
    "gap": {"op": "difference", "a": "top", "b": "bottom"},
    "change": {"op": "change_pct", "a": "top", "b": "count"},
    "broken": {"op": "ratio", "a": "top", "b": "many"},
    "circle": {"op": "ratio", "a": "circle", "b": "top"},
}


def marker_program(spark, d):
    out = markers.resolve(spark, MARKERS, {t: table(spark, d, t) for t in ("region", "nation")})
    return out.select("marker", r4(F.col("value")).alias("value"), F.col("error"))


def _months(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("series"), year_of("o_orderdate").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.withColumn("t", F.col("year") * 12 + F.col("month"))


def ols_line_coefficients(spark, d):
    out = _months(spark, d).groupBy("series").agg(*causal.ols_line(F.col("t"), F.col("total")))
    return out.select("series", F.round("slope", 2).alias("slope"), F.round("intercept", 0).alias("intercept"))


def ols_its_coefficients(spark, d):
    out = causal.interrupted_series(_months(spark, d).select("series", F.col("t").cast("int").alias("t"), "total"), "series", "t", "total", 1998 * 12 + 6)
    return out.select("series", "term", F.round("coef", 0).alias("coef"))


def its_hac_intervals(spark, d):
    out = causal.interrupted_series(_months(spark, d).select("series", F.col("t").cast("int").alias("t"), "total"), "series", "t", "total", 1998 * 12 + 6, log=True)
    return out.select("series", "term", *[F.round(c, 5).alias(c) for c in ("coef", "se", "low", "high", "durbin_watson")], "n", F.col("lags").cast("long").alias("lags"))


def quasi_poisson_breaks(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("exposure"))
    return causal.quasi_poisson(o, "o_orderstatus", "year", "n", "exposure", 1998)


def synthetic_control_weights(spark, d):
    regions = table(spark, d, "nation").select("n_name", "n_regionkey")
    panel = nation_years(spark, d).join(regions, F.col("nation") == F.col("n_name")).groupBy(F.col("n_regionkey").alias("unit"), "year").agg(F.sum("total").alias("total"))
    return causal.synthetic_control(panel, "unit", "year", "total", 1999)


def did_coefficient(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderpriority") == "1-URGENT").alias("treated"), (F.year("o_orderdate") >= 1998).alias("after"), "o_totalprice")
    return causal.did(o, "treated", "after", "o_totalprice").withColumn("effect", F.round("effect", 2))


def log_elasticity(spark, d):
    a = nation_years(spark, d)
    b = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")), "c_nationkey").groupBy("nation", year_of("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    out = a.join(b, ["nation", "year"]).groupBy("nation").agg(*causal.ols_line(F.log("n"), F.log("total")), F.count("*").alias("points"))
    return out.where("points >= 3").select("nation", r4(F.col("slope")).alias("elasticity"), "points")


def html_headings(spark, d):
    return html.first_match(table(spark, d, "pages"), "page_id", "html", r"<h1>([^<]*)</h1>", "heading")


def html_links(spark, d):
    return html.all_matches(table(spark, d, "pages"), "page_id", "html", r'<a href="([^"]*)">', "link").groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("link").alias("n_distinct"))


def html_table_extract(spark, d):
    # The pages' lists of links as tables of two columns.
    listed = F.regexp_replace(F.regexp_replace("html", "<ul>", "<table>"), "</ul>", "</table>")
    rows = F.regexp_replace(listed, '<li><a href="([^"]*)">([^<]*)</a></li>', "<tr><th>$1</th><td>$2</td></tr>")
    return html.table_cells(table(spark, d, "pages").select("page_id", rows.alias("html")), "page_id", "html")


def placebo_verdicts(spark, d):
    b = nation_years(spark, d).groupBy("nation").agg(F.regr_slope("total", "year").alias("slope"), F.count("*").alias("n"))
    real = b.where(F.col("nation") == "NATION_3").agg(F.max("slope").alias("real"))
    rows = b.where(F.col("nation") != "NATION_3").crossJoin(F.broadcast(real))  # one row
    again = F.when(F.col("n") >= 3, (F.signum("slope") == F.signum("real")) & (F.abs("slope") >= 0.5 * F.abs("real")))
    return verdicts.placebo_verdict(rows.select(F.substring("nation", 1, 8).alias("block"), again.alias("again")), ["block"], "again")


def sign_agreement(spark, d):
    a = series.changes(nation_years(spark, d), ["nation"], "year", "total").select("nation", "year", F.col("change").alias("a"))
    o = table(spark, d, "orders").groupBy(year_of("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("all", F.lit("all"))
    b = series.changes(o, ["all"], "year", "total").select("year", F.col("change").alias("b"))
    out = verdicts.sign_agreement(a.join(b, "year"), ["nation"], "a", "b")
    return out.select("nation", "agree", "n", r4(F.col("share")).alias("share"))


def filled_counts(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_size").cast("int").alias("size"))
    return timeline.filled_counts(p, ["p_brand"], "size", 1, 50)


def numbered_slugs(spark, d):
    p = table(spark, d, "part").select("p_partkey", words.slug(F.col("p_name")).alias("name"))
    return timeline.numbered(p, "name", "p_partkey").select("p_partkey", "slug")


def milestone_faults(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 397).alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("start"), F.when(F.col("event_id") % 3 == 0, "2023-12").when(F.col("event_id") % 3 == 1, "soon").alias("end"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 5 > 0, "x").alias("source"))
    return timeline.milestone_faults(e, ["click", "view", "purchase"])


QUERIES = {f.__name__: f for f in (jaccard_at_cuts, stratified_accuracy, confusion_matrix, positional_lookup, key_conflict_detection, orphan_keys, missing_families, ragged_union, name_key_join, dasymetric_allocate, floor_ceiling_decomposition, scenario_cross_product, estimator_envelope, marker_program, ols_line_coefficients, ols_its_coefficients, its_hac_intervals, quasi_poisson_breaks, synthetic_control_weights, did_coefficient, log_elasticity, html_headings, html_links, html_table_extract, placebo_verdicts, sign_agreement, filled_counts, numbered_slugs, milestone_faults)}

_MONTHS = """months AS (SELECT o_orderstatus AS series, year(o_orderdate) * 12 + month(o_orderdate) AS t, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"""

SQL = {
    "jaccard_at_cuts": """WITH b AS (SELECT l_orderkey AS k, sum(l_quantity) AS score FROM lineitem GROUP BY 1), j AS (SELECT coalesce(o_totalprice > 250000, false) AS a, score FROM orders FULL JOIN b ON o_orderkey = k),
      r AS (SELECT cut, a, coalesce(score >= cut, false) AS h FROM j, (VALUES (50.0::DOUBLE), (100.0), (150.0)) c(cut)),
      n AS (SELECT cut, count(*) FILTER (WHERE a AND h) AS shared, count(*) FILTER (WHERE a AND NOT h) AS only_a, count(*) FILTER (WHERE h AND NOT a) AS only_b FROM r GROUP BY 1)
      SELECT *, round(shared / (shared + only_a + only_b), 4) AS jaccard, round(shared / (shared + only_b), 4) AS recall, round((only_a - only_b) / (shared + only_b), 4) AS area_error FROM n""",
    "stratified_accuracy": """WITH s AS (SELECT lang, n_chars > 800 AS m, quality > 0 AS t FROM labels JOIN documents USING (doc_id)), w AS (SELECT lang, count(*)::DOUBLE AS w FROM documents GROUP BY 1),
      g AS (SELECT lang, max(w) AS w, count(*) AS n, avg((m = t)::INT) AS r, var_samp((m = t)::INT) AS v, avg((m AND t)::INT) AS tp, avg(m::INT) AS pm, avg(t::INT) AS pt FROM s JOIN w USING (lang) GROUP BY 1),
      z AS (SELECT * REPLACE (w / sum(w) OVER () AS w) FROM g),
      q AS (SELECT sum(w * r) AS o, sqrt(sum(w * w * v / n) FILTER (WHERE n > 1)) AS se, sum(w * tp) / sum(w * pm) AS u, sum(w * tp) / sum(w * pt) AS p, sum(w * pm) AS a, sum(w * pt) AS b, CAST(sum(n) AS BIGINT) AS n FROM z)
      SELECT round(o, 4) AS overall, round(se, 4) AS se, round(u, 4) AS users, round(p, 4) AS producers, round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 4) AS kappa, n FROM q""",
    "confusion_matrix": """SELECT n_chars > 800 AS mapped, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""",
    "positional_lookup": """SELECT coalesce(c_acctbal > 5000, false) AS rich, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "key_conflict_detection": """WITH u AS (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_name || 'x' ELSE n_name END FROM nation)
      SELECT n_nationkey, count(DISTINCT n_name) AS n_values, count(*) AS n_rows FROM u GROUP BY 1 HAVING count(DISTINCT n_name) > 1""",
    "orphan_keys": """SELECT c_custkey AS o_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey""",
    "missing_families": """SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000""",
    "ragged_union": """SELECT r_name, n_name, r_regionkey::DOUBLE AS r_regionkey, n_nationkey::DOUBLE AS n_nationkey, n_regionkey::DOUBLE AS n_regionkey FROM (SELECT * FROM region UNION ALL BY NAME SELECT * FROM nation)""",
    "name_key_join": """SELECT n_nationkey, 'area ' || lower(n_name) AS key, n_regionkey FROM nation""",
    "dasymetric_allocate": """SELECT c_custkey, round(greatest(coalesce(c_acctbal, 0), 0) / nullif(sum(greatest(coalesce(c_acctbal, 0), 0)) OVER (PARTITION BY c_nationkey), 0) * ((c_nationkey + 1) * 1000.0::DOUBLE), 4) AS allocated FROM customer""",
    "floor_ceiling_decomposition": """WITH x AS (SELECT l_returnflag, l_quantity AS q, l_discount AS a, l_tax AS b, 1.0::DOUBLE - l_discount - l_tax AS c FROM lineitem)
      SELECT l_returnflag, 'built' AS "class", round(sum(q * a), 2) AS floor, round(sum(CASE WHEN a > 0 THEN q ELSE 0 END), 2) AS ceiling FROM x GROUP BY 1
      UNION ALL SELECT l_returnflag, 'farmed', round(sum(q * b), 2), round(sum(CASE WHEN NOT a > 0 AND b > 0 THEN q ELSE 0 END), 2) FROM x GROUP BY 1
      UNION ALL SELECT l_returnflag, 'other', round(sum(q * c), 2), round(sum(CASE WHEN NOT a > 0 AND NOT b > 0 AND c > 0 THEN q ELSE 0 END), 2) FROM x GROUP BY 1""",
    "scenario_cross_product": """WITH u AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS base FROM customer GROUP BY 1)
      SELECT c_nationkey, scenario, migration, CAST(years AS BIGINT) AS years, round(base * pow(1 + rate + migration, years), 2) AS projected
      FROM u, (VALUES ('low', 0.01::DOUBLE), ('mid', 0.02), ('high', 0.03)) s(scenario, rate), (VALUES (0.0::DOUBLE), (0.005), (0.01)) m(migration), (VALUES (5), (15)) y(years)""",
    "estimator_envelope": """WITH s AS (SELECT c_nationkey, round(avg(c_acctbal), 4) AS a, round(median(c_acctbal), 4) AS b, round((min(c_acctbal) + max(c_acctbal)) / 2, 4) AS c FROM customer GROUP BY 1)
      SELECT c_nationkey, least(a, b, c) AS low, greatest(a, b, c) AS high, round((greatest(a, b, c) - least(a, b, c)) / least(a, b, c) * 100, 4) AS spread_pct FROM s""",
    "marker_program": """WITH v AS (SELECT
        (SELECT max(r_regionkey) FROM region WHERE r_name = 'ASIA')::DOUBLE AS asia, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 2)::DOUBLE AS top,
        (SELECT min(n_nationkey) FROM nation WHERE n_regionkey <> 0)::DOUBLE AS bottom, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS m, (SELECT count(*) FROM nation WHERE n_regionkey = 3)::DOUBLE AS c)
      SELECT 'asia' AS marker, round(asia, 4) AS value, NULL::VARCHAR AS error FROM v UNION ALL SELECT 'top', round(top, 4), NULL FROM v UNION ALL SELECT 'bottom', round(bottom, 4), NULL FROM v
      UNION ALL SELECT 'many', NULL, m || ' rows instead of 1' FROM v UNION ALL SELECT 'count', c, NULL FROM v UNION ALL SELECT 'gap', round(top - bottom, 4), NULL FROM v
      UNION ALL SELECT 'change', round(100 * (top - c) / c, 4), NULL FROM v UNION ALL SELECT 'broken', NULL, m || ' rows instead of 1' FROM v UNION ALL SELECT 'circle', NULL, 'circular'""",
    "ols_line_coefficients": f"""WITH {_MONTHS} SELECT series, round(regr_slope(total, t), 2) AS slope, round(regr_intercept(total, t), 0) AS intercept FROM months GROUP BY 1""",
    # The four terms are the two lines before and after the break.
    "ols_its_coefficients": f"""WITH {_MONTHS}, c AS (SELECT *, t - min(t) OVER (PARTITION BY series) AS u, {1998 * 12 + 6} - min(t) OVER (PARTITION BY series) AS b FROM months),
      l AS (SELECT series, max(b) AS b, regr_intercept(total, u) FILTER (WHERE u < b) AS a0, regr_slope(total, u) FILTER (WHERE u < b) AS s0,
        regr_intercept(total, u) FILTER (WHERE u >= b) AS a1, regr_slope(total, u) FILTER (WHERE u >= b) AS s1 FROM c GROUP BY 1)
      SELECT series, 'level' AS term, round(a0 + s0 * b, 0) AS coef FROM l UNION ALL SELECT series, 'trend', round(s0, 0) FROM l
      UNION ALL SELECT series, 'step', round(a1 + s1 * b - a0 - s0 * b, 0) FROM l UNION ALL SELECT series, 'slope_change', round(s1 - s0, 0) FROM l""",
    # Each coefficient is a sum of weights times values; its variance sums the products of weighted residuals at each lag.
    "its_hac_intervals": f"""WITH {_MONTHS}, m AS (SELECT series, t, ln(total) AS y, t - {1998 * 12 + 6} AS u, t >= {1998 * 12 + 6} AS d, row_number() OVER (PARTITION BY series ORDER BY t) AS i,
        count(*) OVER (PARTITION BY series) AS n FROM months),
      s AS (SELECT *, avg(u) OVER p AS mu, count(*) OVER p AS k, sum(u * u) OVER p - count(*) OVER p * avg(u) OVER p * avg(u) OVER p AS q, regr_slope(y, u) OVER p AS b, regr_intercept(y, u) OVER p AS a
        FROM m WINDOW p AS (PARTITION BY series, d)),
      c AS (SELECT series, i, n, y, y - a - b * u AS e, d, (u - mu) / q AS ws, 1.0::DOUBLE / k - mu * (u - mu) / q AS wl FROM s),
      w AS (SELECT series, i, n, y, e, 'level' AS term, CASE WHEN d THEN 0 ELSE wl END AS w FROM c UNION ALL SELECT series, i, n, y, e, 'trend', CASE WHEN d THEN 0 ELSE ws END FROM c
        UNION ALL SELECT series, i, n, y, e, 'step', CASE WHEN d THEN wl ELSE -wl END FROM c UNION ALL SELECT series, i, n, y, e, 'slope_change', CASE WHEN d THEN ws ELSE -ws END FROM c),
      g AS (SELECT *, CAST(floor(4 * pow(n / 100.0, 2.0 / 9)) AS BIGINT) AS lags FROM w),
      v AS (SELECT x.series, x.term, sum(CASE WHEN x.i = z.i THEN 1 ELSE 2 * (1 - (x.i - z.i) / (x.lags + 1.0::DOUBLE)) END * x.w * x.e * z.w * z.e) AS var
        FROM g x JOIN g z ON x.series = z.series AND x.term = z.term AND z.i BETWEEN x.i - x.lags AND x.i GROUP BY 1, 2),
      o AS (SELECT series, term, sum(w * y) AS coef, max(n) AS n, max(lags) AS lags FROM g GROUP BY 1, 2),
      r AS (SELECT series, sum(pow(e - f, 2)) / sum(e * e) AS dw FROM (SELECT series, e, lag(e) OVER (PARTITION BY series ORDER BY i) AS f FROM c) GROUP BY 1)
      SELECT series, term, round(coef, 5) AS coef, round(sqrt(var), 5) AS se, round(coef - 1.959963984540054::DOUBLE * sqrt(var), 5) AS low, round(coef + 1.959963984540054::DOUBLE * sqrt(var), 5) AS high,
        round(dw, 5) AS durbin_watson, n, lags FROM o JOIN v USING (series, term) JOIN r USING (series)""",
    "did_coefficient": """WITH m AS (SELECT o_orderpriority = '1-URGENT' AS t, year(o_orderdate) >= 1998 AS a, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
      SELECT round(max(v) FILTER (WHERE t AND a) - max(v) FILTER (WHERE t AND NOT a) - (max(v) FILTER (WHERE NOT t AND a) - max(v) FILTER (WHERE NOT t AND NOT a)), 2) AS effect FROM m""",
    "log_elasticity": f"""WITH {NATION_YEARS}, n AS (SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
      SELECT nation, round(regr_slope(ln(total), ln(n)), 4) AS elasticity, count(*) AS points FROM nation_years JOIN n USING (nation, year) GROUP BY 1 HAVING count(*) >= 3""",
    "html_headings": """SELECT page_id, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading FROM pages""",
    "html_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS link FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM l GROUP BY 1""",
    "html_table_extract": """WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '<ul>.*?</ul>', 0, 's')) AS block, unnest(range(len(regexp_extract_all(html, '<ul>.*?</ul>', 0, 's')))) AS "table" FROM pages),
      l AS (SELECT page_id, "table", unnest(regexp_extract_all(block, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) AS a, unnest(regexp_extract_all(block, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS b,
        unnest(range(len(regexp_extract_all(block, '<li><a href="[^"]*">[^<]*</a></li>')))) AS row FROM u)
      SELECT page_id, "table", row, 0::BIGINT AS col, true AS head, trim(replace(a, '&amp;', '&')) AS cell FROM l UNION ALL SELECT page_id, "table", row, 1, false, trim(replace(b, '&amp;', '&')) FROM l""",
    "placebo_verdicts": f"""WITH {NATION_YEARS}, b AS (SELECT nation, regr_slope(total, year) AS slope, count(*) AS n FROM nation_years GROUP BY 1), r AS (SELECT max(slope) AS v FROM b WHERE nation = 'NATION_3'),
      x AS (SELECT substr(nation, 1, 8) AS block, CASE WHEN n >= 3 THEN sign(slope) = sign(v) AND abs(slope) >= 0.5 * abs(v) END AS again FROM b, r WHERE nation <> 'NATION_3'),
      c AS (SELECT block, count(again) AS n, count(*) FILTER (WHERE again) AS repeated FROM x GROUP BY 1)
      SELECT *, CASE WHEN n = 0 THEN 'not estimable' WHEN repeated >= 2 THEN 'fail' ELSE 'pass' END AS verdict,
        CASE WHEN n = 0 THEN 'no placebo could be estimated' ELSE repeated || ' of ' || n || ' placebos repeat the effect' END AS reason FROM c""",
    "sign_agreement": f"""WITH {NATION_YEARS}, a AS (SELECT nation, year, total - lag(total) OVER (PARTITION BY nation ORDER BY year) AS a FROM nation_years),
      o AS (SELECT year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1), b AS (SELECT year, t - lag(t) OVER (ORDER BY year) AS b FROM o)
      SELECT nation, count(*) FILTER (WHERE sign(a) = sign(b)) AS agree, count(*) AS n, round(count(*) FILTER (WHERE sign(a) = sign(b)) / count(*), 4) AS share FROM a JOIN b USING (year) WHERE a <> 0 AND b <> 0 GROUP BY 1""",
    "filled_counts": """WITH s AS (SELECT CAST(unnest(range(1, 51)) AS INT) AS size), b AS (SELECT DISTINCT p_brand FROM part)
      SELECT b.p_brand, s.size, count(p.p_partkey) AS n FROM b CROSS JOIN s LEFT JOIN part p ON p.p_brand = b.p_brand AND p.p_size = s.size GROUP BY 1, 2""",
    "numbered_slugs": """WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS name FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS k FROM n)
      SELECT p_partkey, CASE WHEN k > 0 THEN name || '-' || k ELSE name END AS slug FROM k""",
    "milestone_faults": """WITH e AS (SELECT event_id % 397 AS id, event_id AS k, event_type AS kind FROM events)
      SELECT id, 'end' AS fault FROM e WHERE k % 3 = 1 UNION ALL SELECT id, 'end before start' FROM e WHERE k % 3 = 0 UNION ALL SELECT id, 'kind' FROM e WHERE kind NOT IN ('click', 'view', 'purchase')
      UNION ALL SELECT id, 'source' FROM e WHERE k % 5 = 0 UNION ALL SELECT id, 'id' FROM e GROUP BY id HAVING count(*) > 1""",
}
