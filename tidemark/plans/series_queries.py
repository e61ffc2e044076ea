"""Queries on annual series, flags, ranks and rules over years."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import flags, ranks, series, temporal
from tidemark.plans._tables import NATION_YEARS, USER_DAYS, nation_years, r4, table, user_days, year_of


def cagr_pairwise_by_nation(spark, d):
    return series.pairwise_growth(nation_years(spark, d), ["nation"], "year", "total").withColumn("growth", r4(F.col("growth")))


def cagr_full_span(spark, d):
    return series.span_growth(nation_years(spark, d), ["nation"], "year", "total").withColumn("growth", r4(F.col("growth")))


def index_base_100(spark, d):
    out = series.index_base(nation_years(spark, d), ["nation"], "year", "total")
    return out.select("nation", "year", r4(F.col("index")).alias("index"))


def pre_period_relative(spark, d):
    return series.against_pre_period(nation_years(spark, d), ["nation"], "year", "total", 1998).select("nation", "year", r4(F.col("relative")).alias("relative"))


def successive_signs(spark, d):
    out = series.changes(nation_years(spark, d), ["nation"], "year", "total")
    return out.select("nation", "year", F.round("change", 2).alias("change"), F.col("sign").cast("double").alias("sign"))


def worst_flag_rollup(spark, d):
    kind = F.when(F.col("event_type") == "error", "modelled").when(F.col("event_type") == "purchase", "interpolated").otherwise("observed")
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("day"), kind.alias("flag"))
    return e.groupBy("user_id", "day").agg(flags.worst("flag").alias("worst"), flags.joined("flag").alias("flags"))


def ecdf_avg_rank(spark, d):
    out = ranks.average_rank(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")
    return out.select("p_partkey", "p_brand", r4(F.col("rank")).alias("rank"), r4(F.col("ecdf")).alias("ecdf"))


def theil_sen_by_priority(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), year_of("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return ranks.theil_sen(o, ["priority"], "year", "total").withColumn("slope", F.round("slope", 2))


def quantile_class_partition(spark, d):
    p = ranks.with_cuts(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), {"high": ("p_retailprice", 0.8), "low": ("p_retailprice", 0.3), "large": ("p_size", 0.9)})
    label = F.when(F.col("p_size") > F.col("large"), "industrial").when(F.col("p_retailprice") >= F.col("high"), "dense").when(F.col("p_retailprice") <= F.col("low"), "sparse").otherwise("middle")
    return p.groupBy(label.alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


def three_signal_vote(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").join(li, "s_suppkey")
    c = ranks.with_cuts(s, {"q": ("qty", 0.7), "dd": ("disc", 0.7), "a": ("s_acctbal", 0.7)})
    signals = {"qty": F.col("qty") >= F.col("q"), "disc": F.col("disc") >= F.col("dd"), "balance": F.col("s_acctbal") >= F.col("a")}
    return c.withColumn("agreed", ranks.concordance(signals, 2)).groupBy("s_nationkey").agg(F.count_if("agreed").alias("n_agreed"), F.count("*").alias("n"))


def sensitivity_variants(spark, d):
    variants = {"base": 0.8, "minus": 0.7, "plus": 0.9}
    p = ranks.with_cuts(table(spark, d, "part").select("p_retailprice", "p_size"), {k: ("p_retailprice", q) for k, q in variants.items()})
    sums = p.agg(*[F.sum(F.when(F.col("p_retailprice") >= F.col(k), F.col("p_size"))).cast("double").alias(k) for k in variants])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(k).alias("area")) for k in variants])).alias("r")).select("r.*")
    return ranks.variant_ratio(rows, "base", "area").withColumn("largest", r4(F.col("largest")))


def confirm_then_persist(spark, d):
    return temporal.confirm_then_persist(user_days(spark, d), ["user_id"], "day", "seen")


def cumulative_since_licence(spark, d):
    rows = user_days(spark, d).withColumn("licence", (F.col("user_id") % 3).cast("long"))
    return temporal.cumulative(rows, ["user_id"], "day", "seen", "licence").select("user_id", "day", "ever")


def stock_sustained_inherited(spark, d):
    rows = temporal.confirm_then_persist(user_days(spark, d), ["user_id"], "day", "seen")
    return temporal.stock(rows, "day", "seen", "confirmed", "persistent").withColumn("change", F.col("change").cast("double"))


def churn_between_periods(spark, d):
    rows = user_days(spark, d).where("seen")
    out = temporal.churn(rows, ["user_id"], "day", [(k, k + 1) for k in range(5)])
    return out.withColumn("churn", r4(F.col("churn"))).withColumn("jaccard", r4(F.col("jaccard")))


def lost_class_destination(spark, d):
    e = table(spark, d, "events")
    by = lambda lo, hi: e.where(F.dayofmonth("ts").between(lo, hi)).groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("label"))
    return temporal.lost_destination(by(1, 15), by(16, 31), ["user_id"], "label", "purchase")


def longest_flag_run(spark, d):
    return series.longest_run(user_days(spark, d), ["user_id"], "day", "seen").select("user_id", F.col("longest").cast("long").alias("longest"))


def pivot_panel(spark, d):
    o = table(spark, d, "orders").groupBy(year_of("o_orderdate").alias("year"), "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return series.pivoted(o, "year", "o_orderstatus", "total", ["F", "O", "P"])


def permutation_rank(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey")).agg(F.round(F.stddev_samp("l_quantity") / F.avg("l_quantity"), 4).alias("ratio"))
    out = series.placebo_ranks(li, "ratio")
    return out.select("l_suppkey", "ratio", F.col("place").cast("long").alias("place"), r4(F.col("p")).alias("p"))


def forward_fill_sections(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("lang")).alias("section"))
    return series.forward_filled(x, ["source"], ["doc_id"], "section").select("doc_id", "source", "section")


def latest_wins_merge(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return series.latest_wins(o, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "P")


def uniform_thinning(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return series.thinned(o, ["o_custkey"], "o_orderkey", 4)


QUERIES = {f.__name__: f for f in (cagr_pairwise_by_nation, cagr_full_span, index_base_100, pre_period_relative, successive_signs, worst_flag_rollup, ecdf_avg_rank, theil_sen_by_priority, quantile_class_partition, three_signal_vote, sensitivity_variants, confirm_then_persist, cumulative_since_licence, stock_sustained_inherited, churn_between_periods, lost_class_destination, longest_flag_run, pivot_panel, permutation_rank, forward_fill_sections, latest_wins_merge, uniform_thinning)}

_CONFIRMED = f"""WITH {USER_DAYS}, paired AS (
  SELECT *, seen AND coalesce(lead(seen) OVER (PARTITION BY user_id ORDER BY day), true) AS pair FROM user_days
), ruled AS (
  SELECT user_id, day, seen, bool_or(pair) OVER w AS persistent, seen AND bool_or(pair) OVER w AS confirmed
  FROM paired WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)
)"""

SQL = {
    "cagr_pairwise_by_nation": f"""WITH {NATION_YEARS}, l AS (
      SELECT nation, year, total, lag(year) OVER w AS first_year, lag(total) OVER w AS v0 FROM nation_years WINDOW w AS (PARTITION BY nation ORDER BY year))
      SELECT nation, first_year, year AS last_year, round(pow(total / v0, 1.0 / (year - first_year)) - 1, 4) AS growth FROM l WHERE first_year IS NOT NULL""",
    "cagr_full_span": f"""WITH {NATION_YEARS} SELECT nation, min(year) AS first_year, max(year) AS last_year,
      round(pow(arg_max(total, year) / arg_min(total, year), 1.0 / nullif(max(year) - min(year), 0)) - 1, 4) AS growth FROM nation_years GROUP BY nation""",
    "index_base_100": f"""WITH {NATION_YEARS} SELECT nation, year, round(total / first_value(total) OVER (PARTITION BY nation ORDER BY year) * 100, 4) AS "index" FROM nation_years""",
    "pre_period_relative": f"""WITH {NATION_YEARS} SELECT nation, year, round(total / avg(total) FILTER (WHERE year < 1998) OVER (PARTITION BY nation), 4) AS relative FROM nation_years""",
    "successive_signs": f"""WITH {NATION_YEARS}, c AS (SELECT nation, year, total - lag(total) OVER (PARTITION BY nation ORDER BY year) AS x FROM nation_years)
      SELECT nation, year, round(x, 2) AS change, CAST(sign(x) AS DOUBLE) AS sign FROM c""",
    "worst_flag_rollup": """WITH e AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS day, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS k FROM events)
      SELECT user_id, day, ['observed', 'interpolated', 'modelled'][max(k) + 1] AS worst,
        array_to_string(list_transform(list_sort(list(DISTINCT k)), lambda i: ['observed', 'interpolated', 'modelled'][i + 1]), '+') AS flags FROM e GROUP BY 1, 2""",
    "ecdf_avg_rank": """SELECT p_partkey, p_brand, round(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0, 4) AS rank,
      round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 4) AS ecdf FROM part""",
    "theil_sen_by_priority": """WITH o AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1, 2)
      SELECT a.priority, round(median((b.t - a.t) / (b.y - a.y)), 2) AS slope FROM o a JOIN o b ON a.priority = b.priority AND b.y > a.y GROUP BY 1""",
    "quantile_class_partition": """WITH q AS (SELECT quantile_cont(p_retailprice, 0.8) AS high, quantile_cont(p_retailprice, 0.3) AS low, quantile_cont(p_size, 0.9) AS large FROM part)
      SELECT CASE WHEN p_size > large THEN 'industrial' WHEN p_retailprice >= high THEN 'dense' WHEN p_retailprice <= low THEN 'sparse' ELSE 'middle' END AS "class",
        count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part, q GROUP BY 1""",
    "three_signal_vote": """WITH li AS (SELECT l_suppkey, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1),
      s AS (SELECT * FROM supplier JOIN li ON s_suppkey = l_suppkey),
      c AS (SELECT quantile_cont(qty, 0.7) AS q, quantile_cont(disc, 0.7) AS dd, quantile_cont(s_acctbal, 0.7) AS a FROM s)
      SELECT s_nationkey, count(*) FILTER (WHERE (qty >= q)::INT + (disc >= dd)::INT + (s_acctbal >= a)::INT >= 2) AS n_agreed, count(*) AS n FROM s, c GROUP BY 1""",
    "sensitivity_variants": """WITH v(variant, q) AS (VALUES ('base', 0.8), ('minus', 0.7), ('plus', 0.9)),
      c AS (SELECT quantile_cont(p_retailprice, 0.8) AS b, quantile_cont(p_retailprice, 0.7) AS m, quantile_cont(p_retailprice, 0.9) AS p FROM part),
      a AS (SELECT variant, CAST(sum(p_size) FILTER (WHERE p_retailprice >= CASE variant WHEN 'base' THEN b WHEN 'minus' THEN m ELSE p END) AS DOUBLE) AS area FROM part, c, v GROUP BY 1),
      r AS (SELECT max(greatest(x.area / y.area, y.area / x.area)) AS largest FROM a x, a y WHERE y.variant = 'base' AND x.variant <> 'base')
      SELECT round(largest, 4) AS largest, CASE WHEN largest IS NULL THEN 'undefined' WHEN largest <= 2 THEN 'stable' ELSE 'sensitive' END AS regime FROM r""",
    "confirm_then_persist": _CONFIRMED + " SELECT user_id, day, seen, confirmed, persistent FROM ruled",
    "cumulative_since_licence": f"""WITH {USER_DAYS} SELECT user_id, day, bool_or(seen AND day >= user_id % 3) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS ever FROM user_days""",
    "stock_sustained_inherited": _CONFIRMED + """, s AS (SELECT day, count(*) FILTER (WHERE persistent AND seen) AS sustained, count(*) FILTER (WHERE persistent AND NOT seen) AS inherited,
      count(*) FILTER (WHERE seen AND NOT confirmed) AS rejected FROM ruled GROUP BY day)
      SELECT *, CAST(sustained + inherited - lag(sustained + inherited) OVER (ORDER BY day) AS DOUBLE) AS change FROM s""",
    "churn_between_periods": f"""WITH {USER_DAYS}, s AS (SELECT user_id, day FROM user_days WHERE seen), p AS (SELECT unnest(range(5)) AS t0),
      j AS (SELECT t0, t0 + 1 AS t1, user_id, bool_or(day = t0) AS a, bool_or(day = t0 + 1) AS b FROM s JOIN p ON day IN (t0, t0 + 1) GROUP BY 1, 2, 3),
      n AS (SELECT t0, t1, count(*) FILTER (WHERE a AND b) AS stayed, count(*) FILTER (WHERE a AND NOT b) AS lost, count(*) FILTER (WHERE b AND NOT a) AS gained FROM j GROUP BY 1, 2)
      SELECT *, round((lost + gained) / (lost + gained + stayed), 4) AS churn, round(stayed / (lost + gained + stayed), 4) AS jaccard FROM n""",
    "lost_class_destination": """WITH a AS (SELECT user_id, arg_max(event_type, (value, event_id)) AS label FROM events WHERE day(ts) <= 15 GROUP BY 1),
      b AS (SELECT user_id, arg_max(event_type, (value, event_id)) AS label FROM events WHERE day(ts) >= 16 GROUP BY 1),
      t AS (SELECT coalesce(b.label, 'none') AS destination FROM a LEFT JOIN b USING (user_id) WHERE a.label = 'purchase')
      SELECT destination, count(*) AS n FROM t WHERE destination <> 'purchase' GROUP BY ROLLUP (destination)""",
    "longest_flag_run": f"""WITH {USER_DAYS}, i AS (SELECT user_id, seen, row_number() OVER (PARTITION BY user_id ORDER BY day) - row_number() OVER (PARTITION BY user_id, seen ORDER BY day) AS k FROM user_days),
      n AS (SELECT user_id, seen, k, count(*) AS n FROM i GROUP BY 1, 2, 3) SELECT user_id, coalesce(max(n) FILTER (WHERE seen), 0) AS longest FROM n GROUP BY 1""",
    "pivot_panel": """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS "F",
      round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY 1""",
    "permutation_rank": """WITH r AS (SELECT l_suppkey, round(stddev_samp(l_quantity) / avg(l_quantity), 4) AS ratio FROM lineitem GROUP BY 1)
      SELECT l_suppkey, ratio, rank() OVER (ORDER BY ratio DESC) AS place, round(rank() OVER (ORDER BY ratio DESC) / count(*) OVER (), 4) AS p FROM r WHERE ratio IS NOT NULL""",
    "forward_fill_sections": """SELECT doc_id, source, last_value(CASE WHEN doc_id % 7 = 0 THEN lang END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS section FROM documents""",
    "latest_wins_merge": """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P')::INT, o_orderkey DESC) AS k FROM orders) WHERE k = 1""",
    "uniform_thinning": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)
      SELECT o_custkey, o_orderkey FROM r WHERE m <= 4 OR k IN (0, CAST(round((m - 1) / 3.0) AS INT), CAST(round(2 * (m - 1) / 3.0) AS INT), m - 1)""",
}
