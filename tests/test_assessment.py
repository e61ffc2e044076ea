"""End-to-end runs, composites and estimators on small cases worked out by hand or in plain Python."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assessment, composites, population


def test_area_and_growth(spark):
    cells = spark.createDataFrame([(0, 0, 1990), (0, 1, 1995), (0, 2, 0), (0, 3, 2000), (9, 9, 2004), (9, 8, 2010), (0, 4, 1991)], "row long, col long, first long")
    sites = spark.createDataFrame([("a", 1.0, 0.0), ("b", 9.0, 9.0), ("c", 99.0, 99.0)], "site string, x double, y double")
    out = assessment.area_and_growth(cells, sites, "site", ("x", "y"), "first", [1990, 2000, 2005], 2.0, F.col("col") == 4)
    got = {(r.unit, r.metric, r.start_year, r.year): r.value for r in out.collect()}
    assert {k[0] + str(k[3]): v for k, v in got.items() if k[1] == "area_km2"} == {"a1990": 2.0, "a2000": 6.0, "a2005": 6.0, "b1990": 0.0, "b2000": 0.0, "b2005": 2.0, "c1990": 0.0, "c2000": 0.0, "c2005": 0.0}
    assert got["a", "growth_pct", 1990, 2000] == pytest.approx((3 ** 0.1 - 1) * 100) and got["b", "growth_pct", 2000, 2005] is None
    assert got["a", "span_growth_pct", 1990, 2005] == pytest.approx((3 ** (1 / 15) - 1) * 100)


def test_layer_areas_have_every_combination(spark):
    cells = spark.createDataFrame([(0, 0, 1, "x"), (0, 1, 1, "x"), (0, 0, 2, "y"), (5, 5, 2, None)], "row long, col long, year int, layer string")
    sites = spark.createDataFrame([("a", 0.0, 0.0), ("b", 9.0, 9.0)], "site string, x double, y double")
    got = {(r.unit, r.layer, r.year): r.km2 for r in assessment.layer_areas(cells, sites, "site", ("x", "y"), "year", "layer", 0.5).collect()}
    assert len(got) == 8 and got["a", "x", 1] == 1.0 and got["a", "y", 2] == 0.5 and sum(got.values()) == 1.5


def test_classification_run(spark):
    """A town that NDVI tells apart grows from 3 x 3 to 5 x 5 cells, of which the last year's new ones confirm themselves."""
    rows = []
    for y, reach in ((2000, 2), (2005, 3)):
        for r in range(16):
            for c in range(16):
                town = abs(r - 5) <= reach and abs(c - 5) <= reach
                ndvi = 0.1 if town else 0.8 if (r + c) % 3 else 0.4
                first = 1999 if max(abs(r - 5), abs(c - 5)) <= 2 else 2004 if max(abs(r - 5), abs(c - 5)) <= 3 else 0
                rows.append((r, c, y, ndvi, ndvi, -0.3 if c < 15 else 0.5, -0.3 if c < 15 else 0.5, first, (r, c) != (0, 0), False, r >= 12 and c < 4, (r, c) == (5, 5)))
    cells = spark.createDataFrame(rows, "row long, col long, year long, ndvi double, ndvi_wet double, mndwi double, ndwi double, first_year int, valid boolean, excluded boolean, domain boolean, resettled boolean")
    run = assessment.classification_run(cells, [2000, 2005], ["ndvi", "mndwi"], 16, 16, 2005, sample=400, floor=5, trees=10, guard=1).cache()
    got = {(r.year, r.row, r.col): r for r in run.collect()}
    assert len(got) == 2 * 256 and got[2000, 0, 0].label is None
    built = {y: {(r, c) for (t, r, c), x in got.items() if t == y and x.built} for y in (2000, 2005)}
    assert (5, 5) in built[2000] and built[2000] <= built[2005] and len(built[2005]) > len(built[2000]) >= 9
    assert got[2005, 5, 5].layer == "resettled" and got[2005, 4, 4].layer == "built_up" and got[2005, 8, 15].layer == "water"
    polygons = assessment.layer_polygons(run, 2005).polygons().collect()
    assert sum(p.cells for p in polygons) == sum(x.layer is not None for k, x in got.items() if k[0] == 2005)
    assert sum(p.n_holes for p in polygons if p.zone == "built_up") == 1
    run.unpersist()


def test_sources_are_substituted_with_reasons(spark):
    rows = [(r, c, 2000, s, f"{s}{k}", v) for r in range(2) for c in range(2) for s, k, v in (("one", 0, 1.0), ("two", 0, 5.0), ("two", 1, 7.0), ("two", 2, None))] + [(0, 0, 2001, "one", "one0", None)]
    scenes = spark.createDataFrame(rows, "row int, col int, year int, source string, scene string, v double")
    found = composites.viability(scenes, ["year", "source"], "v", 4, 2, 2, 0.9)
    got = {r.year: r for r in composites.chosen_sources(found, "year", "source", ["one", "two"]).collect()}
    assert (got[2000].source, got[2000].substituted) == ("two", True) and got[2000].reasons.startswith("one: 1 scenes")
    assert got[2001].source is None and "0.000 of cells" in got[2001].reasons
    cells = {(r.row, r.col, r.year): r for r in composites.substituted_composite(scenes, "year", "source", ["v"], ["one", "two"], 2).collect()}
    assert (cells[1, 1, 2000].source, cells[1, 1, 2000].v, cells[1, 1, 2000].n_seen) == ("two", 6.0, 2)
    assert (cells[0, 0, 2001].source, cells[0, 0, 2001].v, cells[0, 0, 2001].n_seen) == (None, None, 0)


@pytest.mark.parametrize("n,most", [(10, 3), (7, 7), (5, 1), (12, 5), (2, 4)])
def test_thinning_is_even(spark, n, most):
    scenes = spark.createDataFrame([(1, f"s{k:02d}", k) for k in range(n)], "g int, scene string, t int")
    got = sorted(r.t for r in composites.thinned(scenes, ["g"], "scene", "t", {"all": None, "few": most}).where("scenario = 'few'").collect())
    want = list(range(n)) if n <= most else sorted({int(k * (n - 1) / max(most - 1, 1) + 0.5) for k in range(most)})
    assert got == want and len(got) == min(n, most)


def test_capacity_experiment_base_is_the_plain_run(spark):
    scenes = spark.createDataFrame([(0, c, 1, f"s{t}", t, 0.1 * (t + c)) for c in range(6) for t in range(5)], "row int, col int, year int, scene string, t int, v double")
    plain = scenes.groupBy("row", "col").agg(F.median("v").alias("v")).where("v > 0.45").count()
    composite = lambda s, keys: s.groupBy(*keys, "row", "col").agg(F.median("v").alias("v"))
    got = {r.scenario: r for r in composites.capacity_experiment(scenes, ["year"], "scene", "t", {"all": None, "first": 1}, composite, lambda m, _: F.col("v") > 0.45, 2.0, "all").collect()}
    assert got["all"].cells == plain and got["all"].change_pct == 0
    assert got["first"].km2 == 2.0 * sum(0.1 * c > 0.45 for c in range(6)) and got["first"].change_pct == pytest.approx((got["first"].km2 / got["all"].km2 - 1) * 100)


def test_estimators(spark):
    rows = [("a", 10.0, 0.5, 1.0), ("a", 20.0, 1.0, 0.0), ("a", 5.0, 0.0, 0.2), ("a", -3.0, 0.2, 2.0), ("a", None, 0.9, 1.0), ("b", 4.0, 0.0, None)]
    own = population.estimators(spark.createDataFrame(rows, "k string, v double, s double, o double"), ["k"], "v", "s", "o")
    got = {r.k: r for r in own.collect()}
    a = got["a"]
    assert (a.own_share, a.other_share, a.any_built, a.whole) == (25.0, 11.0, 30.0, 35.0) and a.median_share == pytest.approx(0.7)
    assert a.median_built == 20.0 and (a.floor, a.ceiling, a.n, a.n_built) == (11.0, 35.0, 5, 4)
    assert got["b"].any_built == 0 and got["b"].floor == 0 and got["b"].median_share is None
    seen = spark.createDataFrame([("a", 28.0)], "k string, total double")
    off = {r.estimator: r.deviation_pct for r in population.deviations(own, seen, ["k"], "total").collect()}
    assert off["whole"] == pytest.approx(25.0) and len(off) == 5
    points = {r.k: r for r in population.modelled_points(own, ["k"], 2025).collect()}
    assert (points["a"].value, points["a"].low, points["a"].high, points["a"].flag) == (30.0, 11.0, 35.0, "modelled") and points["b"].value is None
    long = population.sensitivity_rows(own, population.deviations(own, seen, ["k"], "total"), ["k"])
    assert long.count() == 2 * 8 + 5 and long.where("name = 'spread_pct' AND k = 'a'").first().value == pytest.approx((35 / 11 - 1) * 100)


def test_left_out_folds(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 2.0), ("a", 2, 20.0, 4.0), ("a", 3, 30.0, 4.0), ("b", 1, 5.0, 1.0)], "k string, f int, v double, w double")
    got = {(r.k, r.f): r for r in population.left_out(df, ["k"], "f", "v", "w").collect()}
    assert got["a", 1].predicted == pytest.approx(2 * 50 / 8) and got["a", 3].deviation_pct == pytest.approx((4 * 30 / 6 / 30 - 1) * 100)
    assert got["b", 1].predicted is None
