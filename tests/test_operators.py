import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import spectral, words
from tidemark.operators import causal, contracts, grid, learning, markers, ranks, series, spatial, temporal
from tidemark.sources import html


def test_all_patterns_of_six_years(spark):
    rows = [(p, y, bool(p >> y & 1)) for p in range(64) for y in range(6)]
    out = temporal.confirm_then_persist(spark.createDataFrame(rows, "p long, y int, b boolean"), ["p"], "y", "b").collect()
    got = {(r.p, r.y): (r.confirmed, r.persistent) for r in out}
    for p in range(64):
        b = [bool(p >> y & 1) for y in range(6)]
        ever = False
        for y in range(6):
            ever = ever or (b[y] and (y == 5 or b[y + 1]))
            assert got[p, y] == (b[y] and ever, ever)


def test_growth_is_null_not_zero(spark):
    df = spark.createDataFrame([("a", 2000, 0.0), ("a", 2005, 5.0), ("a", 2010, None), ("a", 2015, 10.0)], "u string, y int, v double")
    out = {(r.first_year, r.last_year): r.growth for r in series.pairwise_growth(df, ["u"], "y", "v").collect()}
    assert out[2000, 2005] is None
    assert out[2005, 2015] == pytest.approx(2**0.1 - 1)


def test_concordance_needs_active_signals(spark):
    one = spark.range(1)
    got = one.select(ranks.concordance({"a": F.lit(True)}, 2).alias("x"), ranks.concordance({"a": F.lit(True), "b": F.lit(False)}, 2).alias("y")).first()
    assert got.x is None and got.y is False


def test_spectral_guards(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (float("nan"), 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(spectral.normalised_difference(F.col("b"), F.col("a"))).collect()] == [None, 0.5, None, None]
    qa = spark.createDataFrame([(x,) for x in (0, 1, 2, 4, 8, 16, 64, 21824)], "q int")
    assert [r[0] for r in qa.select(spectral.qa_valid(F.col("q"))).collect()] == [False] * 6 + [True, True]


def test_words(spark):
    df = spark.createDataFrame([(" Moçâmbique  Áfrîca ", "1,234.5 (9)", "2021", "2006-03")], "n string, c string, y string, d string")
    got = df.select(words.plain_name(F.col("n")), words.number_cell(F.col("c")), words.same_value(F.col("y"), "2021.0"), words.decimal_year(words.partial_date(F.col("d")))).first()
    assert got[0] == "mocambique africa" and got[1] == 1234.5 and got[2] and got[3] == pytest.approx(2006 + 2.5 / 12)
    window = df.select(words.month_window(F.lit(2001), 11, 4).alias("w")).first().w
    assert (str(window.start), str(window.end)) == ("2000-11-01", "2001-04-30")


def test_grid_shapes(spark):
    mask = spark.createDataFrame([(r, c) for r in range(3) for c in range(3)] + [(5, 5), (6, 6), (8, 0)], "row int, col int")
    assert [tuple(r) for r in grid.eroded(mask).collect()] == [(1, 1)]
    eight = grid.components(mask, width=100).groupBy("component").count().collect()
    four = grid.components(mask, grid.CROSS, width=100).groupBy("component").count().collect()
    assert sorted(r["count"] for r in eight) == [1, 2, 9] and sorted(r["count"] for r in four) == [1, 1, 1, 9]
    assert len(grid.disc(3)) == 28
    assert grid.dilated(mask, 1, 9, 10).count() == len({(r + i, c + j) for r, c in [tuple(x) for x in mask.collect()] for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= r + i < 9 and 0 <= c + j < 10})


def test_nearest_neighbour_reaches_far_points(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 50.0, 0.0), (3, 1e4, 0.0)], "k long, x double, y double")
    got = {r.k: r.d2 for r in spatial.nearest_neighbour(pts, "k", "x", "y", 1.0).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 2500.0, 3: 9950.0**2}


def test_nearest_neighbour_of_crowds(spark):
    """Crowds far smaller than the radius, places that several keys share, keys with several places, a point past any number of
    rounds; and cells that hold few places however many the radius holds."""
    rng = np.random.default_rng(6)
    pts = [(k, *(rng.normal(size=2) * 1e-3)) for k in range(900)] + [(k, *(rng.normal(size=2) * 1e-3 + 7)) for k in range(850, 1200)]
    pts += [(2000 + k, float(k % 3), -5.0) for k in range(8)] + [(3000, 20.0, 20.0)] * 2 + [(3001, 1e6, 0.0)]
    df = spark.createDataFrame([(int(k), float(x), float(y)) for k, x, y in pts], "k long, x double, y double")
    keys, xy = np.array([p[0] for p in pts]), np.array([p[1:] for p in pts])
    want = {}
    for k, at in zip(keys.tolist(), xy, strict=True):
        d = at - xy[keys != k]
        want[k] = min(want.get(k, np.inf), (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]).min())
    assert {r.k: r.d2 for r in spatial.nearest_neighbour(df, "k", "x", "y", 4.0).collect()} == want
    places = spark.createDataFrame([(float(x), float(y)) for x, y in rng.random((20_000, 2))], "x__ double, y__ double")
    side, reach = spatial._dealt(places, 4.0)
    assert places.groupBy(spatial.cell(F.col("x__"), side), spatial.cell(F.col("y__"), side)).count().agg(F.max("count")).first()[0] <= spatial.CROWD and reach >= 2**0.5
    far = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e9, 0.0)], "k long, x double, y double")
    assert [r.d2 for r in spatial.nearest_neighbour(far, "k", "x", "y", 1e-6).collect()] == [1e18, 1e18]
    assert spatial.nearest_neighbour(far.limit(1), "k", "x", "y", 1.0).count() == 0


def test_utm(spark):
    """The series against the arc of a meridian, summed in small steps, and against a circle of latitude on the equator."""
    e2 = (2 - 1 / 298.257223563) / 298.257223563
    lat = np.radians(np.linspace(0, 16.1564, 200_001))
    radius = 6378137.0 * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5
    arc = float(((radius[1:] + radius[:-1]) / 2 * np.diff(lat)).sum())
    e, n = spatial.utm(F.lit(33.0), F.lit(-16.1564), 36, True)
    east, north = spatial.utm(F.lit(33.5867), F.lit(-16.1564), 36, True)
    flat, zero = spatial.utm(F.lit(33.5), F.lit(0.0), 36, False)
    got = spark.range(1).select(e, n, east, north, flat, zero).first()
    assert got[0] == pytest.approx(500000, abs=1e-3) and got[1] == pytest.approx(1e7 - 0.9996 * arc, abs=0.01)
    # On the equator the easting follows from the radius of a sphere of the same curvature to within millimetres.
    assert got[4] == pytest.approx(500000 + 0.9996 * 6378137.0 * np.arctanh(np.sin(np.radians(0.5))), abs=0.1) and got[5] == pytest.approx(0, abs=1e-6)
    assert 562000 < got[2] < 563500 and got[3] < got[1]


def test_nearest_of_many_sites(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MAX_LITERALS", 3)
    rng = np.random.default_rng(6)
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(60, 2)).round(1))] + [(60, 500.0, 1.0), (61, None, 1.0)]
    sites = [(f"s{k:02}", float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(25, 2)).round(1))]
    p, q = spark.createDataFrame(pts, "k long, x double, y double"), spark.createDataFrame(sites, "name string, sx double, sy double")
    got = {r.k: (r.site, r.d2) for r in spatial.nearest_site(p, q, (F.col("x"), F.col("y")), ("sx", "sy"), "name").collect()}
    for k, x, y in pts[:-1]:
        d2, name = min(((x - a) * (x - a) + (y - b) * (y - b), s) for s, a, b in sites)
        assert got[k] == (name, pytest.approx(d2))
    assert got[61] == (None, None)
    bands = [(float(k), float(k + (k % 5)), f"b{k}") for k in range(0, 40, 2)]
    values = spark.createDataFrame([(k / 2,) for k in range(-4, 100)] + [(None,)], "v double")
    out = spatial.range_band(values, spark.createDataFrame(bands, "low double, high double, band string"), F.col("v"), "low", "high", "band").collect()
    assert len(out) == 105 and all(r.band == next((c for a, b, c in bands if r.v is not None and a <= r.v <= b), None) for r in out)


def test_training_sample_is_exact(spark):
    rows = [(k, "rare" if k % 100 == 0 else "none" if k % 999 == 1 else "usual") for k in range(5000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "k long, c string")
    for size, floor in ((400, 25), (5000, 10), (300, 60), (0, 3)):
        got = learning.training_sample(df, ["k"], "c", size, floor).collect()
        n = {c: sum(r.c == c for r in got) for c in ("rare", "none", "usual")}
        have = {c: sum(x == c for _, x in rows) for c in n}
        assert len({r.k for r in got}) == len(got) and len(got) >= min(size, 5000)
        assert all(n[c] >= min(floor, have[c]) for c in n) and len(got) <= min(size, 5000) + 2 * floor + 3
    with pytest.raises(ValueError):
        learning.landscape_median(df, "k", F.col("k") < 0)


def test_tiles_are_half_open():
    assert spatial.tile_corners(33.0, -17.0, 34.0, -15.5, 1.0) == [(33.0, -17.0), (33.0, -16.0)]


def test_contracts(spark):
    df = spark.createDataFrame([("f", "u", 2000, "v", 1.0, "m", "observed", "A", None, None, None), ("f", "u", 2000, "v", 2.0, "m", "odd", "B", None, None, None), ("f", "u", 2001, "v", 0.0, "m", "observed", "A", None, None, None)], contracts.LONG_TABLE)
    faults = {r.fault for r in contracts.long_table_faults(df, ["f", "g"], ["observed"]).collect()}
    assert faults == {"flag", "level", "zero without note", "conflict", "no family g"}
    with pytest.raises(contracts.BrokenContractError):
        contracts.resolved(df, df.where("year = 2001"), ["year"])
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    then = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, sha256 string")
    assert {(r.path, r.state) for r in contracts.manifest_changes(now, then).collect()} == {("a", "extra"), ("b", "changed"), ("c", "missing")}


def test_marker_errors(spark):
    t = spark.createDataFrame([("2021", 1.0), ("2022.0", 0.0), (None, 3.0)], "y string, v double")
    program = {"a": {"table": "t", "column": "v", "where": {"y": 2021}}, "b": {"table": "t", "column": "v", "where": {"y": "2022"}}, "c": {"op": "ratio", "a": "a", "b": "b"}, "d": {"op": "ratio", "a": "e", "b": "a"}, "e": {"op": "ratio", "a": "d", "b": "a"}, "f": {"op": "difference", "a": "a", "b": "zz"}}
    got = {r.marker: (r.value, r.error) for r in markers.resolve(spark, program, {"t": t}).collect()}
    assert got["a"] == (1.0, None) and got["b"] == (0.0, None) and got["c"][1] == "not finite" and got["d"][1] == got["e"][1] == "circular" and "zz" in got["f"][1]


def test_interrupted_series(spark):
    y = [2.0 * t + (5 + 3 * (t - 10) if t >= 10 else 0) for t in range(20)]
    df = spark.createDataFrame([("s", 2000 + t, v) for t, v in enumerate(y)] + [("short", 2009, 1.0), ("short", 2010, 1.0)], "s string, y int, v double")
    got = {(r.series, r.term): r for r in causal.interrupted_series(df, "s", "y", "v", 2010).collect()}
    assert [got["s", k].coef for k in causal.TERMS] == pytest.approx([20, 2, 5, 3], abs=1e-8)
    assert got["short", "step"].coef is None and got["short", "step"].reason


def test_simplex_weights():
    rng = np.random.default_rng(1)
    donors = rng.normal(size=(12, 5))
    assert causal.simplex_weights(donors @ np.array([0.5, 0, 0.3, 0.2, 0]), donors) == pytest.approx([0.5, 0, 0.3, 0.2, 0], abs=1e-6)
    many = rng.normal(size=(40, 15))
    w = causal.simplex_weights(many @ np.eye(15)[3] + rng.normal(size=40), many)
    gradient = many.T @ (many @ w - many @ np.eye(15)[3])
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    target = rng.normal(size=40)
    w = causal.simplex_weights(target, many)
    gradient = many.T @ (many @ w - target)
    assert gradient[w > 1e-9] == pytest.approx(gradient.min(), abs=1e-6)  # Karush, Kuhn and Tucker


def test_html_tables(spark):
    page = "<table><tr><th>Item<th>2020<th>2021</tr><tr><td>Coal&nbsp;(9)<td>1,5<td>-</table>"
    cells = html.table_cells(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html")
    assert [(r.row, r.col, r.head, r.cell) for r in cells.orderBy("row", "col").collect()] == [(0, 0, True, "Item"), (0, 1, True, "2020"), (0, 2, True, "2021"), (1, 0, False, "Coal (9)"), (1, 1, False, "1,5"), (1, 2, False, "-")]
    assert {(r.col, r.year) for r in html.year_columns(cells, "id").collect()} == {(1, 2020), (2, 2021)}


def test_html_tables_nested_and_spanning(spark):
    page = "<table><tr><td rowspan=2>a<td colspan='2'>b<table><tr><td>in</table></tr><tr><td>c<td>d</table><table><tr><td>e"
    cells = html.table_cells(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html").collect()
    assert sorted((r.table, r.row, r.col, r.cell) for r in cells) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 0, 2, "b"), (0, 1, 0, "a"), (0, 1, 1, "c"), (0, 1, 2, "d"), (1, 0, 0, "in"), (2, 0, 0, "e")]


def test_nearest_value_has_no_reach(spark):
    rng = np.random.default_rng(3)
    cells = [(r, c) for r in range(0, 60, 3) for c in range(0, 400, 9)]
    sources = [(int(r), int(c), float(k)) for k, (r, c) in enumerate(zip(rng.integers(0, 20, 5), rng.integers(0, 30, 5), strict=True))] + [(5000, 5000, 9.0)]
    got = grid.nearest_value(spark.createDataFrame(cells, "row long, col long"), spark.createDataFrame(sources, "row long, col long, z double"), "z").collect()
    want = {(r, c): min(((r - a) ** 2 + (c - b) ** 2, a, b, z) for a, b, z in sources) for r, c in cells}
    assert len(got) == len(cells) and {(r.row, r.col): (r.d2, r.z) for r in got} == {k: (v[0], v[3]) for k, v in want.items()}
    assert grid.nearest_value(spark.createDataFrame(cells, "row long, col long"), spark.createDataFrame([], "row long, col long, z double"), "z").count() == 0


def test_majority_leaves_out_cells_beyond_the_grid(spark):
    """The last row and column are repeated outwards; what lies past them in the mask isn't the grid's."""
    rng = np.random.default_rng(8)
    mask = {(r, c) for r in range(-2, 9) for c in range(-2, 8) if rng.random() < 0.5}
    got = {(r.row, r.col) for r in grid.majority(spark.createDataFrame(sorted(mask), "row long, col long"), 6, 5).collect()}
    near = {(r, c): [(min(max(r + i, 0), 5), min(max(c + j, 0), 4)) for i, j in grid.SQUARE] for r in range(6) for c in range(5)}
    assert got == {k for k, square in near.items() if sum(x in mask for x in square) >= 5}


def test_components_across_tiles(spark):
    rng = np.random.default_rng(5)
    cells = {(int(r), int(c)) for r, c in zip(rng.integers(-8, 12, 260), rng.integers(-9, 11, 260), strict=True)} | {(2**42, 0), (2**42, 1), (2**42 + 3, 0)}
    df = spark.createDataFrame(sorted(cells), "row long, col long")
    seen, want = set(), set()
    for cell in cells:
        if cell in seen:
            continue
        group, todo = set(), [cell]
        while todo:
            x = todo.pop()
            if x in cells and x not in group:
                group.add(x)
                todo += [(x[0] + i, x[1] + j) for i, j in grid.SQUARE]
        seen |= group
        want.add(frozenset(group))
    for tile in (4, 256):
        got = {}
        for r in grid.components(df, tile=tile).collect():
            got.setdefault(r.component, set()).add((r.row, r.col))
        assert {frozenset(x) for x in got.values()} == want


def test_causal_tests(spark):
    rng = np.random.default_rng(2)
    t = np.arange(40.0)
    x = np.stack([np.ones(40), t], 1)
    e = rng.normal(size=40)
    assert causal.breusch_godfrey(x, e - x @ np.linalg.lstsq(x, e, rcond=None)[0], 1) > 0.05
    wave = np.sin(t / 3)
    wave -= x @ np.linalg.lstsq(x, wave, rcond=None)[0]
    assert causal.breusch_godfrey(x, wave, 2) < 0.001
    assert causal.ar1_fit(x, 3 + 2 * t) == pytest.approx([3, 2])
