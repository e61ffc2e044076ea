"""Exact quantiles against NumPy, and that no task gets more than a share of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators.quantiles import counts_below, exact_quantiles, rank_error


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0, 2.0, 7.0], 200), "c": np.array([5.0]), None: rng.exponential(size=500)}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    levels = {"lowest": 0.0, "low": 0.02, "middle": 0.5, "high": 0.98, "highest": 1.0, "odd": 0.3333}
    got = {r.g: r for r in exact_quantiles(df, ["g"], {k: (F.col("v"), q) for k, q in levels.items()}).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, own in groups.items():
        assert [got[g][k] for k in levels] == pytest.approx([np.quantile(own, q) for q in levels.values()], rel=1e-12)
    assert all(got["d"][k] is None for k in levels)
    one = exact_quantiles(df, [], {"half": (F.col("v"), 0.5), "of b": (F.when(F.col("g") == "b", F.col("v")), 0.25)}).first()
    assert one[0] == pytest.approx(np.median(np.concatenate(list(groups.values())))) and one[1] == np.quantile(groups["b"], 0.25)


def test_many_rows_keep_to_their_bracket(spark):
    """Of 200,000 different values the second pass keeps a few hundred."""
    n = 200_000
    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    out = exact_quantiles(df, [], {"q": (F.col("v"), 0.3)})
    assert out.first().q == pytest.approx(0.3 * (n - 1))
    within = df.where(F.col("v").between(0.3 * n - rank_error(n), 0.3 * n + rank_error(n))).count()
    assert within < n / 100


@pytest.mark.parametrize("seed,share", [(1, 0.02), (2, 0.3), (3, 0.9)])
def test_nearest_sources_with_ties(spark, seed, share):
    """Every cell against all sources, ties by row and column."""
    rng = np.random.default_rng(seed)
    places = [(r, c) for r in range(-7, 14) for c in range(-5, 17)]
    sources = [p for p in places if rng.random() < share] + [(40, 3)]
    asked = [p for p in places if rng.random() < 0.8] + [(2, 60), (300, -90)]
    df = spark.createDataFrame([(r, c, f"{r},{c}") for r, c in sources], "row int, col int, v string")
    cells = spark.createDataFrame(asked, "row int, col int")
    got = {(r.row, r.col): (r.d2, r.v) for r in grid.nearest_value(cells, df, "v").collect()}
    want = {(r, c): min(((r - i) ** 2 + (c - j) ** 2, i, j) for i, j in sources) for r, c in asked}
    assert got == {k: (d, f"{i},{j}") for k, (d, i, j) in want.items()}
    assert grid.nearest_value(cells, df.limit(0), "v").count() == 0


def test_nearest_sources_across_blocks(spark, monkeypatch):
    """Blocks without sources, or without cells, get theirs from any block above or below; no window looks ahead of each of its
    rows, which grows with the square of a column."""
    rng = np.random.default_rng(11)
    sources = [(int(r), int(c)) for r, c in zip(rng.integers(-30, 60, 9), rng.integers(0, 6, 9), strict=True)] + [(-500, 2), (10**6, 4)]
    asked = [(r, c) for r in [*range(-40, 90), 5000, 400_000, 2 * 10**6] for c in range(-1, 7)]
    df = spark.createDataFrame([(r, c, f"{r},{c}") for r, c in sources], "row long, col long, v string")
    want = {(r, c): min(((r - i) ** 2 + (c - j) ** 2, i, j) for i, j in sources) for r, c in asked}
    for height in (7, 256):
        monkeypatch.setattr(grid, "BLOCK_ROWS", height)
        found = grid.nearest_value(spark.createDataFrame(asked, "row long, col long"), df, "v")
        assert {(r.row, r.col): (r.d2, r.v) for r in found.collect()} == {k: (d, f"{i},{j}") for k, (d, i, j) in want.items()}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_counts_below(spark):
    rng = np.random.default_rng(9)
    values = {g: np.sort(rng.choice(2000, 700, replace=False)) for g in "ab"}
    times = {g: rng.integers(1, 5, 700) for g in "ab"}
    rows = [(g, float(v), int(n)) for g in "ab" for v, n in zip(values[g], times[g], strict=True)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(6)
    got = {(r.g, r.v): (r.below__, r.total__) for r in counts_below(df, ["g"], "v", "n").collect()}
    for g in "ab":
        so_far = np.cumsum(times[g]) - times[g]
        assert [got[g, float(v)] for v in values[g]] == [(int(x), int(times[g].sum())) for x in so_far]
    one = {r.v: r.below__ for r in counts_below(df.where("g = 'a'"), [], "v", "n").collect()}
    assert one == {float(v): int(x) for v, x in zip(values["a"], np.cumsum(times["a"]) - times["a"], strict=True)}
