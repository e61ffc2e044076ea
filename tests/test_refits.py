"""Unit roots, trend tests, synthetic controls and fake breaks against plain NumPy and published values."""

import itertools

import numpy as np
import pytest

from tidemark.operators import causal, refits


def test_published_critical_values():
    """Asymptotic critical values of the test with a constant at 1, 5 and 10 % (MacKinnon 2010)."""
    for t, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):
        assert causal.p_of_unit_root(t) == pytest.approx(p, abs=1e-3)
    assert causal.p_of_unit_root(-20) == 0 and causal.p_of_unit_root(3) == 1


def test_unit_root(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=120)
    series = {"walk": np.cumsum(noise), "noise": noise, "short": noise[:4], "flat": np.ones(30)}
    rows = [(k, i, float(v)) for k, own in series.items() for i, v in enumerate(own)]
    got = {r.series: r for r in causal.unit_root(spark.createDataFrame(rows, "s string, t int, y double"), "s", "t", "y").collect()}
    assert got["noise"].p < 0.01 < 0.2 < got["walk"].p and got["short"].p is None and got["flat"].p is None
    y, k = series["walk"], 2
    change = np.diff(y)
    x = np.stack([y[k:-1], np.ones(len(change) - k), change[k - 1 : -1], change[k - 2 : -2]], 1)
    beta, rss = np.linalg.lstsq(x, change[k:], rcond=None)[:2]
    assert causal.unit_root_t(y, k) == pytest.approx(beta[0] / np.sqrt(rss[0] / (len(x) - 4) * np.linalg.inv(x.T @ x)[0, 0]))


UNITS = ["treated", "b", "c", "d", "e"]


def panels():
    """A parallel panel and one whose treated unit drifts away."""
    rng = np.random.default_rng(5)
    for panel, drift in (("even", 0.0), ("apart", 0.6)):
        for k, u in enumerate(UNITS):
            for t in range(2000, 2010):
                yield panel, u, t, float(10 + 3 * k + np.sin(t) + drift * (u == "treated") * (t - 2000) + rng.normal() * 0.05)


def plain_f(rows, until, kind, base):
    """F of the added columns by two fits with all dummies."""
    rows = [r for r in rows if r[2] <= until]
    y = np.array([r[3] for r in rows])
    years = sorted({r[2] for r in rows})
    x = np.array([[r[1] == u for u in UNITS] + [r[2] == t for t in years] for r in rows], float)
    more = [[(r[1] == u) * (r[2] - years[0]) for u in UNITS[1:]] for r in rows] if kind == "T1" else [[(r[1] == "treated") * (r[2] == t) for t in years if t != base] for r in rows]
    full = np.concatenate([x, np.array(more, float)], 1)
    rss = [((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum() for z in (full, x)]
    ranks = [np.linalg.matrix_rank(z) for z in (full, x)]
    return (rss[1] - rss[0]) / len(more[0]) / (rss[0] / (len(y) - ranks[0]))


def test_trend_tests(spark):
    rows = list(panels()) + [("short", u, t, float(t)) for u in UNITS for t in (2000, 2001)]
    df = spark.createDataFrame(rows, "panel string, u string, t int, y double")
    got = {(r.panel, r.test): r for r in refits.trend_tests(df, ["panel"], "u", "t", "y", "treated", 2007, 2004, draws=200).collect()}
    for panel, test in itertools.product(("even", "apart"), ("T1", "T2")):
        r = got[panel, test]
        assert r.f == pytest.approx(plain_f([x for x in rows if x[0] == panel], 2007, test, 2004), rel=1e-6) and r.n == 40 and r.n_clusters == 5
        assert 1 / 201 <= r.p <= 1
    assert got["apart", "T2"].longest >= 3 and got["apart", "T2"].fires and got["even", "T1"].longest is None
    leads = {x.year: x.coef for x in got["apart", "T2"].leads}
    assert sorted(leads) == [2000, 2001, 2002, 2003, 2005, 2006, 2007] and leads[2007] == pytest.approx(0.6 * 3, abs=0.2)
    assert got["short", "T1"].reason == "2 years before" and got["short", "T2"].f is None and got["short", "T1"].fires is None
    again = {(r.panel, r.test): r.p for r in refits.trend_tests(df.repartition(7), ["panel"], "u", "t", "y", "treated", 2007, 2004, draws=200).collect()}
    assert again == {k: r.p for k, r in got.items()}


def test_synthetic_controls_with_units_left_out(spark):
    rng = np.random.default_rng(8)
    base = {u: 5 + np.cumsum(rng.normal(size=12) * 0.3) + k for k, u in enumerate("bcde")}
    base["treated"] = 0.5 * base["b"] + 0.5 * base["c"] + np.where(np.arange(12) >= 8, 3.0, 0.0)
    rows = [("p", u, 2000 + t, float(v)) for u, own in base.items() for t, v in enumerate(own)]
    df = spark.createDataFrame(rows, "panel string, u string, t int, y double")
    fits = refits.control_fits(df, ["panel"], "u", "t", "y", "treated", [2008, 2001]).cache()
    assert fits.where("break_year = 2008").count() == 5 + 4
    own = fits.where("break_year = 2008 AND target = 'treated' AND left_out IS NULL").first()
    scaled = {u: v / v[:8].mean() for u, v in base.items()}
    gap = scaled["treated"] - sum(own.weights[u] * scaled[u] for u in "bcde")
    assert sum(own.weights.values()) == pytest.approx(1) and own.gap == pytest.approx(gap[8:].mean()) and own.rmspe_before == pytest.approx(np.sqrt((gap[:8] ** 2).mean()), abs=1e-9)
    best = min(((scaled["treated"][:8] - a * scaled["b"][:8] - b * scaled["c"][:8] - c * scaled["d"][:8] - (1 - a - b - c) * scaled["e"][:8]) ** 2).mean() for a, b, c in itertools.product(np.linspace(0, 1, 21), repeat=3) if a + b + c <= 1 + 1e-9)
    assert (gap[:8] ** 2).mean() <= best + 1e-9
    logs = {u: np.log(v) for u, v in base.items()}
    change = {u: v[8:].mean() - v[:8].mean() for u, v in logs.items()}
    assert own.did == pytest.approx(change["treated"] - np.mean([change[u] for u in "bcde"])) and own.did_low < own.did < own.did_high
    effects = {r.break_year: r for r in refits.control_effects(fits, ["panel"], "treated").collect()}
    e = effects[2008]
    ratios = {r.target: r.ratio for r in fits.where("break_year = 2008 AND left_out IS NULL").collect()}
    assert e["rank"] == 1 + sum(v > ratios["treated"] for v in ratios.values()) and e.p == e["rank"] / 5 and e.n_left_out == 4
    shifts = [abs(r.gap - own.gap) / abs(own.gap) for r in fits.where("break_year = 2008 AND left_out IS NOT NULL").collect()]
    assert e.shift == pytest.approx(max(shifts)) and e.donor_weight == pytest.approx(max(own.weights.values()))
    flags = {"f3": own.rmspe_before > 0.5 * own.spread, "f4": e.donor_weight > 0.8, "f5": e["rank"] > 2, "f7": e.shift > 0.5}
    assert {k: e[k] for k in flags} == flags and e.fired == ";".join(k for k, v in flags.items() if v)
    assert effects[2001].gap is None and effects[2001].reason == "1 years before, 11 after" and effects[2001].fired is None
    fits.unpersist()


def test_fake_breaks(spark):
    t = np.arange(1990, 2020)
    rng = np.random.default_rng(4)
    step = 10 + (t >= 2010) * 4.0 + rng.normal(size=30) * 0.1
    early = 10 + (t >= 2000) * 4.0 + (t >= 2010) * 4.0 + rng.normal(size=30) * 0.1
    rows = [(k, int(a), float(b)) for k, own in (("late", step), ("both", early)) for a, b in zip(t, own, strict=True)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    got = {(r.series, r.fake_year): r for r in refits.fake_breaks(df, "s", "t", "y", [(2010, 2000), (2010, 1991)]).collect()}
    for name, own in (("late", step), ("both", early)):
        x = causal.design(t.astype(float), 2000)
        assert got[name, 2000].fake_coef == pytest.approx(np.linalg.lstsq(x, own, rcond=None)[0][2])
    assert got["late", 2000].repeats is False and got["late", 1991].repeats is None and got["late", 1991].reason.startswith("1 points before")
