"""Estimators fitted again and again: each variant (a test, a break, a unit left out) and unit is a row of a table and a group of its
own (M10, M11, M13). A panel has a few units and years; there may be any number of panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import verdicts
from tidemark.operators.causal import Z95, interrupted_series, joint_f, simplex_weights

DRAWS, CHUNKS, SEED = 1000, 10, 20250907


def _rows(panel: DataFrame, key: list[str], unit: str, year: str, value: str) -> DataFrame:
    return panel.select(*key, F.col(unit).cast("string").alias("u"), F.col(year).cast("long").alias("t"), F.col(value).cast("double").alias("y")).dropna()


def clustered(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, standard errors) of least squares, errors clustered, with the factors for few clusters and terms."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    n_clusters = of.max() + 1
    sums = np.zeros((n_clusters, x.shape[1]))
    np.add.at(sums, of, x * e[:, None])
    rank = np.linalg.matrix_rank(x)
    factor = n_clusters / max(1, n_clusters - 1) * (len(y) - 1) / max(1, len(y) - rank)
    return beta, np.sqrt(np.maximum(np.diag(inverse @ (sums.T @ sums) @ inverse) * factor, 0))


def _fixed_effects(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], list[int]]:
    """A constant, units and years but their first ones; the unit of each row, the units, the years."""
    units, years = sorted(set(pdf["u"])), sorted(set(pdf["t"]))
    of = pdf["u"].map(units.index).to_numpy()
    when = pdf["t"].map(years.index).to_numpy()
    x = np.concatenate([np.ones((len(pdf), 1)), (of[:, None] == np.arange(1, len(units))), (when[:, None] == np.arange(1, len(years)))], 1).astype(float)
    return x, of, units, years


def trend_tests(panel: DataFrame, key: list[str], unit: str, year: str, value: str, treated: str, until: int, base: int, least: int = 4, draws: int = DRAWS) -> DataFrame:
    """Whether a panel's units ran in parallel up to a year (M10), a row for each panel and test:
    T1: all units' own trends are 0 beside effects of units and years;
    T2: the treated unit's leads, one for each year but the base, are all 0.
    Columns: f, p (random signs of the clusters' restricted residuals; the draws are dealt in chunks, each a group of its own), n,
    n_clusters, longest (leads in a row whose interval lies on one side of 0, T2), leads (year, coef, low, high), fires (p below
    0.1, or two such leads in a row) and reason, where fewer than `least` years leave nothing to estimate."""
    schema = ", ".join([*[f"`{k}` {dict(panel.dtypes)[k]}" for k in key], "test string, chunk int, f double, hits long, drawn long, n long, n_clusters int, reason string, leads array<struct<year:long,coef:double,low:double,high:double>>"])
    names = [*key, "test", "chunk", "f", "hits", "drawn", "n", "n_clusters", "reason", "leads"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "t"])
        head = [pdf[k].iloc[0] for k in [*key, "test", "chunk"]]
        if pdf["t"].nunique() < least or treated not in set(pdf["u"]):
            reason = f"{pdf['t'].nunique()} years before" if treated in set(pdf["u"]) else f"no unit {treated}"
            return pd.DataFrame([(*head, None, 0, 0, len(pdf), pdf["u"].nunique(), reason, None)], columns=names)
        x, of, units, years = _fixed_effects(pdf)
        y, t = pdf["y"].to_numpy(float), pdf["t"].to_numpy(float)
        if head[-2] == "T1":
            own = (of[:, None] == np.arange(1, len(units))) * (t - t.min())[:, None]
            others: list[int] = []
        else:
            others = [k for k in years if k != base]
            own = ((of == units.index(treated))[:, None] & (t[:, None] == np.array(others))).astype(float)
        full = np.concatenate([x, own], 1)
        tested = list(range(x.shape[1], full.shape[1]))
        chunk = int(head[-1])
        leads = None
        if others and chunk == 0:
            beta, se = clustered(full, y, of)
            leads = [{"year": int(k), "coef": float(b), "low": float(b - Z95 * s), "high": float(b + Z95 * s)} for k, b, s in zip(others, beta[tested], se[tested], strict=True)]
        fitted = x @ (np.linalg.pinv(x) @ y)
        n = draws // CHUNKS + (chunk < draws % CHUNKS)
        signs = np.random.Generator(np.random.PCG64([SEED, chunk])).choice([-1.0, 1.0], size=(len(units), n))
        seen = float(joint_f(y[:, None], full, tested)[0])
        drawn = joint_f(fitted[:, None] + (y - fitted)[:, None] * signs[of], full, tested)
        return pd.DataFrame([(*head, seen, int((drawn >= seen).sum()), n, len(pdf), len(units), None, leads)], columns=names)

    rows = _rows(panel.where(F.col(year) <= until), key, unit, year, value)
    each = rows.withColumn("test", F.explode(F.array(F.lit("T1"), F.lit("T2")))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
    fits = each.groupBy(*key, "test", "chunk").applyInPandas(fit, schema)
    one = fits.groupBy(*key, "test").agg(F.max("f").alias("f"), ((F.sum("hits") + 1) / (F.sum("drawn") + 1)).alias("p"), F.max("n").alias("n"), F.max("n_clusters").alias("n_clusters"), F.first("leads", ignorenulls=True).alias("leads"), F.max("reason").alias("reason"))
    off = F.transform("leads", lambda x: x["low"] * x["high"] > 0)
    run = F.aggregate(off, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, e: F.named_struct(F.lit("now"), F.when(e, a["now"] + 1).otherwise(0), F.lit("most"), F.greatest(a["most"], F.when(e, a["now"] + 1).otherwise(0))))
    one = one.withColumn("p", F.when(F.col("f").isNotNull(), F.col("p"))).withColumn("longest", F.when(F.col("leads").isNotNull(), run["most"]))
    return one.withColumn("fires", F.when(F.col("f").isNotNull(), (F.col("p") < 0.1) | (F.coalesce("longest", F.lit(0)) >= 2)))


def control_fits(panel: DataFrame, key: list[str], unit: str, year: str, value: str, treated: str, breaks: list[int], least: int = 3) -> DataFrame:
    """Synthetic controls of every panel, break and target (M11): each unit in turn against all others, and the treated unit with each
    control left out. (key, break_year, target, left_out, n_before, n_after, weights, rmspe_before, rmspe_after, ratio, gap, spread,
    did, did_low, did_high, reason): series are divided by their means before; gap: the mean distance after; spread: the
    target's standard deviation before; did: the effect in logs beside those of units and years, for the treated unit."""
    kinds = "n_before int, n_after int, weights map<string,double>, rmspe_before double, rmspe_after double, ratio double, gap double, spread double, did double, did_low double, did_high double, reason string"
    names = [*key, "break_year", "target", "left_out", *[x.split()[0] for x in kinds.split(", ")]]
    schema = ", ".join([*[f"`{k}` {dict(panel.dtypes)[k]}" for k in key], "break_year long, target string, left_out string", kinds])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[k].iloc[0] for k in [*key, "break_year", "target"]]
        out = pdf["left_out"].iloc[0] or None
        wide = pdf[pdf["u"] != out].pivot_table(index="t", columns="u", values="y").dropna().sort_index()
        before = (wide.index < head[-2]).astype(bool)
        n = [int(before.sum()), int((~before).sum())]
        target, donors = head[-1], [c for c in wide.columns if c != head[-1]]
        if n[0] < least or not n[1] or target not in wide.columns or not donors:
            return pd.DataFrame([(*head, out, *n, None, *[None] * 8, f"{n[0]} years before, {n[1]} after")], columns=names)
        scaled = wide / wide[before].mean()
        w = simplex_weights(scaled.loc[before, target].to_numpy(), scaled.loc[before, donors].to_numpy())
        gap = scaled[target].to_numpy() - scaled[donors].to_numpy() @ w
        rm = [float(np.sqrt((gap[m] ** 2).mean())) for m in (before, ~before)]
        effect = [None] * 3
        if out is None and target == treated and (wide > 0).all().all():
            long = wide.stack().rename("y").reset_index().sort_values(["u", "t"])
            x, of, units, _ = _fixed_effects(long)
            full = np.concatenate([x, ((of == units.index(target)) & (long["t"] >= head[-2]).to_numpy())[:, None].astype(float)], 1)
            beta, se = clustered(full, np.log(long["y"].to_numpy()), of)
            effect = [float(beta[-1]), float(beta[-1] - Z95 * se[-1]), float(beta[-1] + Z95 * se[-1])]
        spread = float(scaled.loc[before, target].std(ddof=1))
        row = (*head, out, *n, dict(zip(donors, map(float, w), strict=True)), *rm, rm[1] / rm[0] if rm[0] > 0 else float("inf"), float(gap[~before].mean()), spread, *effect, None)
        return pd.DataFrame([row], columns=names)

    rows = _rows(panel, key, unit, year, value)
    units = F.broadcast(rows.groupBy(*key).agg(F.collect_set("u").alias("units")))  # one row a panel
    controls = F.filter("units", lambda u: u != F.lit(treated))
    whole = F.transform("units", lambda u: F.struct(u.alias("target"), F.lit("").alias("left_out")))
    without = F.transform(controls, lambda u: F.struct(F.lit(treated).alias("target"), u.alias("left_out")))
    each = rows.join(units, key) if key else rows.crossJoin(units)
    each = each.withColumn("v", F.explode(F.concat(whole, without))).withColumn("break_year", F.explode(F.array(*[F.lit(b).cast("long") for b in breaks])))
    return each.select(*key, "break_year", "v.*", "u", "t", "y").groupBy(*key, "break_year", "target", "left_out").applyInPandas(fit, schema)


def control_effects(fits: DataFrame, key: list[str], treated: str) -> DataFrame:
    """One row for each panel and break from control_fits: the treated unit's gap, errors, rank of its ratio among all units and p,
    heaviest donor, largest relative shift of the gap with a control left out, and what speaks against the effect (M11):
    f3 the error before is above half a standard deviation, f4 one donor has more than 0.8, f5 the rank is below the second, f7 a
    control left out shifts the gap by more than half. fired: the names of those that hold; null where nothing could be estimated."""
    by = [*key, "break_year"]
    own = fits.where((F.col("target") == treated) & F.col("left_out").isNull()).drop("left_out", "target")
    ratios = fits.where(F.col("left_out").isNull()).select(*by, F.col("ratio").alias("other"), F.col("target").alias("name"))
    places = ratios.join(own.select(*by, "ratio"), by).groupBy(*by).agg((F.count_if((F.col("other") > F.col("ratio")) & (F.col("name") != treated)) + 1).alias("rank"), F.count("other").alias("n_units"))
    shifts = fits.where(F.col("left_out").isNotNull()).select(*by, F.col("gap").alias("gap_without")).join(own.select(*by, "gap"), by)
    shifts = shifts.groupBy(*by).agg(F.max(F.abs(F.col("gap_without") - F.col("gap"))).alias("shift"), F.count("gap_without").alias("n_left_out"))
    out = own.join(places, by, "left").join(shifts, by, "left")
    heaviest = F.array_max(F.transform(F.map_entries("weights"), lambda e: F.struct(e["value"].alias("w"), e["key"].alias("unit"))))
    out = out.withColumn("heaviest", heaviest).withColumn("shift", F.try_divide("shift", F.abs("gap"))).withColumn("rank", F.when(F.col("ratio").isNotNull(), F.col("rank")))
    out = out.withColumn("p", F.col("rank") / F.col("n_units"))
    flags: dict[str, Column] = {"f3": F.col("rmspe_before") > 0.5 * F.col("spread"), "f4": F.col("heaviest.w") > 0.8, "f5": F.col("rank") > 2, "f7": F.col("shift") > 0.5}
    out = out.select("*", *[v.alias(k) for k, v in flags.items()])
    fired = F.array_join(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in flags])), ";")
    return out.select(*by, "n_before", "n_after", "gap", "rmspe_before", "rmspe_after", "ratio", "rank", "n_units", "p", F.col("heaviest.unit").alias("donor"), F.col("heaviest.w").alias("donor_weight"), "shift", "n_left_out", "did", "did_low", "did_high", *flags, F.when(F.col("gap").isNotNull(), fired).alias("fired"), "reason")


def fake_breaks(df: DataFrame, series: str, year: str, value: str, breaks: list[tuple[int, int]], term: str = "step", **options) -> DataFrame:
    """(series, break_year, fake_year, coef, low, high, fake_coef, fake_low, fake_high, repeats, reason): the segmented regression
    at each real break and at a fake one in the time before it (M13); repeats: the fake one has the effect's sign, half its size
    and an interval off 0; null where it couldn't be estimated. The fake fit sees the same years as the real one."""
    fits = {b: interrupted_series(df, series, year, value, b, **options).where(F.col("term") == term) for pair in breaks for b in pair}
    out = None
    for real, fake in breaks:
        a = fits[real].select("series", F.lit(real).alias("break_year"), F.lit(fake).alias("fake_year"), "coef", "low", "high")
        b = fits[fake].select(F.col("series").alias("of"), F.col("coef").alias("fake_coef"), F.col("low").alias("fake_low"), F.col("high").alias("fake_high"), "reason")
        one = a.join(b, a["series"].eqNullSafe(b["of"])).drop("of")
        out = one if out is None else out.unionByName(one)
    repeats = verdicts.replicates(*[F.col(c) for c in ("coef", "low", "high", "fake_coef", "fake_low", "fake_high")])
    return out.withColumn("repeats", F.when(F.col("fake_coef").isNotNull() & F.col("coef").isNotNull(), F.coalesce(repeats, F.lit(False))))
