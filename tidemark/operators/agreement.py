"""Agreement of maps and stratified accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959964


def jaccard_at_cuts(a: DataFrame, b: DataFrame, key: list[str], flag: str, score: str, cuts: list[float]) -> DataFrame:
    """(cut, shared, only_a, only_b, jaccard, recall, area_error) of a mask against a score above each cut. One full join, one
    row a key; the cuts are an array in the plan, not a join."""
    sides = a.select(*key, F.col(flag).alias("a")).join(b.select(*key, F.col(score).alias("b")), key, "full_outer")
    rows = sides.select(F.coalesce("a", F.lit(False)).alias("a"), "b", F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut"))
    hit = F.coalesce(F.col("b") >= F.col("cut"), F.lit(False))
    n = rows.groupBy("cut").agg(F.count_if(F.col("a") & hit).alias("shared"), F.count_if(F.col("a") & ~hit).alias("only_a"), F.count_if(~F.col("a") & hit).alias("only_b"))
    both, a_all, b_all = F.col("shared").cast("double"), F.col("shared") + F.col("only_a"), F.col("shared") + F.col("only_b")
    return n.withColumn("jaccard", F.try_divide(both, a_all + F.col("only_b"))).withColumn("recall", F.try_divide(both, b_all)).withColumn("area_error", F.try_divide((a_all - b_all).cast("double"), b_all))


def stratified_accuracy(sample: DataFrame, stratum: str, weight: str, mapped: str, truth: str) -> DataFrame:
    """(overall, se, users, producers, kappa, n) of a two-class map from a stratified sample: stratum means are weighted by the
    strata's shares; undecided truth (null) doesn't count."""
    known = sample.where(F.col(truth).isNotNull())
    p = lambda c: F.avg(c.cast("double"))
    m, t = F.col(mapped), F.col(truth)
    s = known.groupBy(stratum).agg(F.max(weight).alias("w"), F.count("*").alias("n"), p(m == t).alias("right"), F.var_samp((m == t).cast("double")).alias("var"), p(m & t).alias("tp"), p(m).alias("mapped"), p(t).alias("true"))
    w = F.col("w") / F.sum("w").over(_all())
    s = s.withColumn("w", w)
    out = s.agg(
        F.sum(F.col("w") * F.col("right")).alias("overall"),
        F.sqrt(F.sum(F.when(F.col("n") > 1, F.col("w") * F.col("w") * F.col("var") / F.col("n")))).alias("se"),
        F.try_divide(F.sum(F.col("w") * F.col("tp")), F.sum(F.col("w") * F.col("mapped"))).alias("users"),
        F.try_divide(F.sum(F.col("w") * F.col("tp")), F.sum(F.col("w") * F.col("true"))).alias("producers"),
        F.sum(F.col("w") * F.col("mapped")).alias("pm"), F.sum(F.col("w") * F.col("true")).alias("pt"), F.sum("n").alias("n"),
    )
    chance = F.col("pm") * F.col("pt") + (1 - F.col("pm")) * (1 - F.col("pt"))
    return out.withColumn("kappa", F.try_divide(F.col("overall") - chance, 1 - chance)).drop("pm", "pt")


def area_matrix(sample: DataFrame, stratum: str, weight: str, mapped: str, truth: str) -> DataFrame:
    """(mapped, truth, n, share) of any number of classes: each point stands for weight / points of its stratum of the design,
    whatever its class on the map; undecided truth (null) doesn't count (A19)."""
    known = sample.where(F.col(truth).isNotNull())
    strata = known.groupBy(stratum).agg(F.count("*").alias("n_h"))
    cells = known.groupBy(stratum, mapped, truth).agg(F.count("*").alias("n"), F.max(weight).alias("w"))
    return cells.join(F.broadcast(strata), stratum).groupBy(mapped, truth).agg(F.sum("n").alias("n"), F.sum(F.col("w") * F.col("n") / F.col("n_h")).alias("share"))  # a row a stratum


def estimated_accuracy(sample: DataFrame, stratum: str, weight: str, mapped: str, truth: str, target: str) -> DataFrame:
    """One row: overall accuracy, kappa, and users' and producers' accuracy of a class, with half widths of their 95 % intervals
    (ratios by linearisation, variances within strata of two points or more), the numbers of points, and what one point of
    each stratum weighs at most (A19)."""
    known = sample.where(F.col(truth).isNotNull())
    m, t = F.col(mapped), F.col(truth)
    right, hit, on_map, real = ((c).cast("double") for c in (m == t, (m == target) & (t == target), m == target, t == target))
    moments = {"right": right, "hit": hit, "map": on_map, "real": real}
    columns = [F.avg(c).alias(f"m_{k}") for k, c in moments.items()]
    columns += [F.covar_samp(a, b).alias(f"v_{k}") for k, (a, b) in {"right": (right, right), "hit": (hit, hit), "map": (on_map, on_map), "real": (real, real), "hit_map": (hit, on_map), "hit_real": (hit, real)}.items()]
    s = known.groupBy(stratum).agg(F.max(weight).alias("w"), F.count("*").alias("n"), *columns)
    total = lambda k: F.sum(F.col("w") * F.col(f"m_{k}"))
    spread = lambda k: F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("w") * F.col("w") * F.col(f"v_{k}") / F.col("n"))), F.lit(0.0))
    sums = s.agg(*[total(k).alias(k) for k in moments], *[spread(k).alias(f"s_{k}") for k in ("right", "hit", "map", "real", "hit_map", "hit_real")], F.sum("n").alias("n"), F.max(F.col("w") / F.col("n")).alias("leverage"))
    cells = area_matrix(sample, stratum, weight, mapped, truth)
    sides = cells.groupBy(F.col(mapped).alias("c")).agg(F.sum("share").alias("a")).join(cells.groupBy(F.col(truth).alias("c")).agg(F.sum("share").alias("b")), "c")
    chance = sides.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("chance"))
    undecided = sample.agg(F.count_if(F.col(truth).isNull()).alias("n_undecided"))
    one = sums.crossJoin(F.broadcast(chance)).crossJoin(F.broadcast(undecided))  # one row each

    def ratio(base: str) -> tuple[Column, Column]:
        r = F.try_divide(F.col("hit"), F.col(base))
        var = F.col("s_hit") - 2 * r * F.col(f"s_hit_{base}") + r * r * F.col(f"s_{base}")
        return r, Z95 * F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), F.col(base))

    users, producers = ratio("map"), ratio("real")
    return one.select(
        F.col("right").alias("overall"), (Z95 * F.sqrt("s_right")).alias("overall_ci"), F.try_divide(F.col("right") - F.col("chance"), 1 - F.col("chance")).alias("kappa"),
        users[0].alias("users"), users[1].alias("users_ci"), producers[0].alias("producers"), producers[1].alias("producers_ci"), "n", "n_undecided", "leverage",
    )


def mapped_strata_accuracy(sample: DataFrame, weights: DataFrame, mapped: str, truth: str) -> DataFrame:
    """(class, weight, n, users, users_ci, producers, leverage, overall, overall_ci, kappa) where the strata are the classes of the
    map, with binomial variances (A20). weights: (class, weight), the prevalence of each class; leverage: the most that a point
    of another class weighs."""
    known = sample.where(F.col(truth).isNotNull())
    right, n = F.count_if(F.col(mapped) == F.col(truth)), F.count("*")
    s = weights.join(known.groupBy(F.col(mapped).alias("class")).agg(n.alias("n"), right.alias("right")), "class", "left").na.fill(0, ["n", "right"])
    s = s.withColumn("users", F.try_divide(F.col("right"), F.col("n"))).withColumn("one", F.try_divide(F.col("weight"), F.col("n")))
    cells = known.groupBy(F.col(mapped).alias("class"), F.col(truth).alias("real")).agg(n.alias("k")).join(s.select("class", "one"), "class")
    real = cells.groupBy(F.col("real").alias("class")).agg(F.sum(F.col("one") * F.col("k")).alias("real_share"))
    s = s.join(real, "class", "left").na.fill(0.0, ["real_share"])
    hit = F.col("weight") * F.col("users")
    every = _all()
    overall, chance = F.sum(hit).over(every), F.sum(F.when(F.col("n") > 0, F.col("weight")).otherwise(0.0) * F.col("real_share")).over(every)
    spread = F.sum(F.when(F.col("n") > 1, F.col("weight") * F.col("weight") * F.col("users") * (1 - F.col("users")) / (F.col("n") - 1))).over(every)
    others = F.array_max(F.transform(F.filter(F.collect_list(F.struct("class", "one")).over(every), lambda x: x["class"] != F.col("class")), lambda x: x["one"]))
    return s.select(
        "class", "weight", "n", "users", F.when(F.col("n") > 1, Z95 * F.sqrt(F.col("users") * (1 - F.col("users")) / (F.col("n") - 1))).alias("users_ci"),
        F.try_divide(hit, F.col("real_share")).alias("producers"), others.alias("leverage"), overall.alias("overall"), (Z95 * F.sqrt(spread)).alias("overall_ci"), F.try_divide(overall - chance, 1 - chance).alias("kappa"),
    )


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # one row a stratum


def confusion(sample: DataFrame, mapped: str, truth: str) -> DataFrame:
    return sample.groupBy(mapped, truth).agg(F.count("*").alias("n"))


def looked_up(df: DataFrame, other: DataFrame, on: list[str], column: str, default: Column | None = None) -> DataFrame:
    """The other table's column by key, a default where it has none."""
    out = df.join(other.select(*on, column), on, "left")
    return out if default is None else out.withColumn(column, F.coalesce(F.col(column), default))
