"""Rules that turn estimates into verdicts (P24-P31, A41-A43, W13): every verdict comes with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def branch_state(coef: Column, low: Column, high: Column) -> Column:
    """tested if the interval lies on one side of 0, else not applicable; not estimable without numbers (P25)."""
    return F.when(coef.isNull() | low.isNull() | high.isNull(), "not estimable").when(low * high > 0, "tested").otherwise("not applicable")


def replicates(real: Column, real_low: Column, real_high: Column, placebo: Column, placebo_low: Column, placebo_high: Column, share: float = 0.5) -> Column:
    """Whether a placebo repeats an effect: same sign, at least a share of its size, and an interval off 0."""
    return (F.signum(real) == F.signum(placebo)) & (F.abs(placebo) >= share * F.abs(real)) & (placebo_low * placebo_high > 0) & (real_low * real_high > 0)


def placebo_verdict(df: DataFrame, group: list[str], repeats: str, least: int = 2) -> DataFrame:
    """(group, n, repeated, verdict, reason): fail if `least` placebos repeat the effect; not estimable if none could be
    estimated (A41). repeats is null where a placebo couldn't be estimated."""
    out = df.groupBy(*group).agg(F.count(repeats).alias("n"), F.count_if(F.coalesce(F.col(repeats), F.lit(False))).alias("repeated"))
    verdict = F.when(F.col("n") == 0, "not estimable").when(F.col("repeated") >= least, "fail").otherwise("pass")
    return out.withColumn("verdict", verdict).withColumn("reason", F.when(F.col("n") == 0, "no placebo could be estimated").otherwise(F.format_string("%d of %d placebos repeat the effect", "repeated", "n")))


def transition(before: Column, after: Column) -> Column:
    """How a verdict changed."""
    return F.when(before == after, F.concat(F.lit("still "), after)).otherwise(F.concat(before, F.lit(" to "), after))


def sign_agreement(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, agree, n, share) of the signs of two series of changes; changes of 0 don't count."""
    both = df.where((F.col(a) != 0) & (F.col(b) != 0))
    out = both.groupBy(*group).agg(F.count_if(F.signum(a) == F.signum(b)).alias("agree"), F.count("*").alias("n"))
    return out.withColumn("share", F.try_divide(F.col("agree").cast("double"), F.col("n")))


def variable_name(*parts: Column) -> Column:
    """metric, since, year, layer … in one name; parts that are null are left out."""
    return F.concat_ws("_", *parts)
