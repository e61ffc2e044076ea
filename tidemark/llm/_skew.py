"""A join that no hot key puts into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds this part of all rows or more; there are so many heavy keys at most.
HEAVY = 10_000


def left_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, salt: Column) -> DataFrame:
    """`left` with the columns of `right`, which has one row a key, with at least in column `n` how many of `total` rows of
    `left` hold it. Heavy keys, HEAVY rows at most, come by broadcast; the rows that have them are dealt by `salt` where the
    others are dealt by key. Null keys meet nothing and are dealt by `salt` too."""
    bar, values = max(2, -(-total // HEAVY)), [c for c in right.columns if c not in keys]
    heavy = right.where(F.col(n) >= bar).select(*keys, F.lit(True).alias("heavy__"), *[F.col(v).alias(f"heavy__{v}") for v in values])
    light = right.where(F.col(n) < bar).select(*[F.col(k).alias(f"key__{k}") for k in keys], *[F.col(v).alias(f"light__{v}") for v in values])
    some = left.join(F.broadcast(heavy), keys, "left")  # HEAVY rows at most
    alone = F.col("heavy__").isNull() & F.col(keys[0]).isNotNull()
    some = some.withColumn("dealt__", F.when(alone, F.col(keys[0]).cast("long")).otherwise(salt))
    same = (F.col("dealt__") == F.col(f"key__{keys[0]}")) & F.col("heavy__").isNull() & F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        same &= F.col(k) == F.col(f"key__{k}")
    both = some.join(light.hint("merge"), same, "left")  # can spill, and is the same at every size
    return both.select(*left.columns, *[F.when(F.col("heavy__"), F.col(f"heavy__{v}")).otherwise(F.col(f"light__{v}")).alias(v) for v in values])
