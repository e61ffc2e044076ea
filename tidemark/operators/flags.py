"""Quality flags (A49-A51): a derived row has the worst flag of those that it rests on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From best to worst.
ORDER = ("observed", "interpolated", "modelled")


def badness(flag: Column, order: tuple[str, ...] = ORDER) -> Column:
    """The place of a flag; unknown flags are worse than all."""
    return F.coalesce(*[F.when(flag == name, F.lit(k)) for k, name in enumerate(order)], F.lit(len(order)))


def worst(flag: str, order: tuple[str, ...] = ORDER) -> Column:
    """An aggregate: the worst flag of a group."""
    return F.max_by(F.col(flag), F.struct(badness(F.col(flag), order), F.col(flag)))


def joined(flag: str, order: tuple[str, ...] = ORDER, separator: str = "+") -> Column:
    """An aggregate: the flags of a group from best to worst."""
    pairs = F.array_sort(F.collect_set(F.struct(badness(F.col(flag), order).alias("place"), F.col(flag).alias("name"))))
    return F.array_join(F.transform(pairs, lambda x: x["name"]), separator)
