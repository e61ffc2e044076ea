"""The marker program (A45-A48, P33-P35, J26, C44-C45): named numbers over tables, resolved in one scan a table.

A marker is a dict: table; column; where and where_not (column -> value); statistic: unique, max, min or count; transform:
complement_pct or fraction_to_pct. A derived marker has op: difference, ratio or change_pct, and a and b, names of others.
Each result has a value or an error, never a substitute number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.words import same_value


def _chosen(marker: dict) -> Column:
    keep = F.lit(True)
    for column, value in marker.get("where", {}).items():
        keep = keep & same_value(F.col(column), value)
    for column, value in marker.get("where_not", {}).items():
        keep = keep & ~same_value(F.col(column), value)
    return keep


def _aggregate(marker: dict) -> Column:
    """A struct of value and error for one marker, as an aggregate with a condition of its own."""
    rows, kind = F.count_if(_chosen(marker)), marker.get("statistic", "unique")
    if kind == "count":
        return F.struct(rows.cast("double").alias("value"), F.lit(None).cast("string").alias("error"))
    value = F.when(_chosen(marker), F.col(marker["column"]).cast("string").try_cast("double"))
    pick = F.max(value) if kind in ("max", "unique") else F.min(value)
    shown = {"complement_pct": 100 * (1 - pick), "fraction_to_pct": 100 * pick}.get(marker.get("transform"), pick)
    if kind == "unique":
        error = F.when(rows != 1, F.format_string("%d rows instead of 1", rows)).when(pick.isNull(), "no number")
    else:
        error = F.when(rows == 0, "no rows").when(pick.isNull(), "no number")
    return F.struct(F.when(error.isNull(), shown).alias("value"), error.alias("error"))


def _order(markers: dict[str, dict]) -> list[str]:
    """Names so that each comes after those that it needs; names in a circle are left out."""
    done: list[str] = []
    left = {n: {m["a"], m["b"]} & set(markers) if "op" in m else set() for n, m in markers.items()}
    while ready := [n for n, needs in left.items() if needs <= set(done)]:
        done += ready
        for n in ready:
            del left[n]
    return done


def resolve(spark: SparkSession, markers: dict[str, dict], tables: dict[str, DataFrame]) -> DataFrame:
    """(marker, value, error) of every marker."""
    plain = {n: m for n, m in markers.items() if "op" not in m}
    rows: DataFrame | None = None
    for table in sorted({m["table"] for m in plain.values()}):
        own = {n: m for n, m in plain.items() if m["table"] == table}
        one = tables[table].agg(*[_aggregate(m).alias(n) for n, m in own.items()])
        rows = one if rows is None else rows.crossJoin(one)  # one row each
    if rows is None:
        rows = spark.range(1).select()
    order = _order(markers)
    for name in order:
        m = markers[name]
        if "op" in m:
            lost = [x for x in (m["a"], m["b"]) if x not in markers]
            if lost:
                rows = rows.withColumn(name, F.struct(F.lit(None).cast("double").alias("value"), F.lit(f"unknown marker {lost[0]}").alias("error")))
                continue
            a, b = F.col(f"`{m['a']}`.value"), F.col(f"`{m['b']}`.value")
            value = {"difference": a - b, "ratio": F.try_divide(a, b), "change_pct": 100 * F.try_divide(a - b, b)}[m["op"]]
            error = F.coalesce(F.col(f"`{m['a']}`.error"), F.col(f"`{m['b']}`.error"), F.when(value.isNull(), "not finite"))
            rows = rows.withColumn(name, F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error")))
    for name in set(markers) - set(order):
        rows = rows.withColumn(name, F.struct(F.lit(None).cast("double").alias("value"), F.lit("circular").alias("error")))
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("marker"), F.col(f"`{n}`.value").alias("value"), F.col(f"`{n}`.error").alias("error")) for n in markers])).alias("r")).select("r.*")
