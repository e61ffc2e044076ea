import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import reports

ROWS = [("a", 2000, 1.0, "observed"), ("a", 2010, 2.0, "observed"), ("a", 2020, 3.0, "modelled"), ("b", 2015, 7.0, "modelled"), ("c", 2000, 4.0, "observed"), ("c", 2020, None, "modelled"), ("d", 2000, None, None)]


def _series(spark):
    return spark.createDataFrame(ROWS, "u string, y int, v double, f string")


def test_a_single_modelled_value_is_no_projection(spark):
    got = {r.u: tuple(r)[1:] for r in reports.census_and_projection(_series(spark), ["u"], "y", "v", "f").collect()}
    assert got == {"a": (2010, 2.0, 2020, 3.0), "b": (2015, 7.0, None, None), "c": (2000, 4.0, None, None)}


def test_solid_and_dashed_lines_meet(spark):
    got = {(r.u, r.y): (r.solid, r.dashed) for r in reports.solid_and_dashed(_series(spark), ["u"], "y", "v", "f").collect()}
    assert got[("a", 2000)] == (1.0, None) and got[("a", 2010)] == (2.0, 2.0) and got[("a", 2020)] == (None, 3.0)
    assert got[("b", 2015)] == (None, 7.0) and got[("d", 2000)] == (None, None)


def test_missing_columns_are_errors(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "k int, dev_x double, dev_y double")
    assert reports.by_prefix(df, ["k"], "dev_", ["y_built"]).collect()[0].value == 2.0
    with pytest.raises(PySparkException):
        reports.by_prefix(df, ["k"], "dev_", ["x_built"]).collect()
    with pytest.raises(KeyError):
        reports.restricted_range(df, ["k"], "dev_", ["x", "z"])


def test_ties_empty_tables_and_nulls(spark):
    ties = spark.createDataFrame([("u", 3, 5.0), ("u", 1, 5.0), ("u", 2, None)], "g string, y int, v double")
    assert tuple(reports.extremes(ties, ["g"], "v", "y").collect()[0]) == ("u", 5.0, 1, 5.0, 1, 5.0, 2)
    assert reports.extremes(ties.limit(0), ["g"], "v", "y").count() == 0
    assert reports.ratio_to_unit(ties.withColumn("v", F.lit(0.0)), "g", "none", ["y"], "v").where("ratio IS NOT NULL").count() == 0
    assert reports.exclusivity(spark.createDataFrame([("r", 0.5, None), ("r", 0.25, 0.5)], "g string, a double, b double"), ["g"], ["a", "b"]).collect()[0][1:] == (0.75, 1)
