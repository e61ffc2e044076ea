"""Training samples, forests and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import classes


def hash_order(columns: list[str], seed: int) -> Column:
    """A reproducible random number from 0 to 1 for each row, whatever its partition."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def training_sample(df: DataFrame, key: list[str], label: str, size: int, floor: int, seed: int = 20250907) -> DataFrame:
    """`size` rows at random, all if there are fewer, and of each class that has fewer than `floor` of them as many more as it
    takes, if the class has them (M17). The smallest hashes are drawn; each row is first kept at a rate that leaves a few times as
    many, so that only those are ordered."""
    known = df.where(F.col(label).isNotNull()).withColumn("order__", hash_order(key, seed))
    counts = known.groupBy(label).agg(F.count("*").alias("n__"))
    total = counts.agg(F.coalesce(F.sum("n__"), F.lit(0))).first()[0]
    spare = lambda n: 1.5 * n + 100
    rough = known.where(F.col("order__") < spare(size) / max(1, total))
    cut = rough.select("order__", *key).orderBy("order__", *key).limit(size).agg(F.max(F.struct("order__", *key)).alias("last__"))
    main = rough.crossJoin(F.broadcast(cut)).where(F.struct("order__", *key) <= F.col("last__")).drop("last__")  # one row
    have = main.groupBy(label).agg(F.count("*").alias("have__"))
    lack = counts.join(have, label, "left").select(label, "n__", (F.lit(floor) - F.coalesce("have__", F.lit(0))).alias("lack__")).where("lack__ > 0")
    rest = known.join(F.broadcast(lack), label).where(F.col("order__") < (F.lit(size) / max(1, total) + spare(floor) / F.col("n__")))  # a row a class
    rest = rest.join(main.select(*key), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(label).orderBy("order__", *key))
    more = rest.withColumn("place__", place).where(F.col("place__") <= F.col("lack__"))
    return main.select(*df.columns).unionByName(more.select(*df.columns))


def stratified_draw(df: DataFrame, key: list[str], stratum: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum by hash, with a blind number that says nothing of the order (M21, W20). Each row is first
    drawn at a rate that leaves a few times n; the exact n are then the smallest hashes of those."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n__"))
    order = hash_order(key, seed)
    some = df.join(F.broadcast(counts), stratum).withColumn("order__", order).where(F.col("order__") < F.lit(4.0 * n + 40) / F.col("n__"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("order__", *key))
    drawn = some.withColumn("rank__", rank).where(F.col("rank__") <= n)
    return drawn.withColumn("blind_id", F.sha2(F.concat_ws("|", F.lit(seed), *key), 256)).drop("n__", "order__", "rank__")


def bare_soil(df: DataFrame, medians: dict[str, float | Column]) -> Column:
    """Soil brighter and less green than the landscape's medians."""
    return (F.col("swir16") > medians["swir16"]) & (F.col("ndvi") < medians["ndvi"]) & (F.col("ndbi") > medians["ndbi"])


def landscape_median(df: DataFrame, column: str, where: Column) -> DataFrame:
    """One row: the median over a reference mask; an empty mask is an error."""
    return classes.medians(df, {column: column}, where).select(column)


def forest(sample: DataFrame, features: list[str], label: str, trees: int = 300, seed: int = 20250907):
    """A random forest with square-root features and half bags (M18); returns the fitted pipeline. Importances are in its last
    stage."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    steps = [VectorAssembler(inputCols=features, outputCol="features__", handleInvalid="skip"), StringIndexer(inputCol=label, outputCol="label__", stringOrderType="alphabetAsc")]
    return Pipeline(stages=[*steps, RandomForestClassifier(featuresCol="features__", labelCol="label__", numTrees=trees, featureSubsetStrategy="sqrt", subsamplingRate=0.5, seed=seed)]).fit(sample)


def importances(model, features: list[str]) -> dict[str, float]:
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True))


def classified(model, df: DataFrame, features: list[str], out: str = "class") -> DataFrame:
    """The class of every row; null where a feature is missing."""
    names = F.array(*[F.lit(x) for x in model.stages[1].labels])
    ready = df.where(F.forall(F.array(*[F.col(f) for f in features]), lambda x: x.isNotNull()))
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="features__").transform(ready)
    done = model.stages[-1].transform(vectors).withColumn(out, F.element_at(names, F.col("prediction").cast("int") + 1)).select(*df.columns, out)
    rest = df.where(~F.forall(F.array(*[F.col(f) for f in features]), lambda x: x.isNotNull())).withColumn(out, F.lit(None).cast("string"))
    return done.unionByName(rest)
