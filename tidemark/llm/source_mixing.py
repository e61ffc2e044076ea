"""Operator 9: mixing sources to target weights, with DataFrame operations only.

Sources in order (by code point, null last) get weights; together they share `share` times all sizes. A target stops at
`most` times its source's size and the excess is reshared by weight until none is above: with the sources sorted by
most * size / weight, the level of the others is the largest (total - what the ones before can take) / (weights from here).

Within a source, documents are sorted by a hash-random key. The key's leading bits are the bucket: bucket sums give each
bucket's offset, a window within the bucket gives the rest, so a source with a third of all documents is spread over all
buckets and no task sorts a whole source. A document takes its size for each whole epoch and, in the last epoch, the words
up to the budget, which the cut meets exactly.

Null text has size 0, null sources are one source, null ids share one key. Repeated rows are separate documents; rows with
equal id and size are interchangeable. A source without words gets nothing. An empty table gives an empty result. Other
columns stay; added columns get underscores if their names are taken. The number of buckets does not change the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import free_names, keep

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Documents in a bucket, about; the key has 60 bits.
BUCKET_DOCS, KEY_BITS = 4_000, 60
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def hash_key(id_col: str, seed: str = SEED) -> Column:
    """60 bits of the md5 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row for each source with its source_size. One row a source goes through one
    window; documents never do."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(here_on)
    levels = caps.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """The documents with size, source_size, target, taken (words) and copies (epochs that reach the document)."""
    names = free_names(docs.columns, ["size", "source_size", "target", "taken", "copies"])
    bits = min(24, max(4, math.ceil(math.log2(max(1, docs.count() / bucket_docs)))))
    # The user's columns stay in one, so that no name meets theirs.
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    sized = docs.select(own, F.col(id_col).alias("id"), F.col(source_col).alias("source"), (word_count(text_col) if size is None else size).alias("size"), hash_key(id_col, seed).alias("key"))
    sized = sized.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    sums = keep(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("offset")).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    offsets = offsets.select(F.col("source").alias("of"), F.col("bucket").alias("of_bucket"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.try_divide(budget, F.col("source_size")))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("offset") + F.col("before"))
    last = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest))
    taken = (epochs * F.col("size") + last).cast("long")
    copies = (F.when(F.col("size") > 0, epochs).otherwise(0) + (last > 0).cast("long")).cast("long")
    return joined.select("row.*", *[c.alias(n) for c, n in zip((F.col("size"), F.col("source_size"), F.col("target"), taken, copies), names, strict=True)])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as an epoch reaches it, with its own columns. The document at the cut stays
    whole."""
    out = mix(docs, **options)
    copies = out.columns[-1]
    rows = out.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return rows.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document with the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = keep(docs.select("doc_id", "source", word_count("text").alias("n_words")), "mix-sizes")
    return mix(sizes, size=F.col("n_words")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(concat('0x', substr(md5(concat('mix-1:', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS key
  FROM documents
), caps AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * 2 AS BIGINT) AS cap,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
