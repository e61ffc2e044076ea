"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet and reread by the next.

1. quality rules: documents that fail them go;
2. line dedup: lines that many documents share go, except in one of them; n_chars follows the text;
3. n-gram Jaccard join: of documents linked at 80 % of their 5-word shingles the one with the smallest id stays;
4. mixing: each source comes to its target; documents are left out or repeated;
5. SentencePiece: each document of the mix as token ids.

Null and empty texts fail stage 1, so later stages see words only; documents with a null id or source pass as the operators
state. Repeated rows count as copies and one of them stays. Columns beyond those of documents pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, quality_rules, sentencepiece_codec, source_mixing
from tidemark.llm._store import free_names, keep

NEAR = jaccard_join.Rule(n=5, num=80, den=100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands and base rules."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others keep for them."""
    out = line_dedup.dedup_lines(docs)
    n_dropped = out.columns[-1]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without an id stay."""
    found = jaccard_join.near_duplicates(docs, rule=NEAR)
    stays, number = free_names(docs.columns, ["stays", "copy_number"])
    first = found.where(F.col("doc") == F.col("component")).select(F.col("doc").alias(stays)).distinct()
    stay = docs.join(first, docs["doc_id"].cast("long") == first[stays], "left_semi")
    row = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    stay = stay.withColumn(number, row).where(F.col(number) == 1).drop(number)
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as an epoch of its source reaches it."""
    return source_mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids) of each document of the mix."""
    out = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mixing", mixing), ("sentencepiece", encoding)]
#: SQL can't express zstandard nor the tokens: the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
