"""A corpus pipeline of five stages, each an operator of factloom.llm: STAGES, run and ORACLE_SQL.

Each stage's rows are written as Parquet in the shared folder and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from factloom.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8: the contract of four words and 0.85 is the query's alone."""
    return ngram_join.one_of_each(docs, shingle=5, similarity=(80, 100))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs.withColumn("doc_id", F.col("doc_id").cast("long")))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("packing", pack)]

#: Tokenizer ids and the trained classifier have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
