"""The corpus pipeline: quality, exact and near duplicates, benchmark leaks, source mix.

Each stage takes the documents that its predecessor kept and returns their columns; the last one
adds mix_copy, as it returns a row for each copy that the mix takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import decontam, exact_dedup, mixing, quality, simhash
from tamarack.llm._common import emptied, read, shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, of those it is given."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class whose five-word shingles are 0.8 alike or more, candidates by SimHash."""
    return simhash.drop_similar(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_exact), ("SimHash near-dedup", drop_near), ("benchmark decontamination", drop_leaks), ("mixing sources to target weights", mix_sources)]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to a table in the shared folder and read again; only the last table stays."""
    docs, at = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{at}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            emptied(spark, f"{at}/{i - 1}")
    return docs
