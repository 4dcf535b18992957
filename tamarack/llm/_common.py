"""Shared helpers of the training-data operators: lineage cuts, row identity, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.lineage import BROADCAST_BYTES, cut, maybe_broadcast, shared_dir, with_row, without_row  # noqa: F401  for the operators

#: ASCII white space, the characters of ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def emptied(spark: SparkSession, path: str) -> None:
    """Frees the space of an intermediate folder in the shared store by an empty table in its place."""
    spark.createDataFrame([], "gone string").write.mode("overwrite").parquet(path)


def ascii_lower(c: Column) -> Column:
    """c with A-Z, and nothing else, in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_rows(df: DataFrame, gone: DataFrame, row: str = "_tmk_row") -> DataFrame:
    """The rows of df (made by with_row) whose identity isn't in gone, without that column."""
    return without_row(df.join(maybe_broadcast(cut(gone.select(row)), 48), row, "left_anti"), row)
