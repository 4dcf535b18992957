"""Keyed records from JSON lines: key resolution, upsert, ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_keys(lines: DataFrame, id_key: str | None = None) -> DataFrame:
    """lines (line_no, value) that aren't blank, with key: the id_key field, else id, else line_<line_no>."""
    fields = [F.get_json_object("value", f"$.{k}") for k in ([id_key] if id_key else []) + ["id"]]
    return lines.filter(~F.col("value").rlike(r"(?U)^\s*$")).withColumn("key", F.coalesce(*fields, F.concat(F.lit("line_"), F.col("line_no"))))


def upsert(keyed: DataFrame, rec: str = "value") -> DataFrame:
    """(key, first_line, rec): of a key's records the last, at the place of the first."""
    return keyed.groupBy("key").agg(F.min("line_no").alias("first_line"), F.max_by(rec, "line_no").alias(rec))


def with_ordinals(upserted: DataFrame, partition: str | None = None) -> DataFrame:
    """upserted with ordinal, from 0 in order of first_line.

    Stretches of lines are numbered in parallel; only their counts meet in one place.
    """
    by = [partition] if partition else []
    parts = upserted.withColumn("_part", F.floor(F.col("first_line") / 65536))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n")).select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_part", *by).orderBy("first_line")) - 1)
    return numbered.join(starts, ["_part", *by]).withColumn("ordinal", F.col("_start") + F.col("_i")).drop("_part", "_start", "_i")
