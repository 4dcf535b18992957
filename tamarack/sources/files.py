"""File sources and sinks: JSON lines, dictionaries, vector tables, images, audio, inventories, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.jsonx import strict
from tamarack.functions.text import basename
from tamarack.operators.records import resolve_keys, upsert, with_ordinals
from tamarack.sources.sink import write_files  # noqa: F401

IMAGES = "*.{png,jpg,jpeg}"
AUDIO = "*.{wav,mp3,m4a,ogg}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) with physical line numbers from 0, blank lines counted; files are split and read in parallel."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("_id"), "value")
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("_id")) - 1
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return raw.withColumn("i", inside).join(starts, ["file", "start"]).select("file", (F.col("first") + F.col("i")).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str, id_key: str | None = None) -> DataFrame:
    """(key, ordinal, first_line, rec) of a file of JSON lines; a line that isn't JSON is an error.

    Of a key's records the last counts, at the place of the first. A missing file is Spark's
    PATH_NOT_FOUND.
    """
    keyed = resolve_keys(numbered_lines(spark, path), id_key)
    bad = F.concat(F.lit("not JSON, line "), F.col("line_no"))
    checked = keyed.withColumn("value", F.when(strict(F.col("value")).isNull(), F.raise_error(bad).cast("string")).otherwise(F.col("value")))
    return with_ordinals(upsert(checked)).select("key", "ordinal", "first_line", F.col("value").alias("rec"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, count) of a file of terms and counts."""
    return spark.read.csv(path, sep=" ", schema="term STRING, count BIGINT")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A table of ordinal and embedding (float arrays)."""
    return spark.read.parquet(path).withColumn("embedding", F.col("embedding").cast("array<float>"))


def write_vectors(df: DataFrame, path: str, by: str = "kb") -> None:
    """Writes (kb, ordinal, embedding) so that a search in one index reads its files only."""
    df.write.partitionBy(by).parquet(path)


def read_binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files whose names match, at any depth."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return read_binary(spark, path, IMAGES)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    return read_binary(spark, path, AUDIO)


def inventory(spark: SparkSession, path: str, folders: set[str] | None = None, code: str = ".py", whole: str | None = None) -> DataFrame:
    """(folder, name, bytes, text): the files below path, with the text of those that end in ``code``.

    folders keeps those all of whose parent folders below path are in it. Files without text are
    listed without reading them. A file that isn't UTF-8 has a text that says so. A folder whose
    name ends in ``whole``, as that of a table of several parts, is one entry with the bytes of all
    files in it.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = base.load(path).select("path", F.col("length").alias("bytes"))
    # by the names: a filter on path comes after the contents of all files were read
    coded = base.option("pathGlobFilter", "*" + re.sub(r"([][*?{}\\])", r"\\\1", code)).load(path)
    text = coded.filter(F.endswith("path", F.lit(code))).select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.lit("[Error reading file: not UTF-8]")).alias("text"))
    inner = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    out = listed.join(text, "path", "left").withColumn("path", inner)
    if whole is not None:
        at = F.regexp_extract("path", rf"^(?:[^/]+/)*?[^/]*{re.escape(whole)}(?=/)", 0)
        out = out.groupBy(F.coalesce(F.nullif(at, F.lit("")), "path").alias("path")).agg(F.sum("bytes").alias("bytes"), F.min(F.when(at == "", F.col("text"))).alias("text"))
    out = out.withColumn("folder", F.regexp_replace("path", r"/?[^/]*$", ""))
    if folders is not None:
        out = out.filter(F.forall(F.filter(F.split("folder", "/"), lambda f: f != ""), lambda f: f.isin(*folders)))
    return out.select("folder", basename(F.col("path")).alias("name"), "bytes", "text")


def code_dump(files: DataFrame, main: str | None = None, by: str | None = None) -> DataFrame:
    """(text): one row, the inventory as text: folders in order, then their files, code between marks.

    With ``by``, (by, text): a row for each value of that column, which is then its main folder.
    """
    keys = [by] if by else []
    each = F.when(F.col("text").isNull(), F.concat(F.lit("\nFile: "), "name")).otherwise(F.concat(F.lit("\nFile: "), F.col("name"), F.lit("\n------ CODE START ------\n"), F.col("text"), F.lit("\n------ CODE END ------")))
    lines = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(col)), lambda x: x["t"]), "\n")
    folders = files.groupBy(*keys, "folder").agg(lines(F.struct("name", each.alias("t"))).alias("body"))
    head = F.when(F.col("folder") == "", F.col("body")).otherwise(F.concat(F.lit("\nSubfolder: "), "folder", F.lit("\n"), "body"))
    whole = folders.groupBy(*keys).agg(lines(F.struct("folder", head.alias("t"))).alias("b"))
    return whole.select(*keys, F.concat_ws("\n", F.concat(F.lit("Main Folder: "), F.col(by) if by else F.lit(main)), F.nullif("b", F.lit(""))).alias("text"))


def write_report(df: DataFrame, col: str, path: str) -> None:
    """Writes a text column, a report a row."""
    df.select(col).write.text(path)
