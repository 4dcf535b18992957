"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Digests that no other row has leave at once. Of the others, every input partition forms a run:
its digests, each once, sorted, with the best row and the number of rows. In binomial rounds, runs
whose numbers agree but for the low bits meet, are put in the order of their digests and merged,
FAN of them at a time (log2(FAN) rounds of a binomial tree in one multiway merge), until one run is
left. A run is itself spread over tasks by digest, so no level needs a large task, and a digest
arrives at a merge at most FAN times, however many rows have it. The way back hands each run the
row to keep, so the documents join only with the run of their own partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm import _common as c

#: Runs that one merge takes: four binomial rounds.
FAN = 16
#: A digest with what verifies it: rows that agree in the SHA-256 but not in these stay apart.
KEY = ["sha", "bytes", "check"]


def normalised(text: Column) -> Column:
    """text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_tmk_row, id, run, KEY, best) of each row; the least best of a group is the row that stays."""
    text = rows.select("_tmk_row", F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("bare", normalised(F.col("text")))
    best = F.struct((-F.length("text")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("_tmk_row").alias("row"))
    return text.select("_tmk_row", "id", F.spark_partition_id().alias("run"), F.unhex(F.sha2("bare", 256)).alias("sha"), F.octet_length("bare").alias("bytes"), F.xxhash64("bare").alias("check"), best.alias("best"))


def merged(runs: DataFrame) -> DataFrame:
    """Sorted runs (run, KEY, best, n) that now have the same number, as one sorted run with each digest once.

    The rows of a run are dealt by digest, put in order, and aggregated in that order.
    """
    dealt = runs.repartition("run", *KEY).sortWithinPartitions("run", *KEY)
    return dealt.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_duplicates(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of rows (which has _tmk_row): _tmk_row, id, keep_id, group_size, kept, text_sha256.

    Texts, whole and of any length, are equal if they are after ASCII white space is deleted; null
    is as empty. Of equal texts that with the most code points stays, then that with the smallest id
    (a null id comes last), then the first row, so one row of each group has kept, also among
    repeated rows. An empty table gives no rows; other columns, whatever their names, don't matter.
    """
    found = c.cut(digests(rows, id_col, text_col))
    often = c.cut(found.groupBy("check").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("check"))
    often = c.maybe_broadcast(often, 32)
    alone = found.join(often, "check", "left_anti").withColumn("n", F.lit(1).cast("long"))
    found = c.cut(found.join(often, "check", "left_semi"))
    level = c.cut(found.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n")).sortWithinPartitions("run", *KEY))
    levels, runs = [level], (found.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        levels.append(c.cut(merged(levels[-1].withColumn("run", F.floor(F.col("run") / FAN).cast("int")))))
        runs = -(-runs // FAN)
    of = levels.pop()
    while levels:
        own = levels.pop().select("run", F.floor(F.col("run") / FAN).cast("int").alias("up"), *KEY)
        of = own.join(of.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    names = ["_tmk_row", "id", "sha", "best", "n"]
    out = found.drop("best").join(of, ["run", *KEY]).select(*names).union(alone.select(*names))
    return out.select("_tmk_row", F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_tmk_row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, without the rows that exact_duplicates doesn't keep; repeated rows are duplicates too."""
    rows = c.with_row(docs)
    return c.without_rows(rows, exact_duplicates(rows, id_col, text_col).filter("not kept"))


#: For documents.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), e AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM e
"""
