"""Lineage cuts, tables made once in a folder that all executors share, and identities of rows."""

from __future__ import annotations

import re
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of a join may be broadcast after its size was measured.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one where that is unset, in local mode only."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tamarack-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


#: While a cut is made: shuffles leave the disks when it is done, and workers get at most so many rows of texts at once.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
#: Cuts under way, by session, with the settings that the last of them puts back.
_UNDER_WAY: dict[int, tuple[int, dict]] = {}
_LOCK = threading.Lock()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; the shuffles that made it leave the disks.

    Cuts in several threads share the settings; the last one to end puts the session's own back.
    """
    shared_dir(df.sparkSession)
    conf, key = df.sparkSession.conf, id(df.sparkSession)
    with _LOCK:
        n, before = _UNDER_WAY.get(key) or (0, {k: conf.get(k, None) for k in _SETTINGS})
        _UNDER_WAY[key] = (n + 1, before)
        if not n:
            for k, v in _SETTINGS.items():
                conf.set(k, v)
    try:
        return df.checkpoint(eager=True)
    finally:
        with _LOCK:
            n, before = _UNDER_WAY.pop(key)
            if n > 1:
                _UNDER_WAY[key] = (n - 1, before)
            else:
                for k, v in before.items():
                    conf.unset(k) if v is None else conf.set(k, v)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in a store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows fit the limit. df should be cheap to count (cut before)."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bits of an identity for the place in a file; files whose numbers are broadcast at most.
_ROWS, _LISTED = 40, 200_000


def _scans_files(df: DataFrame) -> bool:
    """Whether df is deterministic columns and filters over one table of Parquet files, each read once, so each row has a place of its own."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or not plan.toString().rstrip().endswith(" parquet"):
        return False
    files = plan.relation().location().allFiles()
    return files.distinct().size() == files.size()


def with_row(df: DataFrame, name: str = "_tmk_row") -> DataFrame:
    """df with an identity for each row, equal whenever and wherever the result is planned again.

    Rows of Parquet files are identified by the number of their file, by path, and their place in it,
    however the files are split into tasks. Any other df, one that reads a file twice or isn't
    deterministic among them, is written once to the shared folder, with an identity given there.
    Columns of df that are named like the identity get one more underscore until without_row takes
    it away.
    """
    for x in sorted(df.columns, key=len, reverse=True):
        if re.fullmatch(f"{name}_*", x, re.IGNORECASE):
            df = df.withColumnRenamed(x, f"{x}_")
    if _scans_files(df):
        at = df.metadataColumn("_metadata")
        paths = sorted(r[0] for r in df.select(at["file_path"]).distinct().limit(_LISTED + 1).collect())
        if len(paths) <= _LISTED:
            own = name + "_at"
            while own.lower() in {x.lower() for x in df.columns}:
                own += "_"
            files = df.sparkSession.createDataFrame([((p, i),) for i, p in enumerate(paths)], f"{own}_file struct<path:string,n:long>")
            numbered = df.select("*", F.struct(at["file_path"].alias("path"), at["row_index"].alias("at")).alias(own))
            joined = numbered.join(F.broadcast(files), F.col(own)["path"] == F.col(f"{own}_file")["path"], "left")
            number = F.coalesce(F.col(f"{own}_file")["n"], F.raise_error(F.lit("a file came or went")).cast("long"))
            return joined.select(*[numbered[x] for x in df.columns], F.shiftleft(number, _ROWS).bitwiseOR(F.col(own)["at"]).alias(name))
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def without_row(df: DataFrame, name: str = "_tmk_row") -> DataFrame:
    """df (made by with_row) without the identity; columns that had to make way have their names again."""
    df = df.drop(name)
    for x in sorted(df.columns, key=len):
        if re.fullmatch(f"{name}_+", x, re.IGNORECASE):
            df = df.withColumnRenamed(x, x[:-1])
    return df
