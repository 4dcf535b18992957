"""The streaming twin of the keyed upsert: a table of records in versions, merged micro-batch by micro-batch.

A version is a manifest: for each bucket of keys the folder that holds it. A batch rewrites the
buckets that its keys fall in, into new folders, and then puts a manifest under the batch's number
in place by a rename, which is the commit. A batch whose manifest is there is done, so one that
runs again after a failure changes nothing, and readers see a version whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tamarack.lineage import removed

BUCKETS = 64


class RecordTable:
    """Records by key at path: the last one of each key, and the line where the key came first."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of committed batches whose manifests are kept."""
        at, fs = self._at("manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket in a version, the newest by default."""
        known = self.versions()
        if not known:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{known[-1] if version is None else version}", wholetext=True).first()
        return {int(k): v for k, v in json.loads(text.value).items()} if text else {}

    def _commit(self, version: int, manifest: dict[int, str]) -> None:
        new, fs = self._at(f"manifests/.{version}-{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not fs.rename(new, self._at(f"manifests/{version}")[0]):
            fs.delete(new, False)
            raise RuntimeError(f"version {version} was committed by another writer")

    def _read(self, manifest: dict[int, str]) -> DataFrame | None:
        if not manifest:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{v}/bucket={k}" for k, v in sorted(manifest.items())])

    def read(self, version: int | None = None) -> DataFrame | None:
        """(key, first_line, last_line, value) of a version; None before the first."""
        got = self._read(self.manifest(version))
        return None if got is None else got.select("key", "first_line", "last_line", "value")

    def merge(self, batch: DataFrame, version: int) -> None:
        """Merges (key, line_no, value) as batch number ``version``; one that is committed already is left alone."""
        known = self.versions()
        if known and version <= known[-1]:
            return
        old = self.manifest()
        line = F.col("line_no").cast("long")
        own = batch.groupBy("key").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.max_by("value", line).alias("value"))
        own = own.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most ``buckets``
        before = self._read({k: v for k, v in old.items() if k in touched})
        if before is not None:
            both = own.unionByName(before.select(*own.columns))
            own = both.groupBy("key", "bucket").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.max_by("value", "last_line").alias("value"))
        folder = f"batch={version}-{uuid.uuid4().hex}"
        if touched:
            own.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._commit(version, old | dict.fromkeys(touched, folder))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest ``keep``, and buckets that none of those has, unfinished ones among them; returns how many went.

        To be called by the writer, when no batch is under way.
        """
        known = self.versions()
        for v in known[:-keep]:
            removed(self.spark, f"{self.path}/manifests/{v}")
        used = {f"{x}/bucket={k}" for v in known[-keep:] for k, x in self.manifest(v).items()}
        at, fs = self._at("data")
        folders = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        found = [f"{f.getName()}/{s.getPath().getName()}" for f in folders for s in fs.listStatus(f) if s.isDirectory()]
        gone = [x for x in found if x not in used]
        for x in gone:
            removed(self.spark, f"{self.path}/data/{x}")
        return len(gone)


def upsert_stream(records: DataFrame, table: RecordTable, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that merges a stream of (key, line_no, value), or of what prepare makes that of, into table; set its checkpoint and trigger, and start it."""

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(prepare(batch) if prepare else batch, number)

    return records.writeStream.foreachBatch(merge)
