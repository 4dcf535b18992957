"""A sink for many small files, such as preview images, that commits: all of a job's files appear, or none.

A task writes into a folder of its own below a hidden one. When all have ended, the driver moves
what the winning attempts wrote to the final names, and deletes the rest; when the job fails, it
deletes everything. Rows are dealt by file name, so a name that two rows have meets in one task,
where it is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def file_name(name: Column) -> Column:
    """name as a file's in one folder: slashes become underscores."""
    return F.translate(name, "/", "_")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    count: int


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, job: str) -> None:
        self.folder, self.overwrite, self.staged = folder, overwrite, f".staging-{job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.folder)
        mine, seen = f"{self.staged}/{uuid.uuid4().hex}", set()  # an attempt's own
        fs.create_dir(f"{root}/{mine}", recursive=True)
        for b in iterator:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name in seen:
                    raise ValueError(f"two rows have the file name {name!r}")
                seen.add(name)
                with fs.open_output_stream(f"{root}/{mine}/{name}") as out:
                    out.write(data or b"")
        return Written(mine, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.folder)
        with ThreadPoolExecutor(16) as pool:
            found = [f for m in messages if m for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/{m.folder}"))]
            if not self.overwrite:
                there = [f.path for f in pool.map(lambda f: fs.get_file_info(f"{root}/{f.base_name}"), found) if f.type != pa.fs.FileType.NotFound]
                if there:
                    self.abort(messages)
                    raise FileExistsError(f"{len(there)} files are there already, the first is {there[0]}")
            list(pool.map(lambda f: fs.move(f.path, f"{root}/{f.base_name}"), found))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.folder)
        if fs.get_file_info(f"{root}/{self.staged}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staged}")


class FileSink(DataSource):
    """``df.write.format("tamarack_files").mode("append" or "overwrite").save(folder)`` for df (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "tamarack_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(self.options["path"], overwrite, uuid.uuid4().hex)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content", overwrite: bool = True) -> int:
    """Writes the bytes of each row to a file of its name in folder, a path or URI that all executors reach; returns how many.

    All files appear when the job is done; a job that fails leaves none. Rows without a name are
    left out. Two rows with one name are an error, and without ``overwrite`` files that are there.
    """
    df.sparkSession.dataSource.register(FileSink)
    own = df.filter(F.col(name).isNotNull()).select(file_name(F.col(name)).alias("name"), F.col(content).cast("binary").alias("content"))
    counted = Observation()
    own.repartition("name").observe(counted, F.count(F.lit(1)).alias("n")).write.format("tamarack_files").mode("overwrite" if overwrite else "append").save(folder)
    return counted.get["n"]
