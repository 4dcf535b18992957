"""Tables of vectors as tiles, and the grid of two such tables.

A tile is a row with up to some thousand vectors of one length in one value of ``by``: their
identifiers as an array and their numbers as bytes. A search of many queries in a large corpus is
then a join of two tables of tiles by key, whose rows are the cells of a grid: each corpus tile
meets each query tile once, in a row that a kernel scores. Nothing passes through the driver, and
no task holds more than some cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a tile at most, and vectors that a task holds in unfinished tiles.
TILE_ROWS, _HELD = 4096, 1 << 16
#: Arrays of an unfinished tile at most.
_PARTS = 64
#: Bytes of a side up to which it is broadcast; it is measured first.
BROADCAST_BYTES = 32 << 20


def lengths(vectors: pa.Array) -> np.ndarray:
    """The length of each vector, -1 for null."""
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)


def group_codes(columns: list[pa.Array], size: np.ndarray) -> np.ndarray:
    """A number for each row, equal where all columns and size are; nulls are equal."""
    code = np.unique(size, return_inverse=True)[1]
    for x in columns:
        own = pc.fill_null(pc.dictionary_encode(x, null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
        code = np.unique(code.astype(np.int64) * (int(own.max(initial=0)) + 2) + own + 1, return_inverse=True)[1]
    return code


def tiles(df: DataFrame, key: str, vector: str, by: list[str] | None = None, rows: int = TILE_ROWS) -> DataFrame:
    """(by, dim, n, ids, data) of df's rows: ids are the keys, data the vectors' numbers one after the other.

    Vectors of different length, or with other values in by, are in different tiles; null vectors
    have the dim -1 and no data. A null within a vector is NaN. No rows are moved between tasks.
    Rows that wait for their tile are copies, so none of them keeps the batch it came in.
    """
    by = by or []
    own = df.select(*by, key, vector)
    kind = own.schema[vector].dataType.elementType
    if not isinstance(kind, T.FloatType):
        own, kind = own.withColumn(vector, F.col(vector).cast("array<double>")), T.DoubleType()
    number = np.float32 if isinstance(kind, T.FloatType) else np.float64
    fields = [own.schema[x] for x in by] + [T.StructField("dim", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(own.schema[key].dataType)), T.StructField("data", T.BinaryType())]
    schema = T.StructType(fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[pa.Array, pa.Array]]] = {}  # keys and vectors
        shared: dict[tuple, list[pa.Array]] = {}  # what by has
        count: dict[tuple, int] = {}

        def made(group: tuple) -> pa.RecordBatch:
            parts, dim = held.pop(group), group[-1]
            n = count.pop(group)
            ids = pa.concat_arrays([x for x, _ in parts])
            data = b"" if dim <= 0 else b"".join(v.flatten().to_numpy(zero_copy_only=False).astype(number).tobytes() for _, v in parts)
            lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([*shared.pop(group), pa.array([dim], pa.int32()), pa.array([n], pa.int32()), lists, pa.array([data], pa.binary())], names=schema.names)

        for b in batches:
            size = lengths(b.column(len(by) + 1))
            code = group_codes(b.columns[: len(by)], size)
            order = np.argsort(code, kind="stable")
            for r in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if not len(r):
                    continue
                group = (*[x[int(r[0])].as_py() for x in b.columns[: len(by)]], int(size[r[0]]))
                for at in range(0, len(r), rows):
                    part = r[at : at + rows]
                    if count.get(group, 0) + len(part) > rows:
                        yield made(group)
                    if group not in held:
                        held[group], shared[group] = [], [x.take(pa.array(part[:1])) for x in b.columns[: len(by)]]
                    held[group].append(tuple(x.take(pa.array(part)) for x in b.columns[len(by) :]))
                    count[group] = count.get(group, 0) + len(part)
                    if len(held[group]) > _PARTS:
                        held[group] = [tuple(map(pa.concat_arrays, zip(*held[group], strict=True)))]
            while sum(count.values()) > _HELD:
                yield made(max(count, key=count.__getitem__))
        for group in list(held):
            yield made(group)

    return own.mapInArrow(kernel, schema)


def cells(corpus: DataFrame, queries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each row of corpus (tiles) with each row of queries (tiles, a table made by a cut), their columns as c and q.

    Query tiles are broadcast if they measure up to broadcast_bytes, and the corpus doesn't move.
    Otherwise query tiles are dealt to slots and the corpus' partitions to groups; both sides are
    sent to all slots or groups, and meet by the pair of numbers. A cell is thus found once, and
    what moves is the corpus once for each slot and the queries once for each group.
    """
    c, q = corpus.select(F.struct("*").alias("c")), queries.select(F.struct("*").alias("q"))
    measured = queries.agg(F.sum(F.octet_length("data") + 16 * F.size("ids")), F.count(F.lit(1))).first()
    size, n = measured[0] or 0, measured[1]
    if size <= broadcast_bytes:
        one = lambda n: F.pmod(F.col(n), F.lit(1))  # noqa: E731  the one slot that all are in
        return c.withColumn("_slot", one("c.dim")).join(F.broadcast(q.withColumn("_slot", one("q.dim"))), "_slot").drop("_slot")
    slots = min(n, -(-size // broadcast_bytes))
    groups = max(1, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")) // slots)
    mine = F.pmod(F.xxhash64("q.ids", "q.data"), F.lit(slots)).cast("int")
    left = c.withColumns({"_group": F.pmod(F.spark_partition_id(), F.lit(groups)), "_slot": F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))})
    right = q.withColumns({"_slot": mine, "_group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    return left.join(right, ["_group", "_slot"]).drop("_group", "_slot")


def matrix(data, dim: int, n: int) -> np.ndarray:
    """The n vectors of a tile, in doubles."""
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)
