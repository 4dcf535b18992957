"""An inverted-file index of vectors: cells around centres as partitions of a table, with a descriptor.

The folder of an index has ``vectors`` (ordinal, embedding, dist; partitioned by cell), ``cells``
(cell, n, centre, radius), ``recall`` (cells probed, share of true neighbours in them) and, written
last, ``descriptor`` (dim, count, metric). A search sends each query to the cells it needs and
scores them as knn does, so what is found has its exact score. An exact search skips the cells
that the triangle inequality rules out; an approximate one probes the nearest cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.kmeans import centres_of, nearest_centres
from tamarack.lineage import cut
from tamarack.operators import grid, knn

#: Cells of an index at most, rows that the centres are fitted on at most, queries that recall is measured with.
MOST_CELLS, SAMPLE, CALIBRATION = 16_384, 32_768, 256
#: Distances to centres that a task holds at once, and visits that it sends on at once.
_DISTANCES, _VISITS = 1 << 19, 1 << 13
#: Neighbours that recall is measured for.
RECALL_K = 10


def _space(m: np.ndarray, metric: str) -> np.ndarray:
    """The vectors as Euclidean distance compares them: of length one for cosine."""
    return m / np.sqrt((m * m).sum(axis=1))[:, None] if metric == "cosine" else m


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _checked(df: DataFrame, vector: str, dim: int, what: str) -> DataFrame:
    """df, failing where a vector hasn't dim finite numbers."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    said = F.concat(F.lit(f"a vector of the {what} has "), size, F.lit(f" dimensions, not {dim}, or a number that isn't finite"))
    return df.withColumn(vector, F.when((size != dim) | broken, F.raise_error(said).cast(df.schema[vector].dataType)).otherwise(F.col(vector)))


def _bounds(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of queries to centres."""
    s = (q * q).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (q @ centres.T)
    return np.sqrt(np.maximum(s, 0))


def needed(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Whether each query (row) may have one of its k nearest in each cell (column).

    k rows are surely within the distance at which cells that lie wholly inside hold k rows; a cell
    all of whose rows are farther away than that has none of the k nearest.
    """
    d = _bounds(q, centres)
    far = d + radius
    order = np.argsort(far, axis=1)
    enough = np.cumsum(n[order], axis=1) >= k
    last = np.where(enough.any(axis=1), np.argmax(enough, axis=1), len(n) - 1)
    bound = np.take_along_axis(far, order, axis=1)[np.arange(len(q)), last]
    return d - radius <= (bound + 1e-9 * (1 + bound))[:, None]


@dataclass(frozen=True)
class VectorIndex:
    """An opened index. Few numbers for each of at most MOST_CELLS cells are on the driver."""

    vectors: DataFrame
    dim: int
    count: int
    metric: str
    centres: np.ndarray
    radius: np.ndarray
    n: np.ndarray
    recall: dict[int, float]

    @staticmethod
    def build(corpus: DataFrame, path: str, metric: str = "l2", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Writes the index of corpus (ordinal, embedding) to path, which must not exist, and opens it.

        Every row is indexed; ``sample`` rows at most, those with the least hashes of their
        ordinals, fit the centres (cells: as many as the root of the count). Vectors that are
        missing, differ in length or have numbers that aren't finite are an error, and so are, for
        cosine, zero vectors.
        """
        if metric not in ("l2", "cosine"):
            raise ValueError("an index is for l2 or cosine")
        own, spark = corpus.select("ordinal", F.col("embedding").cast("array<float>").alias("embedding")), corpus.sparkSession
        count, dim = own.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        if not count:
            raise ValueError("no vectors")
        own = _checked(own, "embedding", dim, "corpus")
        if metric == "cosine":
            zero = F.forall("embedding", lambda x: x == 0)
            own = own.withColumn("embedding", F.when(zero, F.raise_error(F.lit("a zero vector has no cosine")).cast("array<float>")).otherwise(F.col("embedding")))
        some = own.orderBy(F.xxhash64("ordinal"), "ordinal").limit(sample).toArrow()  # bounded by ``sample``
        fit = _space(_vectors(some.column("embedding").combine_chunks(), dim), metric)
        centres = centres_of(fit, min(MOST_CELLS, cells or max(1, round(count**0.5))))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _space(_vectors(b.column(1), dim), metric)
                of = nearest_centres(m, centres)
                dist = np.sqrt(((m - centres[of]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dist), pa.array(of.astype(np.int32))], names=[*b.schema.names, "dist", "cell"])

        placed = own.mapInArrow(assign, T.StructType([*own.schema.fields, T.StructField("dist", T.DoubleType()), T.StructField("cell", T.IntegerType())]))
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
        at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        at.join(sizes, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "centre", F.coalesce("radius", F.lit(0.0)).alias("radius")).coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(1, 1.0)], "probe int, recall double").write.parquet(f"{path}/recall")
        spark.createDataFrame([(dim, count, metric)], "dim int, count long, metric string").coalesce(1).write.parquet(f"{path}/descriptor")
        index = VectorIndex.open(spark, path)
        index._measure(some.slice(0, CALIBRATION)).write.mode("overwrite").parquet(f"{path}/recall")
        return VectorIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str, dim: int | None = None) -> VectorIndex:
        """The index at path; one that wasn't finished has no descriptor, which is Spark's PATH_NOT_FOUND. dim: what it must have."""
        d = spark.read.parquet(f"{path}/descriptor").first()
        if dim is not None and d.dim != dim:
            raise ValueError(f"the index has {d.dim} dimensions, not {dim}")
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # at most MOST_CELLS
        centres = _vectors(cells.column("centre").combine_chunks(), d.dim)
        recall = {r.probe: r.recall for r in spark.read.parquet(f"{path}/recall").collect()}  # one for each number of cells
        vectors = spark.read.parquet(f"{path}/vectors")
        return VectorIndex(vectors, d.dim, d["count"], d.metric, centres, cells.column("radius").to_numpy(), cells.column("n").to_numpy(), recall)

    def descriptor(self) -> DataFrame:
        """(dim, count, metric, cells): one row."""
        return self.vectors.sparkSession.createDataFrame([(self.dim, self.count, self.metric, len(self.n))], "dim int, count long, metric string, cells int")

    def _measure(self, queries: pa.Table) -> DataFrame:
        """(probe, recall): the share of the queries' true nearest rows, without themselves, that the ``probe`` nearest cells have."""
        spark = self.vectors.sparkSession
        asked = spark.createDataFrame(queries.rename_columns(["query_id", "query"]))
        hits = self.search_exact(asked, RECALL_K + 1).filter("query_id <> ordinal")
        order = np.argsort(_bounds(_space(_vectors(queries.column("embedding").combine_chunks(), self.dim), self.metric), self.centres), axis=1)
        place = spark.createDataFrame([(int(q), int(c), p + 1) for q, row in zip(range(len(order)), order, strict=True) for p, c in enumerate(row.tolist())], "at int, cell int, probe int")
        ids = spark.createDataFrame(list(enumerate(queries.column("ordinal").to_pylist())), T.StructType([T.StructField("at", T.IntegerType()), T.StructField("query_id", asked.schema["query_id"].dataType)]))
        of = hits.join(self.vectors.select("ordinal", "cell"), "ordinal").join(ids, "query_id").join(place, ["at", "cell"])
        found = {r.probe: r.n for r in of.groupBy("probe").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each number of cells
        total, got, rows = max(1, sum(found.values())), 0, []
        for probe in range(1, len(self.n) + 1):
            got += found.get(probe, 0)
            rows.append((probe, got / total if found else 1.0))
        return spark.createDataFrame(rows, "probe int, recall double").coalesce(1)

    def probes_for(self, recall: float) -> int:
        """The fewest cells to probe with which the measured recall reached ``recall``."""
        return min((p for p, r in self.recall.items() if r >= recall), default=len(self.n))

    def search(self, queries: DataFrame, k: int = knn.DEFAULT_K, probe: int | None = None, recall: float = 0.95) -> DataFrame:
        """(query_id, rank, ordinal, score) of the k nearest rows in the ``probe`` nearest cells of each query; by default, as many as ``recall`` needs."""
        p, centres = min(len(self.n), probe or self.probes_for(recall)), self.centres

        def nearest(q: np.ndarray) -> np.ndarray:
            d = _bounds(q, centres)
            out = np.zeros(d.shape, bool)
            np.put_along_axis(out, np.argsort(d, axis=1, kind="stable")[:, :p], True, axis=1)
            return out

        return self._search(queries, k, nearest)

    def search_exact(self, queries: DataFrame, k: int = knn.DEFAULT_K) -> DataFrame:
        """What knn finds, from the cells that can have it."""
        centres, radius, n = self.centres, self.radius, self.n
        return self._search(queries, k, lambda q: needed(q, centres, radius, n, k))

    def visits(self, queries: DataFrame, choose) -> DataFrame:
        """(query_id, query, cell): each query with the cells that choose, from a matrix of queries to one of booleans, picks for it."""
        own = _checked(queries.select("query_id", F.col("query").cast("array<float>").alias("query")), "query", self.dim, "queries")
        dim, metric, holds = self.dim, self.metric, self.n > 0

        step = max(1, min(512, _DISTANCES // max(1, len(self.n))))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, step):
                    s = b.slice(at, step)
                    with np.errstate(invalid="ignore"):
                        m = _space(_vectors(s.column(1), dim), metric)
                    row, cell = np.nonzero((choose(np.nan_to_num(m)) | np.isnan(m).any(axis=1)[:, None]) & holds[None, :])
                    for part in range(0, len(row), _VISITS):
                        r, c = row[part : part + _VISITS], cell[part : part + _VISITS]
                        yield pa.RecordBatch.from_arrays([*[x.take(pa.array(r)) for x in s.columns], pa.array(c.astype(np.int32))], names=["query_id", "query", "cell"])

        return own.mapInArrow(kernel, T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType())]))

    def _search(self, queries: DataFrame, k: int, choose) -> DataFrame:
        sent = cut(grid.tiles(self.visits(queries, choose), "query_id", "query", ["cell"]))
        cells = [r.cell for r in sent.select("cell").distinct().collect()]  # at most MOST_CELLS
        own = grid.tiles(self.vectors.filter(F.col("cell").isin(cells)), "ordinal", "embedding", ["cell"])
        size = sent.agg(F.sum(F.octet_length("data") + 16 * F.size("ids"))).first()[0] or 0
        q = sent.select("cell", F.struct("*").alias("q"))
        found = own.select("cell", F.struct("*").alias("c")).join(F.broadcast(q) if size <= grid.BROADCAST_BYTES else q, "cell")
        return knn.ranked(knn.score_cells(found, queries.schema["query_id"].dataType, k, self.metric, []), k, self.metric, [])
