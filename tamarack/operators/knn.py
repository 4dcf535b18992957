"""Exact top-k nearest neighbours over several vector indexes.

Queries and corpus become tiles, which meet in a grid (see grid). A cell scores its vectors by a
matrix product, keeps what can be among the k best, and measures only that pair by pair, so scores
don't depend on how the corpus is split. What tasks keep meets in a group limit, which drops all
but k rows for each query and task before they move. The approximate search is in index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamarack.lineage import cut
from tamarack.operators import grid

#: Scores that a task holds at once, and pairs that it measures at once.
_SCORES, _PAIRS = 1 << 20, 1 << 14
DEFAULT_K = 3
#: Whether smaller is nearer.
METRICS = {"l2": True, "ip": False, "cosine": False}


@dataclass
class Asked:
    """Queries as a table of tiles, made once for any number of searches."""

    kind: T.DataType
    tiles: DataFrame

    def only(self, column: str, *values) -> Asked:
        """The queries that have one of the values in column, one of those that asked() was told of."""
        return Asked(self.kind, self.tiles.filter(F.col(column).isin(*values)))


def asked(queries: DataFrame, by: list[str] | None = None) -> Asked:
    """queries (query_id, query, and the columns in by), whose plan runs once, here."""
    return Asked(queries.schema["query_id"].dataType, cut(grid.tiles(queries, "query_id", "query", by)))


def _measured(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The metric of each pair of rows."""
    if metric == "l2":
        return ((m - q) ** 2).sum(axis=1)
    product = (m * q).sum(axis=1)
    return product if metric == "ip" else product / np.sqrt((m * m).sum(axis=1) * (q * q).sum(axis=1))


def _likely(m: np.ndarray, q: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of m, row of q) that hold the k best of each query, by products; ties at the end come along."""
    s = -(m @ q.T)
    if metric == "l2":
        s = (m * m).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] + 2 * s
    elif metric == "cosine":
        s = s / np.sqrt((m * m).sum(axis=1)[:, None] * (q * q).sum(axis=1)[None, :])
    s = np.nan_to_num(s, nan=np.inf)
    if len(m) <= k:
        return tuple(np.indices(s.shape).reshape(2, -1))
    last = np.partition(s, k - 1, axis=0)[k - 1]
    return np.nonzero(s <= last + 1e-9 * (1 + np.abs(np.nan_to_num(last, posinf=0.0))))


def _best(row: np.ndarray, query: np.ndarray, score: np.ndarray, ordinals: np.ndarray, metric: str, k: int) -> np.ndarray:
    """The places of the k best pairs of each query, as order_of has them."""
    near = np.where(np.isfinite(score), score if METRICS[metric] else -score, np.inf)
    order = np.lexsort((ordinals[row], near, query))
    of = query[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k]


def order_of(metric: str) -> list:
    """From the nearest on; what can't be measured comes last, ties go to the lower ordinal."""
    return [F.col("score").asc_nulls_last() if METRICS[metric] else F.col("score").desc_nulls_last(), F.col("ordinal")]


def ranked(scored: DataFrame, k: int, metric: str, by: list[str]) -> DataFrame:
    """(query_id, by, rank, ordinal, score): the k best of each query and value of by."""
    best = Window.partitionBy("query_id", *by).orderBy(*order_of(metric))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", *by, "rank", "ordinal", "score")


def score_cells(found: DataFrame, kind: T.DataType, k: int, metric: str, by: list[str]) -> DataFrame:
    """(query_id, by, ordinal, score) of what can be among the k nearest within each cell; found has cells c, q."""
    c = found.schema["c"].dataType
    schema = T.StructType([T.StructField("query_id", kind), *[c[x] for x in by], T.StructField("ordinal", c["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, q = b.column(0), b.column(1)
            for i in range(b.num_rows):
                cd, qd = (x.field("dim")[i].as_py() for x in (c, q))
                ordinals, ids = (x.field("ids")[i].values for x in (c, q))

                def out(row, query, score, i=i, c=c, ordinals=ordinals, ids=ids):
                    score = pa.array(score, pa.float64(), mask=~np.isfinite(score))
                    same = pa.array(np.full(len(score), i))
                    return pa.RecordBatch.from_arrays([ids.take(pa.array(query)), *[c.field(x).take(same) for x in by], ordinals.take(pa.array(row)), score], names=schema.names)

                if cd == qd and cd > 0:
                    m, w = (grid.matrix(x.field("data")[i].as_buffer(), cd, len(n)) for x, n in ((c, ordinals), (q, ids)))
                    step = max(1, _SCORES // len(m))
                    for at in range(0, len(w), step):
                        with np.errstate(divide="ignore", invalid="ignore"):
                            r, s = _likely(m, w[at : at + step], metric, k)
                            score = np.concatenate([np.zeros(0), *[_measured(m[r[x : x + _PAIRS]], w[at + s[x : x + _PAIRS]], metric) for x in range(0, len(r), _PAIRS)]])
                        if len(r) > 4 * k * min(step, len(w) - at) and not ordinals.null_count:  # many are equally near
                            best = _best(r, s, score, ordinals.to_numpy(zero_copy_only=False), metric, k)
                            r, s, score = r[best], s[best], score[best]
                        yield out(r, s + at, score)
                else:  # what can't be measured comes last
                    odd = np.argsort(ordinals.to_numpy(zero_copy_only=False), kind="stable")[:k]
                    yield out(np.tile(odd, len(ids)), np.repeat(np.arange(len(ids)), len(odd)), np.full(len(odd) * len(ids), np.nan))

    return found.select("c", "q").mapInArrow(kernel, schema)


def knn(queries: DataFrame | Asked, corpus: DataFrame, k: int = DEFAULT_K, metric: str = "l2", by: list[str] | None = None, broadcast_bytes: int = grid.BROADCAST_BYTES) -> DataFrame:
    """(query_id, by, rank, ordinal, score) of the k nearest rows of corpus to each query, per value of ``by``.

    queries: query_id, query, or what asked() made of them; corpus: ordinal, embedding, and the
    columns in by. Ties go to the lower ordinal. An index with fewer than k rows gives as many as it
    has. score is the metric's value: squared distance for l2, similarity otherwise; null, and last,
    where a vector is missing or of another length. Query tiles of up to broadcast_bytes go to the
    corpus, more of them meet it in a join.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    by = by or []
    q = queries if isinstance(queries, Asked) else asked(queries)
    found = grid.cells(grid.tiles(corpus, "ordinal", "embedding", by), q.tiles, broadcast_bytes)
    return ranked(score_cells(found, q.kind, k, metric, by), k, metric, by)


def search_index(queries: DataFrame | Asked, corpus: DataFrame, index: str, known: list[str], k: int = DEFAULT_K, metric: str = "l2", by: str = "kb") -> DataFrame:
    """knn in one index; an unknown name is an error."""
    if index not in known:
        raise ValueError(f"unknown index {index!r}; known: {', '.join(known)}")
    return knn(queries, corpus.filter(F.col(by) == index), k, metric, [by])


def lookup(hits: DataFrame, records: DataFrame) -> DataFrame:
    """hits with key and rec of their ordinal, in records (kb, ordinal, key, rec).

    An ordinal without a record keeps its hit, with the key line_<ordinal> and no record.
    """
    on = [c for c in ("kb", "ordinal") if c in hits.columns and c in records.columns]
    return hits.join(records.select(*on, "key", "rec"), on, "left").withColumn("key", F.coalesce("key", F.concat(F.lit("line_"), F.col("ordinal"))))


def nearest(queries: DataFrame | Asked, corpus: DataFrame, metric: str = "l2") -> DataFrame:
    """The single nearest row of each query; queries without any have no row."""
    return knn(queries, corpus, 1, metric)
