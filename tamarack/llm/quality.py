"""Quality scores by a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance, shrunk to the diagonal of the pooled one. They come from
sums over all labelled rows, added up in Spark, so the model takes any number of labels. A score
is the logistic of the difference of the two log densities and log priors; the Mahalanobis
distances are taken by the Cholesky factors, which are computed once and travel with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import _common as c
from tamarack.llm._text import pieces, sliced, utf8

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 letters and others, 1 upper case, 2 digits, 3 sentence marks, 4 symbols, 5 white space
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[list(b".,;:?'\"()-")], _CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")], _CLASS[list(b" \t\n\x0b\x0c\r")] = 3, 4, 5
FEATURES = 10
#: Words of five letters that every text counts as having besides its own, so that shares in a few words say little.
PRIOR_WORDS = 12


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a text: logs of counts, square roots of shares."""
    kinds, n, letters, again, lines, seen, long = np.zeros(6), 0, 0, 0, 0, set(), 0
    bare, last = 0, None
    for p in pieces(utf8(text)):
        kinds += np.bincount(_CLASS[np.frombuffer(p, np.uint8)], minlength=6)
        words = p.split()
        if not words:
            continue
        n += len(words)
        again += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
        bare += sum(map((1).__eq__, map(len, words)))
        last = words[-1]
        lines += p.count(b"\n")
        seen.update(words)
    black, more = kinds[:5].sum() + PRIOR_WORDS * 5, n + PRIOR_WORDS
    return np.array([np.log1p(n), np.log(black / more), *np.sqrt(kinds[1:5] / black), np.log(len(seen) + PRIOR_WORDS) / np.log(more), np.sqrt(again / more), np.sqrt(bare / more), np.log((lines + 1) / more)])


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, x) of each row."""

    def kernel(batches):
        for b in sliced(batches):
            x = np.array([statistics(t) for t in b.column(b.num_columns - 1).to_pylist()]).reshape(-1, FEATURES)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], "x"])

    return docs.select(*keep, text_col).mapInArrow(kernel, T.StructType([*docs.select(*keep).schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor, log of prior over root determinant; bias of the scores."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = [((x - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True)]
        logs = [o - 0.5 * (v * v).sum(axis=1) for v, o in zip(z, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def discriminant(n: np.ndarray, first: np.ndarray, second: np.ndarray, shrinkage: float) -> Discriminant:
    """From each class's count, sum of x and sum of outer products."""
    if not n.all():  # nothing to tell apart: the share of class 1 among the labels, 0.5 without any
        return Discriminant(first, second, n, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = first / n[:, None]
    cov = second / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.diag(np.diag((cov * n[:, None, None]).sum(0) / n.sum()) + 1e-4)
    shrunk = (1 - shrinkage) * cov + shrinkage * pooled
    low = np.linalg.cholesky(shrunk)
    return Discriminant(means, np.linalg.inv(low), np.log(n / n.sum()) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1))


def fit(labelled: DataFrame, shrinkage: float = 0.2) -> Discriminant:
    """labelled: (x, label), label 0 or 1 (rows of others, or null, don't count)."""

    def moments(batches):
        out = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                out[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        k, i = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (k.astype(np.int32), i.astype(np.int32), out)], names=["label", "at", "v"])

    rows = labelled.filter("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    sums = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for label, at, v in rows.mapInArrow(moments, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v")).collect():  # 2 * 111 rows
        sums[label, at] = v
    return discriminant(sums[:, 0], sums[:, 1 : 1 + FEATURES], sums[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES), shrinkage)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """stats with score instead of x."""

    def kernel(batches):
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(x))], names=[*b.schema.names[:-1], "score"])

    return stats.mapInArrow(kernel, T.StructType([*stats.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 if score >= 0.5), and keep.

    Learns from labels of ids that aren't held out; a label counts for each row that has its id.
    Without labels of both classes, every score is the share of label 1 (0.5 without labels).
    Null and empty texts have the statistics of PRIOR_WORDS alone and a score like any other; texts
    are read whole, whatever their length. Repeated rows have a row each, of the same score. An empty
    table gives no rows; other columns, whatever their names, don't matter.
    """
    keep = keep or []
    stats = c.cut(with_statistics(docs, text_col, list(dict.fromkeys([id_col, *keep]))))
    known = labels.select(F.col(id_col).alias("_of"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1))
    model = fit(stats.filter(~held_out(F.col(id_col))).join(known, F.col(id_col) == F.col("_of")).select("x", "label"), shrinkage)
    out = scored(stats, model)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs, with all its columns, without the rows that the classifier rejects (a score under 0.5; see quality_scores)."""
    rows = c.with_row(docs)
    return c.without_rows(rows, quality_scores(rows, labels, keep=["_tmk_row"], **options).filter("predicted = 0"))
