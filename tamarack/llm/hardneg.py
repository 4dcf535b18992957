"""Hard negatives by product quantisation with residual norms, reranked in integers.

Integer vectors are cut into pairs of components, each pair coded by the nearest of up to 256
centres, and the norm of what the codes leave is stored, rounded up. A table of an anchor's
products with all centres then gives a row's score by lookups, and anchor norm times residual norm
bounds what that is off by (Cauchy and Schwarz). Only rows whose bounds can place them among the
first of a window are scored exactly, in integers, so results don't depend on the codes.

Corpus and anchors are tiles that meet in a grid (tamarack.operators.grid), first for positives,
then, with the windows these give, for negatives. Each cell returns its own few best rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.kmeans import centres_of, nearest_centres
from tamarack.llm import _common as c
from tamarack.operators.grid import BROADCAST_BYTES, cells, group_codes, lengths

#: Components of a subspace, centres of each, rows that centres are fitted on at most (those with the least hashes of their ids).
WIDTH, CENTRES, SAMPLE = 2, 256, 4096
#: Rows of a corpus tile and of a tile of anchors.
ROWS, ANCHORS = 4096, 256
_LIMIT = 1 << 62


def padded(z: np.ndarray) -> np.ndarray:
    """z as doubles with columns for whole subspaces: (rows, subspaces, WIDTH)."""
    n, d = z.shape
    out = np.zeros((n, -(-d // WIDTH) * WIDTH))
    out[:, :d] = z
    return out.reshape(n, -1, WIDTH)


def fitted(sample: np.ndarray) -> np.ndarray:
    """The centres of each subspace: (subspaces, up to CENTRES, WIDTH), all with as many, the last one repeated."""
    parts = padded(sample)
    found = [centres_of(parts[:, m], CENTRES, 8) for m in range(parts.shape[1])]
    k = max(map(len, found), default=1)
    return np.stack([np.concatenate((x, np.repeat(x[-1:], k - len(x), axis=0))) for x in found])


def coded(z: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms) of the rows of z; norms are rounded up."""
    parts = padded(z)
    codes = np.stack([nearest_centres(parts[:, m], book[m]) for m in range(len(book))], axis=1).astype(np.uint8)
    rest = sum(((parts[:, m] - book[m][codes[:, m]]) ** 2).sum(axis=1) for m in range(len(book)))
    return codes, np.sqrt(rest) * (1 + 1e-9) + 1e-9


def bounded(q: np.ndarray, codes: np.ndarray, rest: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds, by lookups, of the product of each row (first axis) with each anchor (second axis)."""
    parts = padded(q)
    scores = np.zeros((len(codes), len(q)))
    for m in range(len(book)):
        scores += (book[m] @ parts[:, m].T)[codes[:, m]]
    off = rest[:, None] * np.sqrt((parts**2).sum(axis=(1, 2)))[None, :]
    off += 1e-9 * (np.abs(scores) + off) + 1e-6
    return scores - off, scores + off


def exact(z: np.ndarray, q: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The integer products of the pairs (row r, anchor a); more than 64 bits are an error."""
    if z.shape[1] * int(np.abs(z).max(initial=0)) * int(np.abs(q).max(initial=0)) < _LIMIT:
        return (z[r] * q[a]).sum(axis=1)
    return np.array([sum(x * y for x, y in zip(z[i].tolist(), q[j].tolist(), strict=True)) for i, j in zip(r.tolist(), a.tolist(), strict=True)], np.int64)


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each group by score from the highest, id and row."""
    order = np.lexsort((row, ids, -score, group))
    own = group[order]
    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < n]


def _tiles(rows: DataFrame, size: int, books: dict[int, np.ndarray] | None) -> DataFrame:
    """rows (_tmk_row, id, label, z) as tiles (dim, ids, rows, labels, data, codes, rest) of up to size rows; without books, of anchors."""

    def made(parts: list[pa.RecordBatch], dim: int) -> pa.RecordBatch:
        row, ids, labels, z = (pa.concat_arrays([b.column(i) for b in parts]) for i in range(4))
        data = z.flatten().to_numpy().reshape(len(z), dim)
        codes, rest = b"", b""
        if books is not None:
            # a length that the sample hasn't is coded by one centre, zero
            codes, rest = (x.tobytes() for x in coded(data, books.get(dim, np.zeros((-(-dim // WIDTH), 1, WIDTH)))))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, row, labels)]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists, *[pa.array([x], pa.binary()) for x in (data.tobytes(), codes, rest)]], names=["dim", "ids", "rows", "labels", "data", "codes", "rest"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            dims = lengths(b.column(3))
            code = group_codes([], dims)
            for g in range(int(code.max(initial=-1)) + 1):
                at = np.flatnonzero(code == g)
                dim = int(dims[at[0]])
                for i in range(0, len(at), size):
                    part = b.take(pa.array(at[i : i + size]))
                    if sum(x.num_rows for x in held.get(dim, ())) + part.num_rows > size:
                        yield made(held.pop(dim), dim)
                    held.setdefault(dim, []).append(part)
        for dim, parts in held.items():
            yield made(parts, dim)

    schema = "dim int, ids array<long>, rows array<long>, labels array<long>, data binary, codes binary, rest binary"
    return rows.filter(F.size("z") > 0).select("_tmk_row", "id", "label", "z").mapInArrow(kernel, schema)


def _list(x: pa.Array, i: int) -> np.ndarray:
    return x[i].values.to_numpy()


def _searched(found: DataFrame, books, schema: str, search) -> DataFrame:
    """A kernel over cells (c, q): search gets what a cell has and yields columns of schema."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, q = b.column(0), b.column(1)
            for i in range(b.num_rows):
                dim = c.field("dim")[i].as_py()
                if dim != q.field("dim")[i].as_py():
                    continue  # vectors of different length have no product
                z, w = (np.frombuffer(x.field("data")[i].as_buffer(), np.int64).reshape(-1, dim) for x in (c, q))
                book = books.value.get(dim, np.zeros((-(-dim // WIDTH), 1, WIDTH)))
                codes = np.frombuffer(c.field("codes")[i].as_buffer(), np.uint8).reshape(len(z), -1)
                low, high = bounded(w, codes, np.frombuffer(c.field("rest")[i].as_buffer()), book)
                yield from search(c, q, i, z, w, low, high)

    return found.select("c", "q").mapInArrow(kernel, schema)


_POSITIVE = "tile long, anchor_row long, anchor_id long, id long, row long, score long"
_NEGATIVE = "tile long, anchor_row long, anchor_id long, positive int, positive_id long, positive_score long, id long, row long, score long"


def _positive_search(n: int):
    """What can be among an anchor's first n rows of its label, by bounds, then exactly."""

    def search(c, q, i, z, w, low, high):
        ids, rows, labels = (_list(c.field(x), i) for x in ("ids", "rows", "labels"))
        a_ids, a_rows, a_labels = (_list(q.field(x), i) for x in ("ids", "rows", "labels"))
        same = (labels[:, None] == a_labels[None, :]) & (rows[:, None] != a_rows[None, :])
        least = np.where(same, low, -np.inf)
        if len(z) > n:
            same &= high >= np.partition(least, len(z) - n, axis=0)[len(z) - n]
        r, a = np.nonzero(same)
        score = exact(z, w, r, a)
        k = first_of(a, score, ids[r], rows[r], n)
        r, a, score = r[k], a[k], score[k]
        tile = np.full(len(r), q.field("tile")[i].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tile, a_rows[a], a_ids[a], ids[r], rows[r], score)], names=["tile", "anchor_row", "anchor_id", "id", "row", "score"])

    return search


def _negative_search(n: int, least: int, most: int):
    """What can be among the first n rows of another label in the window of each of an anchor's positives."""

    def search(c, q, i, z, w, low, high):
        ids, rows, labels = (_list(c.field(x), i) for x in ("ids", "rows", "labels"))
        a_ids, a_rows, a_labels = (_list(q.field(x), i) for x in ("ids", "rows", "labels"))
        tile = q.field("tile")[i].as_py()
        other = labels[:, None] != a_labels[None, :]
        windows = q.field("windows")[i].values.flatten()
        w_row, w_rank, w_id, w_score = (x.to_numpy() for x in windows)
        column = {r: k for k, r in enumerate(a_rows.tolist())}
        at = np.array([column[r] for r in w_row.tolist()], np.int64)
        # 100 * score within least and most times the positive's score, in Python's integers
        floor = np.array([-(-least * s // 100) for s in w_score.tolist()], np.int64)
        roof = np.array([most * s // 100 for s in w_score.tolist()], np.int64)
        ok = floor <= roof
        lowest, highest = np.full(len(w), _LIMIT), np.full(len(w), -_LIMIT)
        np.minimum.at(lowest, at[ok], floor[ok])
        np.maximum.at(highest, at[ok], roof[ok])
        r, a = np.nonzero(other & (high >= lowest[None, :]) & (low <= highest[None, :]))
        lo, up = low[r, a], high[r, a]
        # a window needs no row that is surely behind the n-th of those surely inside
        wanted, inside = np.zeros(len(r), bool), []
        for rank in np.unique(w_rank[ok]).tolist():
            k = np.flatnonzero(ok & (w_rank == rank))
            window = np.full(len(w), -1)
            window[at[k]] = k
            x = np.flatnonzero(window[a] >= 0)
            of = window[a[x]]
            may = (up[x] >= floor[of]) & (lo[x] <= roof[of])
            x, of = x[may], of[may]
            sure = (lo[x] >= floor[of]) & (up[x] <= roof[of])
            bound, s = np.full(len(ok), -np.inf), np.flatnonzero(sure)
            s = s[np.lexsort((-lo[x[s]], of[s]))]
            nth = s[n - 1 :][of[s[n - 1 :]] == of[s[: max(0, len(s) - n + 1)]]]
            np.maximum.at(bound, of[nth], lo[x[nth]])
            near = up[x] >= bound[of]
            wanted[x[near]] = True
            inside.append((x[near], of[near]))
        score = np.zeros(len(r), np.int64)
        score[wanted] = exact(z, w, r[wanted], a[wanted])
        for x, of in inside:
            in_window = (score[x] >= floor[of]) & (score[x] <= roof[of])
            x, of = x[in_window], of[in_window]
            best = first_of(of, score[x], ids[r[x]], rows[r[x]], n)
            x, of = x[best], of[best]
            cols = (np.full(len(x), tile), w_row[of], a_ids[at[of]], w_rank[of], w_id[of], w_score[of], ids[r[x]], rows[r[x]], score[x])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["tile", "anchor_row", "anchor_id", "positive", "positive_id", "positive_score", "id", "row", "score"])

    return search


def _best(found: DataFrame, by: list[str], n: int, rank: str) -> DataFrame:
    """The first n of each group, with their place in rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "z", label_col: str = "label", anchor_col: str = "anchor", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor, positive and negative.

    df has a row for each vector of integers (array<long>); anchor_col tells which are anchors. A
    row's score is its product with the anchor, higher first, ties by id. An anchor's positives are
    its first ``positives`` other rows of its label; for each of them, the negatives are the first
    ``negatives`` rows of another label whose score is within least and most percent of the
    positive's. Fewer rows give fewer; a window without any gives no row.

    Rows with a null id, label or vector, or a null in the vector, take no part, nor do empty
    vectors; vectors of different length have no product. Repeated rows are rows of their own, also
    as anchors. Products of more than 64 bits are an error. An empty df gives no rows; other
    columns, whatever their names, don't matter. Every row is coded and searched; only the centres
    are fitted on SAMPLE rows.
    """
    spark = df.sparkSession
    vector = F.col(vector_col).cast("array<long>")
    own = c.with_row(df).select("_tmk_row", F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("z"), F.coalesce(F.col(anchor_col), F.lit(False)).alias("anchor"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("z").isNotNull() & ~F.exists("z", lambda x: x.isNull()))
    some = own.filter(F.size("z") > 0).select("z", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("z").combine_chunks()  # bounded by SAMPLE
    size = lengths(some)
    fit = {int(d): fitted(some.take(pa.array(np.flatnonzero(size == d))).flatten().to_numpy().reshape(-1, d)) for d in np.unique(size)}
    books = spark.sparkContext.broadcast(fit)
    corpus = c.cut(_tiles(own, ROWS, fit))
    anchors = c.cut(_tiles(own.filter("anchor"), ANCHORS, None).drop("codes", "rest").withColumn("tile", F.monotonically_increasing_id()))
    near = _searched(cells(corpus, anchors, broadcast_bytes), books, _POSITIVE, _positive_search(positives))
    first = c.cut(_best(near, ["tile", "anchor_row"], positives, "positive"))
    windows = first.groupBy("tile").agg(F.collect_list(F.struct("anchor_row", "positive", "id", "score")).alias("windows"))  # up to ANCHORS * positives of a tile
    asked = c.cut(anchors.join(windows, "tile"))
    hard = _searched(cells(corpus, asked, broadcast_bytes), books, _NEGATIVE, _negative_search(negatives, least, most))
    return _best(hard, ["tile", "anchor_row", "positive"], negatives, "rank").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: op12 in DuckDB's SQL, by brute force.
ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS z
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.z, b.z), lambda p: p[1] * p[2]))::BIGINT AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
