"""Embedding near-duplicates by spherical-cap filters.

Filter directions form random product codes: a random rotation, blocks of its coordinates, and in
each block a codebook of random directions; a filter is a choice of one of each block. A vector
belongs to every filter whose direction it is near (the cap's height), and the code's structure
lists these without looking at all filters: partial sums that can't reach the height are left.
As a structured code leaves some directions with few filters, several independent ones are used.
Vectors join on filters; within a filter, products in doubles verify each pair, which counts only
in the first filter both have, so links are counted once and no pairs are emitted. Rows travel
without their lists of filters; those that link are decoded again where they do.

The number of filters grows with the count so that a filter's share of vectors shrinks; the
height is set so that random pairs at the threshold have PAIRS filters in common on average. Equal
vectors go through all this as one, with their number. A filter with many vectors is dealt into
blocks, and each pair of its blocks is a group of its own; a family of vectors that differ but all
link costs a product for each pair, as the links of each have to be counted, spread over groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import _common as c
from tamarack.llm.components import components

SEED = 42
#: Independent codes, and filters that a pair at the threshold has in common on average, over all of them.
CODES, PAIRS = 8, 20
#: Vectors of a filter that its height aims at, on average; vectors of a block, about; codewords of a block of coordinates at most.
AIM, BLOCK, WORDS = 512, 4096, 4096
#: Filters that share a group if they have one block, about.
_PACK = 8


#: A code: its rotation (dim, dim), for each block of coordinates its codewords, and the height of the caps.
Code = tuple[np.ndarray, list[np.ndarray], float]


def caps(code: Code, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters whose caps hold a row of unit (vectors of length one)."""
    rotation, books, height = code
    turned, scores, at = unit @ rotation, [], 0
    for book in books:
        scores.append(turned[:, at : at + book.shape[1]] @ book.T / np.sqrt(len(books)))
        at += book.shape[1]
    best = [s.max(axis=1) for s in scores]
    row, name, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for i, s in enumerate(scores):
        rest = sum((b[row] for b in best[i + 1 :]), np.zeros(len(row)))
        sums = total[:, None] + s[row]
        x, word = np.nonzero(sums + rest[:, None] >= height)
        row, name, total = row[x], name[x] * s.shape[1] + word, sums[x, word]
    return row, name


def _units(rng, n: int, d: int) -> np.ndarray:
    x = rng.normal(size=(n, d))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _code(rng, filters: int, dim: int, threshold: float, pairs: float) -> Code:
    """A code of about so many filters whose caps are as low as pairs at the threshold need to share ``pairs`` on average."""
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    blocks = max(1, min(dim // 8, max(2, int(np.ceil(np.log(filters) / np.log(WORDS))))))
    words = int(np.ceil(filters ** (1 / blocks))) if dim > 1 else 2
    books = [_units(rng, words, len(part)) for part in np.array_split(np.arange(dim), blocks)]
    a, b = _units(rng, 256, dim), _units(rng, 256, dim)
    if dim > 1:
        b -= (a * b).sum(axis=1)[:, None] * a
        b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * b / np.sqrt((b * b).sum(axis=1))[:, None]
    else:
        b = a
    for height in np.arange(0.95, -1.01, -0.01):
        found = np.concatenate([np.unique(np.stack(caps((rotation, books, height), x), axis=1), axis=0) for x in (a, b)])
        if (np.unique(found, axis=0, return_counts=True)[1] == 2).sum() >= pairs * len(a):
            break
    return rotation, books, float(height)


def codes_for(count: int, dim: int, threshold: float, seed: int = SEED) -> list[Code]:
    """The codes for count vectors; the same for the same arguments."""
    filters = max(16, 2 * PAIRS * count // (AIM * CODES))
    return [_code(np.random.default_rng([seed, dim, i]), filters, dim, threshold, PAIRS / CODES) for i in range(CODES)]


def decode(codes: list[Code], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of the codes, by row and filter."""
    found = [caps(code, unit) for code in codes]
    row = np.concatenate([r for r, _ in found])
    name = np.concatenate([f * len(codes) + i for i, (_, f) in enumerate(found)])
    order = np.lexsort((name, row))
    return row[order], name[order]


def directions(vectors: pa.Array, dim: int) -> np.ndarray:
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _filtered(reps: DataFrame, codes) -> DataFrame:
    """reps (rep, copies, dim, v) once for each filter of theirs: (dim, filter, rep, copies, v)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                s = batch.slice(at, 256)
                dims = s.column(2).to_numpy()
                for dim in np.unique(dims).tolist():
                    b = s.take(pa.array(np.flatnonzero(dims == dim)))
                    row, name = decode(codes.value[dim], directions(b.column(3), dim))
                    at_row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column(2).take(at_row), pa.array(name), *[b.column(i).take(at_row) for i in (0, 1, 3)]], names=["dim", "filter", "rep", "copies", "v"])

    return reps.select("rep", "copies", "dim", "v").mapInArrow(kernel, T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("filter", T.LongType()), reps.schema["rep"], reps.schema["copies"], reps.schema["v"]]))


def earlier(codes: list[Code], unit: np.ndarray, name: int) -> np.ndarray:
    """Bits of the filters before ``name`` that each row has, of those that several rows have: (rows, words of 64 bits)."""
    found = [decode(codes, unit[at : at + 256]) for at in range(0, len(unit), 256)]
    row = np.concatenate([r + 256 * i for i, (r, _) in enumerate(found)])
    value = np.concatenate([f for _, f in found])
    row, value = row[value < name], value[value < name]
    _, code, n = np.unique(value, return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    row, at = row[shared[code]], place[code[shared[code]]]
    bits = np.zeros((len(unit), int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return bits


def local_classes(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place linked to each of n places by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _linked(group: pa.Table, codes: dict[int, list[Code]], threshold: float) -> tuple[np.ndarray, ...]:
    """(rep, links, root) of the rows of one filter that link: links first found here, and the least linked row here."""
    dim, name = group.column("dim")[0].as_py(), group.column("filter")[0].as_py()
    reps, copies, block = (group.column(x).to_numpy() for x in ("rep", "copies", "block"))
    unit = directions(group.column("v").combine_chunks(), dim)
    cross = group.column("left")[0].as_py() != group.column("right")[0].as_py()
    pairs = []
    for at in range(0, len(reps), 256):
        close = unit[at : at + 256] @ unit.T >= threshold
        close &= np.arange(len(reps))[None, :] > np.arange(at, at + len(close))[:, None]
        if cross:
            close &= block[at : at + 256, None] != block[None, :]
        i, j = np.nonzero(close)
        pairs.append(((i + at).astype(np.int32), j.astype(np.int32)))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    some = np.unique(np.concatenate((i, j)))
    if not len(some):
        return reps[:0], copies[:0], reps[:0]
    i, j = np.searchsorted(some, i), np.searchsorted(some, j)
    reps, copies = reps[some], copies[some]
    bits, links = earlier(codes[dim], unit[some], name), np.zeros(len(some), np.int64)
    for at in range(0, len(i), 1 << 18):
        x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        new = ~(bits[x] & bits[y]).any(axis=1)
        np.add.at(links, x[new], copies[y[new]])
        np.add.at(links, y[new], copies[x[new]])
    return reps, links, reps[local_classes(len(reps), i, j)]


def found_links(filtered: DataFrame, codes, threshold: float) -> DataFrame:
    """(rep, links, root) from filtered; a rep has a row for each group in which it links."""
    sizes = c.cut(filtered.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    packs = sizes.count() // _PACK + 1
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = filtered.join(c.maybe_broadcast(sizes, 32), ["dim", "filter"]).withColumns({"block": F.pmod(F.xxhash64("rep"), blocks), "last": blocks - 1})
    # a block meets itself and each other block of its filter once
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda x: F.struct(F.least(x, F.col("block")).alias("left"), F.greatest(x, F.col("block")).alias("right")))
    group = F.when(F.col("last") == 0, F.pmod(F.xxhash64("filter"), F.lit(packs))).otherwise(-1 - F.col("filter"))
    dealt = placed.select("dim", "filter", "rep", "copies", "v", "block", group.alias("group"), F.explode(each).alias("p")).select("*", "p.left", "p.right").drop("p")

    def kernel(table: pa.Table) -> pa.Table:
        names = table.column("filter").to_numpy()
        order = np.argsort(names, kind="stable")
        parts = [_linked(table.take(pa.array(at)), codes.value, threshold) for at in np.split(order, np.flatnonzero(np.diff(names[order])) + 1) if len(at) > 1]
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
        return pa.table(dict(zip(("rep", "links", "root"), cols, strict=True)))

    return dealt.groupBy("dim", "group", "left", "right").applyInArrow(kernel, "rep long, links long, root long")


def links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """A row for each row of df: id, n_links, component_id, kept.

    Vectors link if their cosine, in doubles, is threshold or more; n_links counts the others that a
    vector was found to link with, component_id is the least id reachable, its own included, kept
    tells whether that is its own. What is found is verified; a pair at the threshold is missed in
    some cases of a thousand, nearer ones hardly (README).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different length. Repeated rows are vectors each, that link. A null id
    doesn't count as least; without any other the component_id is null, and such a row is kept. An
    empty df gives no rows; other columns, whatever their names, don't matter. All rows are compared.
    """
    rows = c.with_row(df).select("_tmk_row", F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.filter(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).select(F.col("_tmk_row").alias("row"), "v", F.xxhash64("v").alias("h"))
    # vectors that no other equals leave at once
    often = c.cut(good.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    often = c.maybe_broadcast(often, 32)
    equal = c.cut(good.join(often, "h", "left_semi").groupBy("h", "v").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    copies = c.cut(good.join(c.maybe_broadcast(equal, 1024), ["h", "v"]).select("row", "rep", "copies"))
    later = c.maybe_broadcast(copies.filter("row <> rep").select("row"), 32)
    first = copies.filter("row = rep").select("row", "copies")
    reps = c.cut(good.join(later, "row", "left_anti").join(c.maybe_broadcast(first, 48), "row", "left").select(F.col("row").alias("rep"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.size("v").alias("dim"), "v"))
    counts = {r.dim: r.n for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each length of vectors
    codes = df.sparkSession.sparkContext.broadcast({dim: codes_for(n, dim, threshold) for dim, n in counts.items()})
    found = c.cut(found_links(_filtered(reps, codes), codes, threshold))
    roots = components(found, "rep", "root")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = rows.select("_tmk_row", "id").join(c.maybe_broadcast(copies, 64), F.col("_tmk_row") == F.col("row"), "left").select("_tmk_row", "id", F.coalesce("rep", "_tmk_row").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    each = named.join(c.maybe_broadcast(c.cut(linked), 64), "rep", "left").select("_tmk_row", "id", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    each = c.cut(each)
    least = each.filter("n_links > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    told = each.filter("n_links > 0").join(least, "root").select("id", "n_links", "component_id").union(each.filter("n_links = 0").select("id", "n_links", F.col("id").alias("component_id")))
    return told.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


#: op13 in DuckDB's SQL, by brute force.
ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
u AS (SELECT * FROM n WHERE norm > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT vec_id, (SELECT count(*) FROM l WHERE x = vec_id) AS n_links, (SELECT min(y) FROM r WHERE x = vec_id) AS component_id, vec_id = (SELECT min(y) FROM r WHERE x = vec_id) AS kept FROM embeddings
"""
