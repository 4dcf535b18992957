"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with rate r has r copies on average: floor(r) for certain and one more
with probability r - floor(r). These probabilities are rounded in pairs: word mass moves from
one document to the other, either way at random so that neither mean changes, until one of the
two is integral. The words that a source gives therefore stay the same at each step, and only
the last fractional document is rounded on its own. Blocks of a source are rounded in parallel;
the document that each leaves fractional goes on to the next level of a reduction tree.
What the last document of a source of many blocks then adds or lacks goes back to the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamarack.llm import _common as c
from tamarack.llm._text import sliced, word_count

#: Documents of a block at the leaves of the tree, and residuals that meet at each level above.
LEAF, FAN = 4096, 1024
#: Rows of the same id and size up to which they may meet in a block.
REPEATS = 64


def sizes(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, size) of each row: words between ASCII white space, 0 for null."""
    kept = docs.select(*keep)

    def kernel(batches):
        for b in sliced(batches):
            n = pa.array([word_count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "size"])

    return docs.select(*keep, text_col).mapInArrow(kernel, T.StructType([*kept.schema.fields, T.StructField("size", T.LongType())]))


def ranked(df: DataFrame, order) -> DataFrame:
    """df with rank, from 0, in the given order: sorted by ranges, counted by partition."""
    parts = c.cut(df.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).selectExpr("_part", "sum(n) over (order by _part) - n as before")
    return parts.join(F.broadcast(before), "_part").withColumn("rank", F.col("_at") + F.col("before")).drop("_part", "_at", "before")


def targets(by_source: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """by_source (source, source_size, ...) with weight and target.

    Targets are level * weight, or cap * source_size where that is less, with the level at which
    they sum to ``share`` of all sizes. Each round of resharing is one sum over the sources.
    """
    own = c.cut(ranked(by_source, F.col("source").asc_nulls_last()).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", cap * F.col("source_size").cast("double")))
    total, weight = own.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (share * total / weight if weight else 0.0), -1
    while True:
        at = F.lit(level) * F.col("weight") >= F.col("most")
        taken, left, n = own.agg(F.sum(F.when(at, F.col("most"))), F.sum(F.when(~at, F.col("weight"))), F.count(F.when(at, 1))).first()
        if not left or n == full:
            break
        level, full = (share * total - (taken or 0.0)) / left, n
    return own.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("most"))).drop("most", "rank")


def pivot(p: np.ndarray, words: np.ndarray, u: np.ndarray, last: bool) -> np.ndarray:
    """p (each in (0, 1)) rounded to 0 or 1; one may stay fractional unless ``last``.

    The last one is rounded at random; its error in words is then evened out, from large to small,
    by documents of the group that fit into it, as one text may hold much of a small source.
    """
    out, i = p.copy(), 0
    for j in range(1, len(out)):
        if i is None:
            i = j
            continue
        a, b, x, y = out[i], out[j], words[i], words[j]
        up, down = min((1 - a) * x, b * y), min(a * x, (1 - b) * y)
        if u[j] * (up + down) < down:  # i gains what j loses
            if (1 - a) * x <= b * y:
                out[i], out[j] = 1.0, max(0.0, b - up / y)
            else:
                out[i], out[j] = min(1.0, a + up / x), 0.0
        elif a * x <= (1 - b) * y:
            out[i], out[j] = 0.0, min(1.0, b + down / y)
        else:
            out[i], out[j] = max(0.0, a - down / x), 1.0
        open_ = [k for k in (i, j) if 1e-12 < out[k] < 1 - 1e-12]
        i = open_[0] if open_ else None
    near = (out <= 1e-12) | (out >= 1 - 1e-12)
    out[near] = np.round(out[near])
    if last and not near.all():
        k = int(np.flatnonzero(~near)[0])
        whole = float(u[0] < out[k])
        over, out[k] = (whole - out[k]) * words[k], whole
        for j in np.argsort(-words, kind="stable"):  # even out what the last document's rounding adds or lacks
            if j != k and words[j] <= abs(over) and out[j] == (over > 0):
                out[j] = 1 - out[j]
                over += words[j] if out[j] else -words[j]
    return out


def _rounded(level: int):
    def of(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ids, size = table["_key"].to_numpy(), table["size"].to_numpy()
        at = np.lexsort((ids, -size))  # from large to small, so that what is left over is small
        seed = xxhash.xxh64_intdigest(repr((level, table["source"][0].as_py(), table["_block"][0].as_py())))
        p = np.empty(n)
        p[at] = pivot(table["_p"].to_numpy()[at], size[at].astype(float), np.random.Generator(np.random.Philox(seed)).random(n), table["_ends"][0].as_py() == level)
        return table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p))

    return of


def _flipped(table: pa.Table) -> pa.Table:
    """A block with documents of up to _share words, from large to small, added or (below 0) taken away."""
    p, size, ids, left = table["_p"].to_numpy().copy(), table["size"].to_numpy(), table["_key"].to_numpy(), table["_share"][0].as_py()
    for j in np.lexsort((ids, -size)):
        if 0 < size[j] <= abs(left) and p[j] == (left < 0):
            p[j] = 1 - p[j]
            left += -size[j] if p[j] else size[j]
    return table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p)).drop_columns(["_share"])


def _evened(out: DataFrame) -> DataFrame:
    """out with the words that sources of many blocks are off their targets evened out by documents that fit.

    Only sums of blocks are compared, only blocks that are asked for words move. A round flips a
    document at least where one fits, so rounds end.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    while True:
        many = out.filter("_ends > 0")
        over = many.groupBy("source").agg((F.sum((F.col("copies") + F.col("_p")) * F.col("size")) - F.max("target")).alias("over")).filter("abs(over) >= 1 - 1e-6").select(F.col("source").alias("_of"), F.round("over").alias("over"))
        over = c.maybe_broadcast(c.cut(over), 64)
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("over")) & (F.col("_p") == F.when(F.col("over") > 0, 1.0).otherwise(0.0))
        room = many.join(over, same("source", "_of")).filter(fits).groupBy("_of", "over", F.col("_leaf").alias("_at")).agg(F.sum("size").alias("room"))
        left = F.abs("over") - (F.sum("room").over(Window.partitionBy("_of").orderBy("_at")) - F.col("room"))
        asked = c.cut(room.withColumn("_left", left).filter("_left > 0").select("_of", "_at", (-F.signum("over") * F.least("room", "_left")).alias("_share")))
        if asked.isEmpty():
            return out
        asked = c.maybe_broadcast(asked, 64)
        at = same("source", "_of") & (F.col("_leaf") == F.col("_at"))
        moved = c.cut(out.join(asked, at).drop("_of", "_at").groupBy("source", "_leaf").applyInArrow(_flipped, out.schema))
        out = out.join(asked, at, "left_anti").union(moved)


def sized_rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(_key, _id, source, _keep, size) of each row; _key is a hash of id and size, and of the place in the input where many rows agree in these."""
    rows = docs if "_tmk_row" in keep else c.with_row(docs)
    own = rows.select("_tmk_row", F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"), F.struct(*keep).alias("_keep") if keep else F.lit(None).cast("int").alias("_keep"))
    sized = c.cut(sizes(own, "_text", ["_tmk_row", "_id", "source", "_keep"]))
    again = c.cut(sized.filter("_id is not null").groupBy(F.xxhash64("_id", "size").alias("_key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REPEATS).select("_key", F.lit(True).alias("_again")))
    keyed = sized.withColumn("_key", F.xxhash64("_id", "size")).join(c.maybe_broadcast(again, 48), "_key", "left")
    return keyed.withColumn("_key", F.when(F.col("_id").isNull() | F.col("_again"), F.xxhash64("_key", "_tmk_row")).otherwise(F.col("_key"))).drop("_again", "_tmk_row")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, copies, taken (copies * size), and keep.

    Sources in code point order, null last and a source of its own, take the weights in turn and
    share ``share`` times all words; none gets over ``cap`` times its own. A row has floor(rate)
    or ceil(rate) copies, so never over ceil(cap). Rows without words take nothing. Draws depend
    on ids and sizes only, so reruns agree; of rows with the same id and size, which of them is
    copied is open. Rows without an id, and of an id and size that over REPEATS rows have, are told
    apart by their place in the input, so no block of a source holds them all. Texts are read whole,
    whatever their length. An empty table gives no rows; other columns don't matter.
    """
    keep = [k for k in (keep or []) if k != id_col]
    sized = sized_rows(docs, id_col, source_col, text_col, keep)
    by_source = c.cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, cap))
    rates = by_source.select(F.col("source").alias("_of"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"), F.ceil(F.col("n") / LEAF).alias("_blocks"))
    rates = c.maybe_broadcast(rates, 128)
    leaves = sized.join(rates, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    leaves = leaves.withColumn("copies", F.floor("_rate")).withColumn("_p", F.when(F.col("size") > 0, F.col("_rate") - F.col("copies")).otherwise(0.0))
    leaves = leaves.withColumn("_block", F.expr("pmod(_key, _blocks)")).drop("_rate")
    open_ = (F.col("_p") > 1e-12) & (F.col("_p") < 1 - 1e-12)
    most, depth = by_source.agg(F.max(F.ceil(F.col("n") / LEAF))).first()[0] or 1, 0
    while FAN**depth < most:
        depth += 1
    leaves = leaves.withColumn("_ends", F.coalesce(*[F.when(F.col("_blocks") <= FAN**i, i) for i in range(depth + 1)])).drop("_blocks")
    leaves = leaves.withColumn("_leaf", F.col("_block"))
    done, now = [leaves.filter(~open_)], leaves.filter(open_)
    for level in range(depth + 1):
        if level:
            now = now.filter(open_).withColumn("_block", F.floor(F.col("_block") / FAN))
        now = c.cut(now.groupBy("source", "_block").applyInArrow(_rounded(level), now.schema))
        done.append(now.filter(~open_))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    if depth:
        out = _evened(out)
    copies = (F.col("copies") + F.round("_p").cast("long")).alias("copies")
    return out.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", copies, (copies * F.col("size")).alias("taken"), *[F.col("_keep")[k].alias(k) for k in keep])


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, numbered from 1 in the column mix_copy (one of that name gives way).

    All other columns stay, whatever their names. A row without words is never taken; see mix.
    """
    rows = c.with_row(docs.drop("mix_copy"))
    taken = c.cut(mix(rows, keep=["_tmk_row"], **options).filter("copies > 0").select("_tmk_row", F.col("copies").cast("int").alias("_tmk_copies")))
    out = rows.join(c.maybe_broadcast(taken, 48), "_tmk_row").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_tmk_copies"))))
    return c.without_row(out.drop("_tmk_copies"))
