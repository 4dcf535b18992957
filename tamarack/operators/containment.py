"""Which texts contain which phrases, by an inverted index of the phrases' rarest grams.

A gram is Q bytes in a row. Each phrase is keyed by the gram of its own that the texts have least
often; texts are searched for these grams, a join by gram gives phrases that may start at a place,
and the bytes there decide. Phrases shorter than a gram are keyed by themselves. A bitmap of the
grams wanted, of a size that grows with their number up to a bound, spares the join most of the
texts' grams; it never leaves a wanted one out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.lineage import cut, maybe_broadcast, with_row, without_row

#: Bytes of a gram, bytes of texts searched at once, and the logarithms of the least and largest number of bits in the bitmap of wanted grams.
Q, _PIECE, _SMALL, _LARGE = 8, 1 << 20, 16, 30
_PRIMES = (np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F))


def grams(texts: pa.Array, size: int, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, gram) of all runs of ``size`` bytes, up to Q, within the texts, of those that bits may have; a gram is its bytes as a number."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] - offsets[0] < size:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    for at in range(int(offsets[0]), int(offsets[-1]) - size + 1, _PIECE):
        n = min(_PIECE, int(offsets[-1]) - at - size + 1)
        own = np.zeros(n + Q, np.uint8)  # as far as a run of Q bytes from the last place on reaches
        own[: n + size - 1] = data[at : at + n + size - 1]
        gram = np.ndarray(n, "<u8", own.data, strides=(1,)).copy()
        if size < Q:
            gram &= np.uint64((1 << 8 * size) - 1)
        place = np.flatnonzero(_may_be(bits, gram)) if bits is not None else np.arange(n)
        gram, place = gram[place], place + at
        row = np.searchsorted(offsets, place, "right") - 1
        inside = place + size <= offsets[row + 1]
        row = row[inside]
        yield row, place[inside] - offsets[row], gram[inside]


def _probe(gram: np.ndarray, bits: int, which: int) -> np.ndarray:
    return (gram * _PRIMES[which] >> np.uint64(64 - bits)).astype(np.int64)


def _may_be(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Whether the bits of both probes of each gram are set."""
    bits = int(np.log2(8 * len(table)))
    at = _probe(gram, bits, 0)
    ok = table[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    some = np.flatnonzero(ok)
    at = _probe(gram[some], bits, 1)
    ok[some] = table[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    return ok


def _signed(gram: np.ndarray) -> pa.Array:
    return pa.array(gram.view(np.int64))


def _searched(df: DataFrame, text: str, wanted: dict, schema: str, emit) -> DataFrame:
    """A kernel over df's first column and text, which emit gets with the grams in wanted, by size."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, bits in wanted.items():
                for row, place, gram in grams(b.column(1), size, bits.value if bits is not None else None):
                    yield emit(b.column(0), size, row, place, gram)

    return df.select(df.columns[0], text).mapInArrow(kernel, schema)


def _wanted(keys: DataFrame) -> dict:
    """Broadcast bitmaps of the grams in keys (size, gram), by size.

    They are put together in tasks, from parts, so the driver gets bitmaps of a bounded size, not the grams.
    """
    spark, out = keys.sparkSession, {}
    for size, n in sorted((r["size"], r.n) for r in keys.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()):  # at most Q sizes
        bits = int(np.clip(np.ceil(np.log2(32 * n)), _SMALL, _LARGE))

        def parts(batches, bits=bits):
            for b in batches:
                gram = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for which in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(_probe(gram, bits, which))], names=["at"])

        at = keys.filter(F.col("size") == size).select("gram").mapInArrow(parts, "at long").distinct()
        own = np.zeros(1 << (bits - 3), np.uint8)
        for part, x in at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).toLocalIterator():
            own[part << 12 : (part + 1) << 12] = np.frombuffer(bytes(x), np.uint8)[: len(own)]
        out[size] = spark.sparkContext.broadcast(own)
    return out


def keyed(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(size, gram, place, phrase) of each phrase whose grams all occur in texts: the one that occurs least often, and its place in the phrase.

    phrases: phrase, distinct and not empty; texts: a key and the column text.
    """
    long = phrases.filter(F.octet_length("phrase") >= Q)
    spelled = _searched(long.select("phrase", F.col("phrase").alias("_text")), "_text", {Q: None}, "phrase string, size int, gram long, place int", lambda key, size, row, place, gram: pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array(np.full(len(row), size), pa.int32()), _signed(gram), pa.array(place, pa.int32())], names=["phrase", "size", "gram", "place"]))
    own = cut(spelled.groupBy("phrase", "size", "gram").agg(F.min("place").alias("place")))

    def counted(key, size, row, place, gram):
        value, n = np.unique(gram, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size), pa.int32()), _signed(value), pa.array(n)], names=["size", "gram", "n"])

    counts = _searched(texts, "text", _wanted(own.select("size", "gram").distinct()), "size int, gram long, n long", counted).groupBy("size", "gram").agg(F.sum("n").alias("n"))
    rated = own.join(counts, ["size", "gram"], "left")
    best = rated.groupBy("phrase", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "gram")).alias("b")).filter("b.n > 0")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [p.encode() for p in b.column(0).to_pylist()]
            gram = np.array([int.from_bytes(p, "little") for p in own], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in own], pa.int32()), _signed(gram), pa.array(np.zeros(len(own), np.int32)), b.column(0)], names=["size", "gram", "place", "phrase"])

    short = phrases.filter(F.octet_length("phrase") < Q).select("phrase").mapInArrow(whole, "size int, gram long, place int, phrase string")
    return best.select("size", "b.gram", "b.place", "phrase").union(short)


def pairs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(_tmk_row, phrase) of each text, by row, and phrase in it. texts: _tmk_row, text; phrases: phrase, distinct and not empty."""
    keys = cut(keyed(phrases, texts))

    def first(key, size, row, place, gram):
        if size < Q:  # such a gram is the whole phrase, wherever it is
            _, at = np.unique(np.stack((row.astype(np.uint64), gram), axis=1), axis=0, return_index=True)
            row, place, gram = row[at], place[at], gram[at]
        return pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array(np.full(len(row), size), pa.int32()), _signed(gram), pa.array(place, pa.int32())], names=["_tmk_row", "size", "gram", "at"])

    hits = _searched(texts, "text", _wanted(keys.select("size", "gram").distinct()), "_tmk_row long, size int, gram long, at int", first)
    may = cut(hits.join(maybe_broadcast(keys, 256), ["size", "gram"]).filter("at >= place").select("_tmk_row", (F.col("at") - F.col("place") + 1).alias("at"), "phrase"))
    bare = F.col("text").cast("binary")
    looked = texts.join(maybe_broadcast(may, 256), "_tmk_row").filter(F.substring(bare, F.col("at"), F.octet_length("phrase")) == F.col("phrase").cast("binary"))
    return looked.select("_tmk_row", "phrase").distinct()


def containing(texts: DataFrame, phrases: DataFrame, how: str = "left_semi", text: str = "text", phrase: str = "phrase") -> DataFrame:
    """texts joined (``left_semi`` or ``inner``) with the phrases they contain, both in lower case; null and empty phrases match nothing.

    Any substring counts. Repeated texts and phrases are rows each; null texts contain nothing.
    """
    low = phrases.filter(F.coalesce(F.col(phrase), F.lit("")) != "").withColumn("_phrase", F.lower(phrase))
    rows = with_row(texts)
    found = cut(pairs(rows.select("_tmk_row", F.lower(text).alias("text")), low.select(F.col("_phrase").alias("phrase")).distinct()).withColumnRenamed("phrase", "_phrase"))
    if how == "left_semi":
        return without_row(rows.join(maybe_broadcast(found.select("_tmk_row").distinct(), 32), "_tmk_row", "left_semi"))
    return without_row(rows.join(maybe_broadcast(found, 256), "_tmk_row").join(low, "_phrase").drop("_phrase"))
