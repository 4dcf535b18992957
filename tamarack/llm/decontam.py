"""Benchmark decontamination by templates.

Texts are canonicalised: numbers, units and names (words that begin with a capital, wherever they
stand) become typed placeholders, other words lose case and punctuation. Windows of these template
tokens are hashed, and so are windows of the plain lower-cased tokens; those of the documents that
pass a bitmap of the benchmark's hashes are joined with them. A plain window is a verbatim piece
of the item and always counts. A template window counts where its slots are consistent: within a
run of windows, each value of the item's slots stands for one value of the document's and the
other way round, as in a question whose numbers or names were replaced throughout.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import _common as c
from tamarack.llm._text import pieces, sliced, utf8

#: Words that count as units.
UNITS = frozenset("mm cm m km in inch inches ft feet yd mile miles mg g kg t lb lbs oz ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent usd eur dollar dollars euro euros cent cents km/h mph kmh w kw kwh v a hz".split())
_NUMBER = re.compile(r"[+-]?\d[\d.,]*")
_WITH_UNIT = re.compile(r"([+-]?\d[\d.,]*)([A-Za-z%]+)")
_MARKS = ".,;:!?|*#$%&'\"()[]{}-"
_EDGES = re.compile(r"^\W+|\W+$")
WORD, NUMBER, UNIT, NAME = range(4)
#: Bits of the bitmap that windows are looked up in before the join: 8 MB, whatever the benchmark.
BITMAP = 26
_VOCABULARY = 1 << 17


class Tokens(dict):
    """From a raw token to the row of its properties; forgets all when full."""

    def __init__(self) -> None:
        super().__init__()
        self.plain, self.template, self.slot, self.value = [], [], [], []

    def __missing__(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "replace")
        core, number = text.strip(_MARKS), False
        if not core.isalpha():  # most are letters and marks, and need no pattern
            core = _EDGES.sub("", text)
            number = bool(_NUMBER.fullmatch(core) or ((m := _WITH_UNIT.fullmatch(core)) and (m[2].lower() in UNITS or m[2] == "%")))
        low = core.lower()
        kind = NUMBER if number else UNIT if low in UNITS else NAME if len(core) > 1 and core[0].isupper() else WORD
        self.plain.append(xxhash.xxh64_intdigest(low) if low else 0)
        self.template.append(self.plain[-1] if kind == WORD else xxhash.xxh64_intdigest(f"<{kind}>"))
        self.slot.append(kind != WORD)
        self.value.append(low)
        self[raw] = row = len(self.value) - 1
        return row


_PRIME = 0x9E3779B185EBCA87
_KINDS = {"plain": np.uint64, "template": np.uint64, "slot": bool}


class Canonical:
    """The tokens of texts, as rows of what is known of them; those without a letter or digit are left out."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.tokens, self.known = Tokens(), 0
        for name, kind in _KINDS.items():
            setattr(self, name, np.empty(1 << 16, kind))

    def learn(self) -> None:
        """Brings the arrays up to the tokens seen."""
        new = len(self.tokens.value)
        for name in _KINDS:
            at = getattr(self, name)
            if new > len(at):
                at = np.concatenate((at, np.empty(max(new - len(at), len(at)), at.dtype)))
                setattr(self, name, at)
            at[self.known : new] = getattr(self.tokens, name)[self.known :]
        self.known = new

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.tokens) > _VOCABULARY:
            self.forget()
        ids = [np.fromiter(map(self.tokens.__getitem__, words := p.split()), np.int64, len(words)) for p in pieces(utf8(text))]
        rows = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        if len(self.tokens.value) > self.known:
            self.learn()
        return rows[self.plain[rows] != 0] if len(rows) else rows

    def values(self, rows: np.ndarray) -> list[str]:
        return [self.tokens.value[r] for r in rows.tolist()]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` template tokens."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, mixed = np.full(n, width, np.uint64), hashes ^ (hashes >> np.uint64(29))
    for i in range(width):
        out *= np.uint64(_PRIME)
        out += mixed[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


#: Sets template windows apart from plain ones.
_TEMPLATE = np.uint64(0x5851F42D4C957F2D)
_WINDOW = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("slots", T.ArrayType(T.StringType()))])


def windows(rows: DataFrame, widths, least: int, bitmap=None, item: bool = False) -> DataFrame:
    """rows: (key, text). (key, width, pos, hash, slots) of the windows, of those in the bitmap if given.

    Each position has a plain window, which has no slots, and a template window if it has any slots
    and ``least`` other tokens. item: the text is a whole item, so if it is shorter than the largest
    width, it is one window. Else a width under ``least`` counts only if it is the whole text's.
    """
    key = rows.schema.fields[0]

    def kernel(batches):
        canonical = Canonical()
        for b in sliced(batches):
            keys, cols = [], ([], [], [], [])
            bits = bitmap.value if bitmap is not None else None

            def add(i, width, tokens, h, ok, slots):
                if bits is not None:
                    at = (h >> np.uint64(64 - BITMAP)).astype(np.int64)
                    hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                    ok = hit if ok is None else ok & hit
                for p in (range(len(h)) if ok is None else np.flatnonzero(ok).tolist()):
                    keys.append(i)
                    own = canonical.values(tokens[p + np.flatnonzero(slots[p : p + width])]) if slots is not None else []
                    for col, v in zip(cols, (width, p, int(h[p].astype(np.int64)), own), strict=True):
                        col.append(v)

            for i, text in enumerate(b.column(1).to_pylist()):
                tokens = canonical(text)
                n = len(tokens)
                for width in [min(max(widths), n)] if item else widths:
                    if not 0 < width <= n or (width < least and width < n):
                        continue
                    add(i, width, tokens, window_hashes(canonical.plain[tokens], width), None, None)
                    slots = canonical.slot[tokens]
                    run = np.concatenate(([0], np.cumsum(slots)))
                    held = run[width:] - run[:-width]
                    if (ok := (held > 0) & (held <= width - least)).any():
                        add(i, width, tokens, window_hashes(canonical.template[tokens], width) ^ _TEMPLATE, ok, slots)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *[pa.array(v, t) for v, t in zip(cols, types, strict=True)]], names=[b.schema.names[0], *_WINDOW.names])

    return rows.mapInArrow(kernel, T.StructType([key, *_WINDOW.fields]))


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the column hash, put together from parts of 4 KB by Spark."""
    at = F.shiftrightunsigned("hash", 64 - BITMAP)
    parts = hashes.select(at.alias("at")).distinct().groupBy(F.shiftright("at", 15).alias("part")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).collect()  # at most 2 ** (BITMAP - 15) parts
    out = np.zeros(1 << (BITMAP - 3), np.uint8)
    for part, bits in parts:
        out[part << 12 : (part + 1) << 12] = np.frombuffer(bytes(bits), np.uint8)
    return out


def agreeing(found: dict[int, list[tuple[str, str]] | None]) -> tuple[list[int], int, bool]:
    """Of one alignment's windows: the positions that count, the longest run of them, whether a slot's value differs.

    found has the slots' pairs of values (the item's, the document's) by position, None for a
    verbatim window. Within a run, values of template windows must map one to one. If they don't over
    the whole alignment, the longest run that does counts, with all verbatim windows.
    """
    order = sorted(found)
    ways: tuple[dict, dict] = ({}, {})
    clashes = 0

    def add(pairs, step: int) -> None:
        nonlocal clashes
        for pair in pairs or ():
            for way, (x, y) in zip(ways, (pair, pair[::-1]), strict=True):
                of = way.setdefault(x, {})
                before = len(of)
                of[y] = of.get(y, 0) + step
                if not of[y]:
                    del of[y]
                clashes += (len(of) > 1) - (before > 1)

    for p in order:
        add(found[p], 1)
    whole = not clashes
    for way in ways:
        way.clear()
    clashes = first = 0
    best = (0, 0)
    for i, p in enumerate(order):
        if i and p != order[i - 1] + 1:
            for way in ways:
                way.clear()
            clashes, first = 0, i
        add(found[p], 1)
        while clashes:
            add(found[order[first]], -1)
            first += 1
        best = max(best, (i + 1 - first, -first))
    n, start = best[0], -best[1]
    counted = order if whole else sorted({*order[start : start + n], *(p for p in order if found[p] is None)})
    return counted, n, any(i != d for p in counted for i, d in found[p] or ())


_AGREED = "_tmk_row long, _item long, at array<int>, run int, reworded boolean"


def _agreed(alignments: DataFrame) -> DataFrame:
    """alignments: (_tmk_row, _item, w), w the windows (at, i, d) of one alignment. agreeing() of each."""

    def kernel(batches):
        for b in batches:
            out = []
            for w in b.column(2).to_pylist():
                found: dict = {}
                for x in w:
                    if not x["i"]:
                        found[x["at"]] = None
                    else:
                        found.setdefault(x["at"], list(zip(x["i"], x["d"], strict=True)))
                out.append(agreeing(found))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.list_(pa.int32()), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["_tmk_row", "_item", "at", "run", "reworded"])

    return alignments.mapInArrow(kernel, _AGREED)


def leaks_of(rows: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 4, coverage: float = 0.5, run: int = 6, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(_tmk_row, item, windows, item_windows, run, reworded) of the rows of rows (which has _tmk_row) that leak an item; see find_leaks."""
    bench = c.cut(benchmark.select(F.col(item_col).alias("_item_id"), F.col(text_col).alias("_text")).withColumn("_item", F.monotonically_increasing_id()))
    items = c.cut(windows(bench.select("_item", "_text"), [width], least, item=True))
    widths = sorted(w for (w,) in items.select("width").distinct().collect())  # at most ``width`` values
    bits = rows.sparkSession.sparkContext.broadcast(bitmap_of(items))
    found = c.cut(windows(rows.select("_tmk_row", text_col), widths, least, bits))
    of = items.groupBy("_item").agg(F.count_distinct("pos").alias("item_windows"))
    side = items.select("_item", "width", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    hits = found.join(c.maybe_broadcast(side, 256), ["hash", "width"]).filter(F.size("slots") == F.size("item_slots"))
    aligned = hits.groupBy("_tmk_row", "_item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_list(F.struct(F.col("item_pos").alias("at"), F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("w"))
    each = _agreed(aligned.select("_tmk_row", "_item", F.sort_array("w").alias("w")))
    leaks = each.groupBy("_tmk_row", "_item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("windows"), F.max("run").alias("run"), F.max("reworded").alias("reworded")).join(of, "_item")
    return c.cut(leaks.filter((F.col("windows") >= F.col("item_windows") * coverage) | (F.col("run") >= run)).join(bench.select("_item", "_item_id"), "_item").drop("_item"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", keep: list[str] | None = None, **options) -> DataFrame:
    """A row for each row of docs and benchmark item that it leaks: id, item, windows, item_windows, coverage, reworded, run, and keep.

    windows counts the item's windows of ``width`` tokens that the document has, verbatim but for
    case and punctuation, or, where ``least`` tokens are plain words, with other numbers, units or
    names in consistent slots. It is a leak if that is ``coverage`` of them, or if ``run`` of them
    follow each other in item and document (width + run - 1 tokens in a row). reworded tells that a
    slot's value differs. An item shorter than ``width`` is one window of its own length; one of
    fewer than ``least`` tokens is found only where a document has nothing else. Texts are read
    whole, whatever their length. Null and empty texts leak nothing, null ids count like any other.
    Repeated documents or items have rows each. Empty tables give no rows; other columns don't matter.
    """
    keep = [k for k in (keep or []) if k != id_col]
    rows = c.with_row(docs)
    leaks = leaks_of(rows, benchmark, item_col=item_col, **options)
    out = rows.select("_tmk_row", F.col(id_col).alias("_tmk_id"), F.struct(*keep).alias("_keep") if keep else F.lit(None).cast("int").alias("_keep")).join(c.maybe_broadcast(leaks, 96), "_tmk_row")
    return out.select(F.col("_tmk_id").alias(id_col), F.col("_item_id").alias(item_col), F.col("windows").cast("long").alias("windows"), "item_windows", F.round(F.col("windows") / F.col("item_windows"), 6).alias("coverage"), "reworded", "run", *[F.col("_keep")[k].alias(k) for k in keep])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that leak an item, as find_leaks tells; null and empty texts stay, as do all columns."""
    rows = c.with_row(docs)
    return c.without_rows(rows, leaks_of(rows, benchmark, **options).select("_tmk_row").distinct())
