"""SimHash near-duplicate classes, candidates by pigeonring filtering.

A 64-bit fingerprint is cut into ``bits + 1`` segments on a ring. If two fingerprints differ in
at most ``bits`` bits, the ring has a start from which every chain of ``l`` consecutive segments
differs in at most ``l * bits / (bits + 1)`` bits: none in the first segment, at most one in the
first two, at most two in the first three, and so on. The first three budgets become equality
keys (below), the whole chain is checked on each candidate, then the Hamming distance.

Only connectivity is wanted, so a bucket of candidates is never expanded into all its pairs:
its members are compared with the bucket's leader, what that leaves apart is compared only
across the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import _common as c
from tamarack.llm._text import pieces, sliced, utf8
from tamarack.llm.components import components
from tamarack.llm.decontam import window_hashes

SEED = 42
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words, if there are fewer."""
    digest, parts, tail = xxhash.xxh64_digest, [], []
    for piece in pieces(utf8(text).lower()):
        words = tail + piece.split()
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            parts += [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
            parts = [b"".join(parts)]
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if not parts and tail:
        parts = [digest(b" ".join(tail), SEED)]
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``counts`` (all positive) hashes, the bits set in over half of each.

    Eight counters of a byte share a word, so groups are summed in segments of 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    if not len(counts):
        return out
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    per = -(-counts // 255)
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    segments = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, segments)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for b in range(8):
            out |= (2 * sums[:, b] > counts).astype(np.uint64) << np.uint64(8 * b + k)
    return out


def fingerprint_texts(texts, width: int = 4, most: int = 1 << 20) -> np.ndarray:
    """Fingerprints of texts; at most about ``most`` hashes are held, and those of one text."""
    out = np.zeros(len(texts), np.uint64)
    held, rows, n = [], [], 0

    def flush() -> None:
        if rows:
            out[rows] = majority(np.concatenate(held), np.array([len(x) for x in held]))
        held.clear()
        rows.clear()

    for i, text in enumerate(texts):
        h = shingle_hashes(text, width)
        if len(h):
            held.append(h)
            rows.append(i)
            n += len(h)
        if n > most:
            flush()
            n = 0
    flush()
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, fp long) of every row. Null and empty texts have fingerprint 0."""
    kept = docs.select(id_col, *(keep or []))

    def kernel(batches):
        for b in sliced(batches):
            fp = pa.array(fingerprint_texts(b.column(b.num_columns - 1).to_pylist(), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*b.schema.names[:-1], "fp"])

    return docs.select(*kept.columns, text_col).mapInArrow(kernel, T.StructType([*kept.schema.fields, T.StructField("fp", T.LongType())]))


def _mask(at: int, width: int) -> int:
    return ((1 << width) - 1) << at


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ring's bits + 1 segments."""
    m = bits + 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def ring_masks(bits: int) -> list[int]:
    """Masks of which two fingerprints within ``bits`` bits agree on one at least.

    From the right start on the ring, the first segment agrees; the second differs in at most a
    bit, so a half of it agrees; if the second does differ, the third differs in at most a bit
    too, and a half of that agrees. So the first segment and either both halves of the second or
    a half each of the second and third agree.
    """
    if bits < 2:
        raise ValueError("bits must be 2 or more")
    ring, out = segments(bits), []
    halves = [(_mask(at, n // 2), _mask(at + n // 2, n - n // 2)) for at, n in ring]
    for i in range(len(ring)):
        a, b = halves[(i + 1) % len(ring)], halves[(i + 2) % len(ring)]
        out += [_mask(*ring[i]) | x for x in (a[0] | a[1], a[0] | b[0], a[0] | b[1], a[1] | b[0], a[1] | b[1])]
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chain_holds(a: Column, b: Column, bits: int, ring: int | None = None) -> Column:
    """Whether some start on the ring, of bits + 1 segments unless given, keeps every chain within its share of ``bits``."""
    x = a.bitwiseXOR(b)
    parts = [F.bit_count(x.bitwiseAND(F.lit(_signed(_mask(at, n))))) for at, n in segments((ring or bits + 1) - 1)]
    m, some = len(parts), F.lit(False)
    for i in range(m):
        every, total = F.lit(True), F.lit(0)
        for length in range(1, m + 1):
            total = total + parts[(i + length - 1) % m]
            every = every & (total <= length * bits // m)
        some = some | every
    return some


#: Members outside the largest part of a bucket up to which they are compared with all of it, and
#: bits of the count of fingerprints by which it grows: keys have 25 bits, so chance alone fills a
#: bucket with one in 2 ** 25, an eighth of what is allowed.
_PARTED, _CHANCE = 256, 22


def _ball_edges(fps: DataFrame, bits: int) -> DataFrame:
    """Edges that connect all of fps within ``bits`` bits, in a number of rows in proportion to fps.

    All that are within bits/2 of the same value are within ``bits`` of each other, and two within
    ``bits`` share such a value. Each is linked to the least around each value.
    """
    half, reach = bits // 2, [0]
    flips = [_signed(1 << i) for i in range(64)]
    for _ in range(half):
        reach = sorted({x ^ f for x in reach for f in [0, *flips]})
    one = fps.select("fp", F.explode(F.array(*map(F.lit, reach))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    if bits % 2:
        one = one.union(one.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"), "near").select("fp", F.col("near").bitwiseXOR(F.col("flip"))))
    least = one.groupBy("near").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("near", "b")
    linked = one.join(least, "near").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    return linked.filter(hamming(F.col("a"), F.col("b")) <= bits) if bits % 2 else linked


def link_classes(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, root) of the distinct fingerprints in fps that link to any other, by class.

    First each member of a bucket is compared with the bucket's least and greatest member. Buckets
    that are then of one class are done; in the others, what isn't in the largest class is compared
    with all members of other classes. Where that is over _PARTED members, and more than chance puts
    into a bucket, the edges come from _ball_edges instead, so no bucket needs a number of pairs that
    grows with its square. Both ways lose nothing.
    """
    most = max(_PARTED, fps.count() >> _CHANCE)
    near = lambda a, b: chain_holds(F.col(a), F.col(b), bits) & (hamming(F.col(a), F.col(b)) <= bits)
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in ring_masks(bits)])
    keys = fps.select("fp", F.posexplode(masks).alias("mask", "key")).repartition("mask", "key")
    shared = keys.groupBy("mask", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    members = c.cut(keys.join(shared, ["mask", "key"]).select("mask", "key", "fp", "low", "high"))
    led = [members.filter(F.col("fp") != F.col(x)).filter(near("fp", x)).groupBy(F.col("fp").alias("a")).agg(pick(x).alias("b")) for x, pick in (("low", F.min), ("high", F.max))]
    edges = c.cut(led[0].union(led[1]))
    roots = components(edges).withColumnRenamed("id", "fp")
    parted = members.join(roots, "fp", "left").select("mask", "key", "fp", F.coalesce("root", "fp").alias("part"))
    parts = parted.groupBy("mask", "key", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("mask", "key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    rest = c.cut(parted.join(main, ["mask", "key"]))
    few = rest.filter(F.col("others") <= most)
    apart = few.filter(F.col("part") != F.col("main")).select("mask", "key", F.col("fp").alias("a"), F.col("part").alias("part_a"))
    found = apart.join(few.select("mask", "key", F.col("fp").alias("b"), "part"), ["mask", "key"]).filter((F.col("part_a") != F.col("part")) & near("a", "b")).select("a", "b")
    if not (many := rest.filter(F.col("others") > most).select("fp").distinct()).isEmpty():
        found = found.union(_ball_edges(many, bits))
    return components(edges.union(found)).withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, class_root, and the columns in keep.

    component_id is the smallest id of all rows that are reachable by fingerprints of ``bits`` or
    fewer differing bits, the row itself included. Null and empty texts, and texts of white space,
    have fingerprint zero and link like any other. Null ids take part and never become a
    component_id unless nothing else is reachable. Repeated rows have a row each. Texts are read
    whole, whatever their length. An empty table gives no rows; other columns don't matter.
    """
    keep = keep or []
    fps = c.cut(fingerprints(docs, width, id_col, text_col, keep))
    reps = c.cut(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = link_classes(reps.select("fp"), bits)
    of = c.cut(reps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", F.col("root").alias("class_root"))
    return fps.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_root", *keep)


def drop_near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, with one row of each class of near_duplicates: of those with the smallest id, the first row."""
    rows = c.with_row(docs)
    found = c.cut(near_duplicates(rows, width, bits, id_col, text_col, ["_tmk_row"]))
    first = found.groupBy("class_root").agg(F.min_by("_tmk_row", F.struct(F.col(id_col).isNull(), id_col, "_tmk_row")).alias("_tmk_row"))
    return c.without_rows(rows, found.select("_tmk_row").join(first.select("_tmk_row"), "_tmk_row", "left_anti"))


# Near duplicates by similarity: fingerprints and rare shingles propose, shingles decide.

#: Independent fingerprints of a text's distinct words; of the masks of each, one in common makes a candidate.
TABLES = 2
#: Bits of 64 that candidates may differ in, and the bits for which a table's masks miss nothing.
_REACH, _SURE = 12, 4
_VOCABULARY = 1 << 16


class Words(dict):
    """From a word to its hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        """The hash of each word of text, A-Z in lower case."""
        parts = []
        for piece in pieces(utf8(text).lower()):
            if len(self) > _VOCABULARY:
                self.clear()
            parts.append(np.fromiter(map(self.__getitem__, words := piece.split()), np.uint64, len(words)))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; of all words, if there are fewer."""
    return np.unique(window_hashes(words, min(width, len(words))).view(np.int64)) if len(words) else np.zeros(0, np.int64)


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    """Another hash of the same, for each table."""
    h = h + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Of so many rows, one is counted to tell common shingles; most common shingles that are told.
_COUNTED, _COMMON = 16, 1 << 20


def _common_shingles(rows: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that a sample of rows has repeatedly, and how often. They only order prefixes."""

    def kernel(batches):
        known = Words()
        for b in sliced(batches):
            sets = [shingle_set(known.hashes(t), width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["key"])

    some = rows.filter(F.expr(f"pmod(xxhash64(_tmk_row), {_COUNTED}) = 0")).select(text_col).mapInArrow(kernel, "key long")
    table = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "key").limit(_COMMON).toArrow()
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(shingles: np.ndarray, common: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the distinct shingles, from rare to common, of which similar sets have one in common."""
    if not len(shingles):
        return shingles
    weight = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[at] == shingles, often[at], 0)
    most = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
    return shingles[np.lexsort((shingles, weight))[:most]]


#: Longs of the parity of a set: bit k tells whether an odd number of its hashes end in k.
_PARITY = 16
_SKETCH = "_tmk_row long, same binary, fps array<long>, size int, keys array<long>, parity array<long>"


def parity(shingles: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many members as their parities do in bits."""
    odd = np.bincount(shingles & (64 * _PARITY - 1), minlength=64 * _PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(rows: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Of each row: a digest of its words, fingerprints of its set of words; size, prefix and parity of its set of shingles."""
    told = rows.sparkSession.sparkContext.broadcast(_common_shingles(rows, text_col, width))
    types = (pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def kernel(batches):
        common, often = told.value
        known = Words()

        def batch(rows, same, sets, sizes, keys, parities):
            fps, some = np.zeros((len(sets), TABLES), np.int64), [i for i, s in enumerate(sets) if len(s)]
            if some:
                h, n = np.concatenate([sets[i] for i in some]), np.array([len(sets[i]) for i in some])
                for t in range(TABLES):
                    fps[some, t] = majority(_mixed(h, t), n).view(np.int64)
            return pa.RecordBatch.from_arrays([rows, *[pa.array(x, t) for x, t in zip((same, list(fps), sizes, keys, parities), types, strict=True)]], names=["_tmk_row", "same", "fps", "size", "keys", "parity"])

        for b in sliced(batches):
            at, held, cols = 0, 0, ([], [], [], [], [])
            for i, text in enumerate(b.column(1).to_pylist()):
                words = known.hashes(text)
                own, shingles = np.unique(words), shingle_set(words, width)
                for col, v in zip(cols, (xxhash.xxh3_128_digest(words.tobytes()), own, len(shingles), prefix(shingles, common, often, similarity), parity(shingles)), strict=True):
                    col.append(v)
                held += len(own)
                if held > 1 << 20:
                    yield batch(b.column(0)[at : i + 1], *cols)
                    at, held, cols = i + 1, 0, ([], [], [], [], [])
            yield batch(b.column(0)[at:], *cols)

    return rows.select("_tmk_row", text_col).mapInArrow(kernel, _SKETCH)


def _shingle_sets(rows: DataFrame, nodes: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, set) of the rows in nodes: sorted hashes of their distinct shingles."""

    def kernel(batches):
        known = Words()
        for b in sliced(batches):
            sets = [shingle_set(known.hashes(t), width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    own = rows.join(c.maybe_broadcast(nodes.withColumnRenamed("node", "_tmk_row"), 48), "_tmk_row", "left_semi")
    return own.select("_tmk_row", text_col).mapInArrow(kernel, "node long, set array<long>")


def _similar(pairs: DataFrame, made: DataFrame, rows: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets have that Jaccard similarity or more.

    Those whose parities (in made) differ in more bits than similar sets do in members are out; sets decide on the others.
    """
    own = lambda x: made.select(F.col("_tmk_row").alias(x), F.col("size").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}"))
    apart = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    few = apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) + 1e-6
    pairs = c.cut(pairs.distinct().join(own("a"), "a").join(own("b"), "b").filter(few).select("a", "b"))
    sets = c.cut(_shingle_sets(rows, c.cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), text_col, width))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("sum"))
    return c.cut(shared.filter(F.col("n") >= similarity * (F.col("sum") - F.col("n")) - 1e-9).select("a", "b"))


def joined_forest(left: list[np.ndarray], right: list[np.ndarray], parts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (positions in left + right) between parts that connect what pairs of a left and a right set of that similarity connect.

    What is in one of ``parts`` (a number for each set) is connected already. Sets become rows of 0
    and 1 over a slice of the hashes at a time, so their products count what is shared.
    """
    sets, n = [*left, *right], len(left)
    all_ = np.unique(np.concatenate(sets))
    shared = np.zeros((n, len(right)), np.float32)
    for at in range(0, len(all_), 4096):
        part = all_[at : at + 4096]
        rows = np.zeros((len(sets), len(part)), np.float32)
        for r, x in enumerate(sets):
            rows[r, np.searchsorted(part, x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")])] = 1
        shared += rows[:n] @ rows[n:].T
    size = np.array([len(x) for x in sets], np.float32)
    alike = (shared >= similarity * (size[:n, None] + size[None, n:] - shared) - 1e-4) & (parts[:n, None] != parts[None, n:])
    _, of = np.unique(parts, return_inverse=True)
    root, out = list(range(len(sets))), []
    for a, b in np.argwhere(alike).tolist():
        x, y = int(of[a]), int(of[b + n])
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b + n))
    return out


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each node with the nearest of the leaders of its buckets, if pigeonring lets any pass.

    A bucket holds the nodes that agree in a mask of a table; its leaders are its least and its
    greatest node. nodes: (node, fps).
    """
    tables = nodes.filter(F.exists("fps", lambda f: f != 0)).select("node", F.posexplode("fps").alias("t", "fp"))
    each = tables.select("node", "t", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in ring_masks(_SURE)])).alias("m", "key"))
    keys = each.select("node", "fp", F.xxhash64("t", "m", "key").alias("bucket")).repartition("bucket")
    ends = keys.groupBy("bucket").agg(F.min("node").alias("low"), F.min_by("fp", "node").alias("low_fp"), F.max("node").alias("high"), F.max_by("fp", "node").alias("high_fp")).filter("low <> high")
    led = keys.join(ends.hint("shuffle_hash"), "bucket").select("node", "fp", F.explode(F.array(F.struct(F.col("low").alias("b"), F.col("low_fp").alias("fb")), F.struct(F.col("high").alias("b"), F.col("high_fp").alias("fb")))).alias("l")).select("node", "fp", "l.*")
    far = hamming(F.col("fp"), F.col("fb"))
    near = led.filter((F.col("node") != F.col("b")) & chain_holds(F.col("fp"), F.col("fb"), _REACH, _SURE + 1) & (far <= _REACH))
    return near.groupBy("node").agg(F.min_by("b", far).alias("b")).select(F.col("node").alias("a"), "b")


def _room(similarity: float, size_a: str, at_a: str, size_b: str, at_b: str) -> Column:
    """Whether two sets that have the shingles at these places of their prefixes in common can be similar."""
    least = F.lit(similarity / (1 + similarity)) * (F.col(size_a) + F.col(size_b)) - 1e-6
    return F.least(F.col(size_a) - F.col(at_a), F.col(size_b) - F.col(at_b)) >= least


def _prefix_members(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node, at, size, first) of the shared shingles of the prefixes; nodes: (node, size, keys).

    Of two similar sets, the smaller has a common shingle in a still shorter prefix, marked first. A
    shingle without such a set, and sets that can't be similar to any of its sets, are left out.
    """
    first = F.col("at") <= F.col("size") - F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-9)
    packed = nodes.select("node", "size", F.posexplode("keys").alias("at", "key")).select("key", "node", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("at")).alias("place")).repartition("key")
    each = packed.select("key", "node", (F.col("place") % (1 << 32)).cast("int").alias("at"), F.shiftright("place", 32).cast("int").alias("size")).withColumn("first", first)
    full = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("first"), F.col("size"))).alias("least")).filter("n > 1 and least is not null")
    room = (F.col("size") - F.col("at")) >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("least")) - 1e-6
    return each.join(full.hint("shuffle_hash"), "key").filter(F.col("first") | room).select("key", "node", "at", "size", "first", "n")


def _prefix_leader_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each node with two leaders of its shingles, that of the rarest and that of the commonest.

    A shingle's leader is the set that has the fewest rarer ones, as the original of a family of
    copies has fewer than its copies, each of which has edits of its own.
    """
    lead = members.groupBy("key").agg(F.min(F.struct("at", "node", "size")).alias("l")).select("key", F.col("l.node").alias("b"), F.col("l.at").alias("at_b"), F.col("l.size").alias("size_b"))
    led = members.join(lead, "key").filter((F.col("node") != F.col("b")) & _room(similarity, "size", "at", "size_b", "at_b"))
    two = led.groupBy("node").agg(F.array_distinct(F.array(F.min_by("b", "at"), F.max_by("b", "n"))).alias("b"))
    return two.select(F.col("node").alias("a"), F.explode("b").alias("b"))


#: Comparisons of one shingle's bucket up to which its sets are joined; members of a block beyond.
_PAIRS, _BLOCK = 1 << 14, 256


def _prefix_edges(members: DataFrame, linked: DataFrame, made: DataFrame, rows: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) that, with those of which linked has the classes (node, root), connect all similar rows.

    In a shingle's bucket, sets are compared but for those already in one class: what isn't in the
    largest class with all others, pairs whose sizes and places leave room for the similarity.
    """
    parted = members.drop("n").join(c.maybe_broadcast(linked, 64), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    parts = parted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max_by("part", "n").alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    rest = c.cut(parted.join(main, "key").withColumn("apart", F.col("part") != F.col("main")).drop("main"))
    few = rest.filter(F.col("others") * F.col("all") <= _PAIRS)
    a = few.filter("first").select("key", *[F.col(x).alias(f"{x}_a") for x in ("node", "at", "size", "part", "apart")])
    b = few.select("key", "node", "at", "size", "part", "apart")
    smaller = F.struct("size_a", "node_a") < F.struct("size", "node")
    fits = smaller & (F.col("part_a") != F.col("part")) & _room(similarity, "size_a", "at_a", "size", "at")
    pairs = a.filter("apart_a").join(b, "key").filter(fits).union(a.filter("not apart_a").join(b.filter("apart"), "key").filter(fits))
    edges = _similar(pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")), made, rows, text_col, width, similarity)
    many = rest.filter(F.col("others") * F.col("all") > _PAIRS)
    return edges if many.isEmpty() else edges.union(_block_edges(many, rows, text_col, width, similarity))


def _block_edges(many: DataFrame, rows: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between the parts that connect all similar rows within each key; many: (key, node, part, apart).

    What is apart from the largest part, and that part, are dealt into blocks by hash. A task compares
    one block of the former with one of either, and returns fewer links than these have parts.
    """
    counts = many.groupBy("key").agg(F.ceil(F.count(F.when(F.col("apart"), 1)) / _BLOCK).alias("ka"), F.ceil(F.count(F.when(~F.col("apart"), 1)) / _BLOCK).alias("km"))
    sets = _shingle_sets(rows, c.cut(many.select("node").distinct()), text_col, width)
    own = many.join(counts, "key").withColumn("at", F.expr("if(apart, pmod(xxhash64(node), ka), ka + pmod(xxhash64(node), km))")).join(sets, "node")
    each = own.withColumn("other", F.explode(F.expr("sequence(0, if(apart, ka + km, ka) - 1)"))).select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "node", "part", "set")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("node", "ascending")]).combine_chunks()
        at, node, part = (table[x].to_numpy() for x in ("at", "node", "part"))
        sets = [x.values.to_numpy() for x in table["set"]]
        n, same = int((at == at[0]).sum()), table["i"][0].as_py() == table["j"][0].as_py()
        if same:
            links = [(a, b - n) for a, b in joined_forest(sets, sets, np.concatenate((part, part)), similarity)]
        else:  # the other block may be empty
            links = joined_forest(sets[:n], sets[n:], part, similarity) if n < len(sets) else []
        return pa.table({"a": pa.array([int(node[a]) for a, _ in links], pa.int64()), "b": pa.array([int(node[b]) for _, b in links], pa.int64())})

    return c.cut(each.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))


def similar_classes(rows: DataFrame, width: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """(_tmk_row, root) of each row of rows that is in a class with an earlier one; root is the class's first row.

    rows has _tmk_row. Classes are the components of pairs whose sets of ``width``-word shingles
    (ASCII lower case; fewer words: the whole sequence) are at least ``similarity`` alike by Jaccard;
    no such pair is lost. Rows of the same word sequence, as null, empty and blank ones of none, are
    alike without comparison, so repeated rows and ties are in one class. Texts of any length are
    read whole, an empty table gives no rows, other columns aren't read.

    Pigeonring over SimHash fingerprints of the distinct words, which move less by an edit than
    those of shingles do, gives each text the nearest leader of its buckets; what shares a rare
    shingle gives it two more. Shingle sets decide on these pairs, a few for each text, and so link
    families of copies. An exact prefix filter over the shingles, within which only texts of
    different classes are compared, then finds whatever that leaves apart.
    """
    made = c.cut(sketches(rows, text_col, width, similarity))
    firsts = c.cut(made.groupBy("same").agg(F.min("_tmk_row").alias("node")))
    copies = c.cut(made.select("_tmk_row").join(firsts.select(F.col("node").alias("_tmk_row")), "_tmk_row", "left_anti"))
    nodes = made.join(c.maybe_broadcast(copies, 48), "_tmk_row", "left_anti").withColumnRenamed("_tmk_row", "node")
    members = c.cut(_prefix_members(nodes, similarity))
    pairs = c.cut(_fingerprint_pairs(nodes)).union(_prefix_leader_pairs(members, similarity))
    edges = _similar(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), made, rows, text_col, width, similarity)
    linked = c.cut(components(edges).withColumnRenamed("id", "node"))
    more = _prefix_edges(members, linked, made, rows, text_col, width, similarity)
    found = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)).withColumnRenamed("id", "node")
    of = firsts.join(found, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return made.select("_tmk_row", "same").join(of, "same").filter(F.col("_tmk_row") != F.col("root")).select("_tmk_row", "root")


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of similar_classes: that with the smallest id (a null id comes last), then the first row.

    All columns stay, whatever their names; an empty table stays empty.
    """
    rows = c.with_row(docs)
    linked = c.cut(similar_classes(rows, width, similarity, text_col))
    every = linked.union(linked.select("root", "root").distinct()).toDF("_tmk_row", "root")
    ids = rows.select("_tmk_row", F.col(id_col).alias("id")).join(every, "_tmk_row")
    first = ids.groupBy("root").agg(F.min_by("_tmk_row", F.struct(F.col("id").isNull(), "id", "_tmk_row")).alias("_tmk_row"))
    return c.without_rows(rows, every.join(first.select("_tmk_row"), "_tmk_row", "left_anti"))
