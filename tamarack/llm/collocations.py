"""Phrase collocations by suffix automata of bounded depth.

A task builds, for each shard of its texts, a generalised suffix automaton over words that is cut
at ``depth`` words, in arrays: the phrases of k words are the pairs of two overlapping phrases of
k - 1 words, the one a phrase extends (its parent) and the one it ends with (its suffix link), and
as many end positions as it has occurrences. A phrase with as many as its suffix link has the same
end positions, so both are one state. States are enumerated as phrases, and their counts added up
over all shards.

Most phrases are rare everywhere, so three shorter passes come first: words are counted, then hashes
of pairs of words that are frequent enough, then those of longer phrases whose pairs are. A bitmap of
the hashes that reach the least count never misses one, and a phrase is only followed where its
parts may be frequent; so what is left out can't reach the least count, and what is returned is
counted by the phrases themselves.

What a shard has counted goes out in one row for each range of hashes, not one for each phrase: hashes
are sorted, so their differences are small, and phrases are joined to one string. The ranges get
narrower as the texts grow, so the rows of one range fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm import _common as c

#: Words of a shard, about, and bytes of texts that are cut into words at once, about.
SHARD, _PIECE = 1 << 20, 2 << 20
#: Bits of a bitmap for each frequent hash, and the logarithms of its least and largest size; beyond that it only lets more pass.
_BITS, _SMALL, _LARGE = 128, 16, 30
#: Words of all texts for each range of hashes, about, and the logarithms of the least and largest number of ranges.
_RANGE, _FEW, _MANY = 1 << 21, 9, 24
_WORD, _BLANK, _BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row, first): the lower-cased words of texts, the row of each, whether it begins a piece."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    kinds = _KIND[data]
    inside = kinds == _WORD
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    cuts = np.cumsum(kinds == _BREAK, dtype=np.int32)[start]
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.ones(len(start), bool)
    first[1:] = (cuts[1:] != cuts[:-1]) | (row[1:] != row[:-1])
    at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]])), row, first


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B185EBCA87) + (b ^ (b >> np.uint64(29)))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


def _may_be(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - int(np.log2(8 * len(bits))))).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


class Automaton:
    """Of one shard: for level k (from 1), count, hash, parent, link, an occurrence and whether it may be frequent of each phrase of k words."""

    def __init__(self, words: pa.Array, langs: np.ndarray, names: list[str], first: np.ndarray, bitmaps: list[np.ndarray], depth: int) -> None:
        """langs: the place in names of each word's language. bitmaps: of levels 1, 2 and so on; phrases that aren't in theirs aren't followed."""
        coded = words.dictionary_encode()
        self.words, self.names = coded.dictionary, names
        self.at = coded.indices.to_numpy().astype(np.int64)
        n_words = max(1, len(self.words))
        key = langs * n_words + self.at
        dense = np.bincount(key, minlength=1)
        known = np.flatnonzero(dense)
        to = np.zeros(len(dense), np.int64)
        to[known] = np.arange(len(known))
        state = to[key]
        seeds = [xxhash.xxh64_intdigest(x) for x in names]
        text = self.words.to_pylist()
        digest = xxhash.xxh64_intdigest
        plain = np.fromiter((digest(w) for w in text), np.uint64, len(text))
        self.lang, self.word = known // n_words, known % n_words
        one = _mixed(np.array(seeds or [0], np.uint64)[self.lang], plain[self.word]) if len(known) else np.zeros(0, np.uint64)
        may = lambda k, h: _may_be(bitmaps[k - 1], h) if k <= len(bitmaps) else np.ones(len(h), bool)
        self.count, self.hash, self.parent, self.link, self.place, self.may = [dense[known]], [one], [None], [None], [None], [may(1, one)]
        self.single = single = state
        position, length = np.arange(len(state)), len(state)
        for k in range(2, depth + 1):
            ok = self.may[-1][state]
            position, state = position[ok], state[ok]
            # two phrases that start at neighbours in a piece, and overlap in all but a word
            pair = np.flatnonzero(np.diff(position) == 1) if len(position) > 1 else np.zeros(0, np.int64)
            pair = pair[~first[np.minimum(position[pair] + k - 1, length - 1)] & (position[pair] + k <= length)]
            left, right = state[pair], state[pair + 1]
            wide = max(1, len(self.hash[-1]))
            found, where, state, n = np.unique(left * wide + right, return_index=True, return_inverse=True, return_counts=True)
            position = position[pair]
            self.parent.append(found // wide)
            self.link.append(found % wide)
            self.count.append(n)
            self.place.append(position[where])
            self.hash.append(_mixed(self.hash[-1][self.parent[-1]], one[single[position[where] + k - 1]]) if len(n) else np.zeros(0, np.uint64))
            self.may.append(may(k, self.hash[-1]))

    def phrases(self, k: int, which: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(languages, phrases) of the phrases of k words at the places ``which``."""
        at = self.place[k - 1][which]
        parts = [self.words.take(pa.array(self.at[at + j])) for j in range(k)]
        langs = pa.array(self.names, pa.string()).take(pa.array(self.lang[self.single[at]] if len(at) else at))
        return langs, pc.binary_join_element_wise(*parts, " ")

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, shortest): the longest phrases of the states, of k words, and the words of the shortest one of each, from two words on.

        Of phrases that may be frequent; a longer one that isn't is no reason to leave out what it ends with.
        """
        shortest, kept = [np.ones(len(self.count[0]), np.int64)], [np.ones(len(self.count[0]), bool)]
        for k in range(2, len(self.count) + 1):
            link = self.link[k - 1]
            same = self.count[k - 1] == self.count[k - 2][link]
            kept[-1][link[same & self.may[k - 1]]] = False  # one state with the longer phrase
            shortest.append(np.where(same, shortest[-1][link], k))
            kept.append(self.may[k - 1].copy())
        for k in range(2, len(self.count) + 1):
            which = np.flatnonzero(kept[k - 1])
            yield k, which, np.maximum(shortest[k - 1][which], 2)

    def enumerated(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, counts): the phrases of the states, which are the ends of a state's longest one, along the links."""
        for k, at, shortest in self.states():
            n = self.count[k - 1][at]
            yield k, at, n
            for j in range(k - 1, 1, -1):
                more = shortest <= j
                at, n, shortest = self.link[j][at[more]], n[more], shortest[more]
                yield j, at, n


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(words, langs, names, first) of shards; batches have lang and text."""
    held: list[tuple] = []
    names: dict[str, int] = {}
    size = 0

    def made():
        words, langs, first = zip(*held, strict=True)
        return pa.concat_arrays(words), np.concatenate(langs), list(names), np.concatenate(first)

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE, "right")))
            part = b.slice(at, upto - at)
            at = upto
            words, row, first = words_of(part.column(1))
            coded = pc.fill_null(part.column(0), "und").dictionary_encode()
            code = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
            held.append((words, code[coded.indices.to_numpy()][row], first))
            size += len(words)
            if size >= SHARD:
                yield made()
                held, size = [], 0
                names.clear()
    if size:
        yield made()


def _kernel(emit, bitmaps, depth: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, names, first in _shards(batches):
            yield from emit(Automaton(words, langs, names, first, [x.value for x in bitmaps], depth))

    return kernel


def _emit_words(a: Automaton) -> Iterator[pa.RecordBatch]:
    langs = pa.array(a.names, pa.string()).take(pa.array(a.lang))
    yield pa.RecordBatch.from_arrays([langs, a.words.take(pa.array(a.word)), pa.array(a.count[0])], names=["lang", "phrase", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes that automata give words (lang, phrase)."""
    for b in batches:
        lang, word = (np.array([xxhash.xxh64_intdigest(x) for x in col.to_pylist()], np.uint64) for col in b.columns)
        yield pa.RecordBatch.from_arrays([pa.array(_mixed(lang, word).view(np.int64))], names=["hash"])


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, first the lowest byte of each, then the next ones: the upper ones compress to nothing if numbers are small."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows have other keys than the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    return np.flatnonzero(new)


def _emit_hashes(least: int, ranges: int):
    """Hashes of phrases of least words or more, cut to ranges + 32 bits: (range, hashes, counts), where range is the first bits."""

    def emit(a: Automaton) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.concatenate(a.hash[least - 1 :]), np.concatenate(a.count[least - 1 :])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        part = (hashes >> np.uint64(64 - ranges)).astype(np.int32)
        rest = (hashes >> np.uint64(32 - ranges)).astype(np.uint32)
        starts = _starts(part)
        step = np.diff(rest, prepend=np.uint32(0))
        step[starts] = rest[starts]
        ends = [*starts[1:].tolist(), len(hashes)]
        each = [(_planes(step[i:j]), _planes(counts[i:j])) for i, j in zip(starts.tolist(), ends, strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *(pa.array([x[i] for x in each], pa.binary()) for i in (0, 1))], names=["range", "hashes", "counts"])

    return emit


def _often(least: int, ranges: int):
    """Of the rows of one range: the hashes that are counted least times or more."""

    def kernel(key: tuple, rows: pa.Table) -> pa.Table:
        rest = np.concatenate([np.cumsum(_numbers(x), dtype=np.uint32) for x in rows["hashes"].to_pylist()])
        counts = np.concatenate([_numbers(x) for x in rows["counts"].to_pylist()])
        order = np.argsort(rest)
        rest = rest[order]
        starts = _starts(rest)
        found = rest[starts][np.add.reduceat(counts[order].astype(np.int64), starts) >= least].astype(np.uint64)
        hashes = ((np.uint64(key[0].as_py()) << np.uint64(32)) | found) << np.uint64(32 - ranges)
        return pa.table({"hash": hashes.view(np.int64)})

    return kernel


def _emit_phrases(ranges: int):
    """(lang, range, phrases, counts): the phrases of a language and a range, joined by line ends, which no word has."""

    def emit(a: Automaton) -> Iterator[pa.RecordBatch]:
        levels = [(a.hash[k - 1][at], *a.phrases(k, at), n) for k, at, n in a.enumerated()]
        if not sum(len(x[0]) for x in levels):
            return
        hashes, langs, phrases, counts = zip(*levels, strict=True)
        langs = pa.concat_arrays(langs).dictionary_encode()
        lang, part = langs.indices.to_numpy(), (np.concatenate(hashes) >> np.uint64(64 - ranges)).astype(np.int32)
        order = np.lexsort((part, lang))
        lang, part = lang[order], part[order]
        starts = _starts(lang, part)
        ends = pa.array(np.append(starts, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x.take(pa.array(order))) for x in (pa.concat_arrays(phrases), pa.array(np.concatenate(counts)))]
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[starts])), pa.array(part[starts]), pc.binary_join(lists[0], "\n"), lists[1]], names=["lang", "range", "phrases", "counts"])

    return emit


def _added(least: int):
    """Of the rows of a language and one range: the phrases that are counted least times or more."""

    def kernel(key: tuple, rows: pa.Table) -> pa.Table:
        each = pa.table({"phrase": pc.list_flatten(pc.split_pattern(rows["phrases"], "\n")), "n": pc.list_flatten(rows["counts"])})
        each = each.group_by("phrase").aggregate([("n", "sum")])
        each = each.filter(pc.greater_equal(each["n_sum"], least))
        words = pc.add(pc.count_substring(each["phrase"], " "), pa.scalar(1, pa.int32()))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(each), pa.string()), "phrase": each["phrase"], "words": words, "f": each["n_sum"]})

    return kernel


def _bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the column hash, whose size grows with the count; put together from parts of 4 KB by Spark."""
    bits = int(np.clip(np.ceil(np.log2(max(1, count) * _BITS)), _SMALL, _LARGE))
    at = F.shiftrightunsigned("hash", 64 - bits)
    parts = hashes.select(at.alias("at")).distinct().groupBy(F.shiftright("at", 15).alias("part")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).toLocalIterator()  # at most 2 ** (_LARGE - 15) parts
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, x in parts:
        out[part << 12 : (part + 1) << 12] = np.frombuffer(bytes(x), np.uint8)
    return out


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, words, f)): the words of each language, and the phrases of up to depth words that occur least times or more."""
    spark = docs.sparkSession
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    words = own.mapInArrow(_kernel(_emit_words, [], 1), "lang string, phrase string, n long")
    words = c.cut(words.groupBy("lang", "phrase").agg(F.sum("n").alias("f")))
    totals = c.cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    often = c.cut(words.filter(F.col("f") >= least))
    send = lambda hashes: spark.sparkContext.broadcast(_bitmap(hashes, hashes.count()))
    bitmaps = [send(often.select("lang", "phrase").mapInArrow(_hashed, "hash long"))]
    size = totals.agg(F.sum("n")).first()[0] or 0
    ranges = int(np.clip(np.ceil(np.log2(max(1, size / _RANGE))), _FEW, _MANY))
    for shortest, longest in ((2, 2), (3, depth)):
        if shortest <= longest <= depth:
            hashes = own.mapInArrow(_kernel(_emit_hashes(shortest, ranges), bitmaps, longest), "range int, hashes binary, counts binary")
            sent = send(c.cut(hashes.groupBy("range").applyInArrow(_often(least, ranges), "hash long")))
            bitmaps += [sent] * (longest - shortest + 1)
    listed = own.mapInArrow(_kernel(_emit_phrases(ranges), bitmaps, depth), "lang string, range int, phrases string, counts array<long>")
    phrases = listed.groupBy("lang", "range").applyInArrow(_added(least), "lang string, phrase string, words int, f long")
    return totals, c.cut(often.select("lang", "phrase", F.lit(1).alias("words"), "f").union(phrases))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, depth: int = 5, first: int = 2000, subsumed: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, a and phrase.

    Texts are lower-cased (A-Z), split at .,;:!? and line ends into pieces, and these at spaces and
    tabs into words. A phrase of 2 to depth words that occurs a times, least or more, is cut after
    each of its words; l and r are how often its parts occur, n the words of the language, and of
    floor(1000 * a * n / (l * r)) the least counts, the first of equals. A phrase is left out if a
    longer one that has it occurs ``subsumed`` percent as often or more.

    Null texts count as empty, a null language as ``und``. Whole texts of any length are read,
    repeated rows count each; an empty table gives no rows; other columns don't matter. Products
    are decimals of 38 digits, and beyond these an error.
    """
    totals, counts = phrase_counts(docs, lang_col, text_col, least, depth)
    found = counts.filter("words > 1")
    # what a phrase extends and what it ends with: its parent and its suffix link
    inner = found.filter("words > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < subsumed * F.col("f"), F.lit(True))).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    parts = c.maybe_broadcast(counts.select("lang", "phrase", "f"), 128)
    side = lambda part, f: parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    joined = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(c.maybe_broadcast(totals, 64), "lang")
    wide = lambda x: f"cast({x} as decimal(38, 0))"
    scored = joined.withColumn("score", F.expr(f"{wide('1000')} * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), "phrase"))
    return best.withColumn("rank", order).filter(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", F.col("b.score").cast("long").alias("score"))


#: op11 in DuckDB's SQL, every phrase counted.
ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0b\f\r]')) AS piece FROM d)),
k AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.f >= 100 * c.f)),
cuts AS (SELECT lang, phrase, f AS a, k AS size, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS k FROM kept),
s AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score FROM cuts c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[c.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM b QUALIFY rank <= 2000
"""
