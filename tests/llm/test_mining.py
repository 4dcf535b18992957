import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarack.llm import capfilter, collocations, hardneg, queries


def brute_collocations(docs, least, depth=5, first=2000, subsumed=100):
    """From the definition, phrase by phrase. docs: (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows, longer = [], Counter()
        for q, b in candidates.items():
            for p in {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1)} - {q}:
                longer[p] = max(longer[p], b)
        for p, a in candidates.items():
            if 100 * longer[p] >= subsumed * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:first], 1)}
    return out


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("shard", [1 << 22, 40])
def test_collocations(spark, edge_docs, no_docs, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "_PIECE", shard * 8)
    rng = np.random.default_rng(7)
    vocabulary = ["a", "b", "É", "éa", "Of", "of", " x", "-", "new york", "new york city", "b a b a", "x\ty", "c. d", "e\x0bf", "\U0001f600", "a a a a a a"]
    texts = [(rng.choice(["en", "de", None]), " ".join(rng.choice(vocabulary, rng.integers(0, 40))) + rng.choice(["", " ", "\n", ".\r\n"])) for _ in range(150)]
    texts += [("en", None), ("en", ""), (None, " \t"), ("fr", "only words here"), ("und", "a b")]
    df = spark.createDataFrame([(str(a) if a else None, b) for a, b in texts], "lang string, text string").repartition(5)
    for least, depth, subsumed in ((5, 5, 100), (2, 3, 100), (8, 5, 80)):
        got = found(collocations.collocations(df, least=least, depth=depth, subsumed=subsumed))
        assert got and got == brute_collocations(texts, least, depth, 2000, subsumed)
    assert found(collocations.collocations(df, least=3, first=4)) == brute_collocations(texts, 3, first=4)
    docs = edge_docs.select("lang", "text").collect()
    assert found(collocations.collocations(edge_docs, least=2)) == brute_collocations(map(tuple, docs), 2)
    assert collocations.collocations(no_docs).collect() == [] and found(collocations.collocations(df.filter("false"))) == set()


def test_scores_beyond_64_bits(spark):
    assert spark.sql("SELECT cast(1000 as decimal(38,0)) * cast(90000000000 as decimal(38,0)) * cast(90000000000001 as decimal(38,0)) div (cast(90000000000 as decimal(38,0)) * cast(90000000007 as decimal(38,0))) AS s").first().s == 1000 * 90000000000 * 90000000000001 // (90000000000 * 90000000007)


def shuffled(spark):
    """Rows written by shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_of_phrases(spark, monkeypatch):
    """A shard's phrases leave in as many rows as there are ranges of hashes, however many become frequent."""
    monkeypatch.setattr(collocations, "_FEW", 2, raising=False)
    rng = np.random.default_rng(3)
    texts = [("en", " ".join(f"w{x}" for x in rng.integers(0, 40, 1000))) for _ in range(24)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    before = shuffled(spark)
    _, counts = collocations.phrase_counts(docs, least=4, depth=3)
    rows = shuffled(spark) - before
    pairs = Counter(p for _, t in texts for w in [t.split()] for k in (1, 2, 3) for p in zip(*(w[i:] for i in range(k)), strict=False))
    assert {tuple(r.phrase.split()): r.f for r in counts.collect()} == {p: n for p, n in pairs.items() if n >= 4}
    assert 1600 < sum(n >= 4 for n in pairs.values()) and rows < 2 * sum(n >= 4 for n in pairs.values())  # the bitmaps take each frequent hash once


def test_packed_counts():
    rng = np.random.default_rng(5)
    words = pa.array([f"w{x}" for x in rng.integers(0, 60, 5000)])
    half = [words[:2500], words[2500:]]
    autos = [collocations.Automaton(w, np.zeros(len(w), np.int64), ["en"], np.arange(len(w)) == 0, [], 3) for w in half]
    hashes, phrases = Counter(), Counter()
    for a, w in zip(autos, (x.to_pylist() for x in half), strict=True):
        for k in (2, 3):
            for h, n in zip(a.hash[k - 1].tolist(), a.count[k - 1].tolist(), strict=True):
                hashes[h >> 20 << 20] += n
            phrases.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    sent = pa.Table.from_batches([b for a in autos for b in collocations._emit_hashes(2, 12)(a)])
    listed = pa.Table.from_batches([b for a in autos for b in collocations._emit_phrases(3)(a)])
    assert len(sent) <= 2 << 12 and len(listed) == 16
    rows = lambda t, x: t.take(np.flatnonzero(np.array(t["range"]) == x))
    often = [h % (1 << 64) for x in range(1 << 12) if len(t := rows(sent, x)) for h in collocations._often(3, 12)((pa.scalar(x, pa.int32()),), t)["hash"].to_pylist()]
    assert len(often) == len(set(often)) and set(often) == {h for h, n in hashes.items() if n >= 3}
    added = pa.concat_tables([collocations._added(3)((pa.scalar("en"), pa.scalar(x)), rows(listed, x)) for x in range(8)]).to_pylist()
    assert {r["phrase"]: r["f"] for r in added} == {p: n for p, n in phrases.items() if n >= 3} and len(added) == len({r["phrase"] for r in added})
    assert all(r["words"] == len(r["phrase"].split()) and r["lang"] == "en" for r in added)


def test_automaton():
    words = pa.array("a b c a b c b c a b".split())
    text = words.to_pylist()
    a = collocations.Automaton(words, np.zeros(10, np.int64), ["en"], np.array([True, *[False] * 9]), [], 4)
    named = [[text[i] for i in a.word.tolist()]]
    for k in (2, 3, 4):
        langs, phrases = a.phrases(k, np.arange(len(a.count[k - 1])))
        named.append(phrases.to_pylist())
        assert dict(zip(named[-1], a.count[k - 1].tolist(), strict=True)) == Counter(" ".join(text[i : i + k]) for i in range(11 - k)) and set(langs.to_pylist()) == {"en"}
        words_of = [p.split() for p in named[-1]]
        assert [named[-2][i] for i in a.parent[k - 1]] == [" ".join(w[:-1]) for w in words_of] and [named[-2][i] for i in a.link[k - 1]] == [" ".join(w[1:]) for w in words_of]


def test_automaton_states():
    words = pa.array("a b c a b c b c a b".split())
    a = collocations.Automaton(words, np.zeros(10, np.int64), ["en"], np.array([True, *[False] * 9]), [], 3)
    got = {}
    for k, which, shortest in a.states():
        _, phrases = a.phrases(k, which)
        for p, s, n in zip(phrases.to_pylist(), shortest.tolist(), a.count[k - 1][which].tolist(), strict=True):
            for j in range(s, k + 1):
                got[" ".join(p.split()[-j:])] = n
    text = words.to_pylist()
    assert got == Counter(" ".join(text[i : i + k]) for k in (2, 3) for i in range(11 - k))
    assert sum(len(which) for _, which, _ in a.states()) < len(got)


def brute_negatives(rows, every=50):
    """rows: (id, label, vector of integers)."""
    out = set()
    score = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    for i, (a, label, v) in enumerate(rows):
        if a % every:
            continue
        others = sorted(((-score(v, w), b, la) for j, (b, la, w) in enumerate(rows) if j != i and len(w) == len(v)))
        for s, p, _ in [o for o in others if o[2] == label][:5]:
            near = [(o[0], o[1]) for o in others if o[2] != label and 50 * -s <= 100 * -o[0] <= 95 * -s]
            out |= {(a, p, r, b, -s, -t) for r, (t, b) in enumerate(near[:3], 1)}
    return out


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=6) * 40 + 15).astype(int).tolist()) for i in range(400)]
    rows += [(i, i % 3, [30] * 6) for i in range(400, 430)]  # ties
    rows += [(500, 1, [5, -9, 1]), (501, 1, [4, 4, 4]), (502, 2, [9, -2, 3]), (550, 2, [0] * 6), (600, 7, [10] * 6)]
    odd = [(None, 1, [1] * 6), (650, None, [1] * 6), (700, 1, None), (750, 1, [1, None, 1, 1, 1, 1]), (800, 1, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, z array<long>").withColumns({"anchor": F.col("vec_id") % 50 == 0, "id": F.lit(1), "_tmk_row": F.lit(2), "rank": F.lit(3), "score": F.lit(4)})
    want = brute_negatives(rows)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for size in (1 << 25, 2000):  # anchors broadcast, joined
        got = hardneg.hard_negatives(df.repartition(3), broadcast_bytes=size)
        assert got.columns == columns and {tuple(r) for r in got.collect()} == want
    monkeypatch.setattr(hardneg, "ROWS", 37)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    monkeypatch.setattr(hardneg, "SAMPLE", 20)
    monkeypatch.setattr(hardneg, "CENTRES", 4)
    got = [tuple(r) for r in hardneg.hard_negatives(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert hardneg.hard_negatives(df.filter("false")).collect() == []
    # repeated rows are rows: an anchor finds its copy, and gives its rows twice
    twice = [(0, 1, [10, 0]), (0, 1, [10, 0]), (3, 2, [9, 0])]
    got = hardneg.hard_negatives(spark.createDataFrame([(*r, r[0] == 0) for r in twice], "vec_id long, label int, z array<long>, anchor boolean")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 3, 100, 90)] * 2


def test_bounds_hold():
    rng = np.random.default_rng(2)
    z = rng.integers(-100, 100, (300, 7)).astype(np.int64)
    q = rng.integers(-100, 100, (20, 7)).astype(np.int64)
    for book in (hardneg.fitted(z[:50]), np.zeros((4, 1, 2))):
        codes, rest = hardneg.coded(z, book)
        low, high = hardneg.bounded(q, codes, rest, book)
        assert (low <= z @ q.T).all() and (z @ q.T <= high).all()
    big = np.full((1, 2), 1 << 31, np.int64)
    assert hardneg.exact(big, np.array([[1 << 30, 1]]), np.array([0]), np.array([0])).tolist() == [(1 << 61) + (1 << 31)]
    with pytest.raises(OverflowError):
        hardneg.exact(big, big * 4, np.array([0]), np.array([0]))


def brute_links(rows, threshold=0.9):
    """(id, n_links, component_id) of each row (id, vector)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (a, _) in enumerate(rows):
        groups[find(i)].append(a)
    least = {g: min((a for a in ids if a is not None), default=None) for g, ids in groups.items()}
    return sorted(((a, n[i], least[find(i)]) for i, (a, _) in enumerate(rows)), key=repr)


def test_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for family in range(25):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((at, (centre + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.33])).astype(np.float32).tolist()))
            at += 1
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, [2 * x for x in rows[3][1]]), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [1.0] * 23 + [None]), (3004, [float("nan")] * 24), (3005, [float("inf")] + [1.0] * 23), (3006, [1.0, 2.0]), (3007, [1.0, 2.1]), (3008, [7.0]), (3009, [1e-30]), (3010, [-1.0]), (None, [5.0, -1.0]), (None, [5.0, -1.0]), (3011, [3e38] * 24), (3012, [1e38] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumns({n: F.lit(7) for n in ("id", "v", "h", "rep", "_tmk_row", "n_links", "row")})
    for block in (4096, 16):
        monkeypatch.setattr(capfilter, "BLOCK", block)
        got = capfilter.links(df)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        rows_got = got.collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in rows_got), key=repr) == brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
        assert all(r.kept == (r.vec_id == r.component_id) for r in rows_got)
    assert capfilter.links(df.filter("false")).collect() == []


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_pairs_at_the_threshold_share_a_filter(dim):
    rng = np.random.default_rng(8)
    a, b = capfilter._units(rng, 1000, dim), capfilter._units(rng, 1000, dim)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.sqrt((b * b).sum(axis=1))[:, None]
    for count in (10, 5000, 1_000_000):
        codes = capfilter.codes_for(count, dim, 0.9)
        both = [np.unique(np.stack(capfilter.decode(codes, x), axis=1), axis=0) for x in (a, b)]
        pairs, n = np.unique(np.concatenate(both), axis=0, return_counts=True)
        assert len(np.unique(pairs[n == 2, 0])) >= 995
        # a filter is a direction, and decoding finds all that are near enough
        rotation, books, height = codes[0]
        if len(books) == 1:
            scores = (a @ rotation) @ books[0].T
        else:
            half = books[0].shape[1]
            scores = ((a @ rotation)[:, :half] @ books[0].T)[:, :, None] + ((a @ rotation)[:, half:] @ books[1].T)[:, None, :] if len(books) == 2 else None
        if scores is not None:
            assert len(capfilter.caps(codes[0], a)[0]) == (scores.reshape(len(a), -1) / np.sqrt(len(books)) >= height).sum()


def test_queries_of_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16)) / 4
    rows = [(i, int(i % 10), (base[i % 60] + rng.normal(size=16) * 0.03).astype(np.float32).tolist()) for i in range(200)] + [(200, None, [1.0] * 16), (201, 1, None), (250, 1, [float("nan")] * 16)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = [(i, (la + 1) % 10 if i % 7 == 0 else la, [int(np.floor(256 * float(x))) for x in v]) for i, la, v in rows if la is not None and v is not None and all(np.isfinite(v))]
    assert {tuple(r) for r in queries.op12_hard_negatives(spark, str(tmp_path)).collect()} == brute_negatives(own)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in queries.op13_cap_filters(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_links([(i, v) for i, _, v in rows])
