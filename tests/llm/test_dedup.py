import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

import pytest

from tamarack.llm import _common, decontam, exact_dedup, mixing, quality, simhash
from tamarack.llm._common import with_row
from tamarack.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def shingles(text, width=5):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w)


def alike(texts, similarity=0.8):
    """The class of each text, by comparing all pairs of shingle sets."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_similar_documents(spark, edge_docs, no_docs, sf_dir):
    words = [f"w{i * 7919 % 1000}" for i in range(300)]
    edited = [" ".join(w for j, w in enumerate(words) if (j + k) % 101) + (" Tail" * k) for k in range(12)]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(edited)], "doc_id long, text string")
    for df in (edge_docs, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(extra)):
        rows = with_row(df)
        docs = rows.orderBy("_tmk_row").collect()
        want = Counter(alike([d.text for d in docs])).values()
        found = Counter(r.root for r in simhash.similar_classes(rows).collect())
        assert sorted(n + 1 for n in found.values()) == sorted(n for n in want if n > 1)
        kept = simhash.drop_similar(df)
        assert kept.columns == df.columns and kept.count() == len(want)
    assert simhash.drop_similar(no_docs).collect() == []


def test_similar_documents_with_a_changed_end(spark, monkeypatch):
    rng, texts = np.random.default_rng(5), []
    word = lambda n, of=1 << 40: [f"w{x}" for x in rng.integers(0, of, n)]
    for length, cut, added, of in ((100, 0, 20, 1 << 40), (100, 0, 24, 1 << 40), (300, 0, 60, 300), (300, 30, 30, 1 << 40), (24, 0, 5, 1 << 40), (10, 0, 1, 1 << 40), (500, 120, 0, 300), (100, 0, 30, 1 << 40)):
        for _ in range(15):
            w = word(length, of)
            texts += [" ".join(w), " ".join(w[: length - cut] + word(added, of))]
    for _ in range(30):  # words changed here and there, similar by 0.8 or a little more or less
        w = word(200)
        texts += [" ".join(w), " ".join("new" if k in (20, 60, 100, 150) else x for k, x in enumerate(w))]
    rows = with_row(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    order = [r.doc_id for r in rows.orderBy("_tmk_row").collect()]
    at = {r._tmk_row: r.doc_id for r in rows.collect()}
    of = alike([texts[i] for i in order])
    want = {order[i]: order[k] for i, k in enumerate(of) if i != k}
    assert len(want) >= 6 * 15 + 30
    for most in (1 << 14, 0):  # pairs, then blocks
        monkeypatch.setattr(simhash, "_PAIRS", most)
        got = {at[r._tmk_row]: at[r.root] for r in simhash.similar_classes(rows).collect()}
        assert got == want


def check_near(df, spark):
    docs = df.select("doc_id", "text").toPandas()
    fps = [fingerprint(t) for t in docs.text.where(docs.text.notna(), None)]
    of = classes(fps)
    least = pd.Series([np.inf if pd.isna(i) else i for i in docs.doc_id]).groupby(of).transform("min")
    want = Counter((f"{f:016x}", None if np.isinf(m) else int(m)) for f, m in zip(fps, least, strict=True))
    got = Counter((r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want
    assert simhash.drop_near_duplicates(df).count() == len(set(of))


def test_near_duplicates_of_the_documents(spark, sf_dir):
    check_near(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)


def test_near_duplicates_of_edge_cases(edge_docs, no_docs, spark):
    check_near(edge_docs, spark)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns


def test_linking_in_a_dense_ball_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 150:
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, 8)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    of = classes(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for most in (256, 0):  # all pairs across parts, then edges by shared neighbours
        monkeypatch.setattr(simhash, "_PARTED", most)
        got = {r.fp % (1 << 64): r.root for r in simhash.link_classes(df).collect()}
        groups = {}
        for x, k in zip(fps, of, strict=True):
            groups.setdefault(k, []).append(x)
        for members in groups.values():
            if len(members) > 1:
                assert len({got[m] for m in members}) == 1
        assert len(set(got.values())) == sum(len(m) > 1 for m in groups.values())


def test_masks_cover_every_small_difference():
    rng = np.random.default_rng(0)
    masks = simhash.ring_masks(4)
    for _ in range(4000):
        x = 0
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x |= 1 << int(b)
        assert any(x & m == 0 for m in masks)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (101, 100)], "a long, b long")
    got = {r.id: r.root for r in components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(e.limit(0)).collect() == []


def brute_exact(docs):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", d.text or "") for d in docs]
    best = {}
    for i, (b, d) in enumerate(zip(bare, docs, strict=True)):
        k = (-len(d.text or ""), d.doc_id is None, d.doc_id or 0, i)
        best[b] = min(best.get(b, k), k)
    n = Counter(bare)
    return Counter((d.doc_id, docs[best[b][3]].doc_id, n[b], best[b][3] == i) for i, (b, d) in enumerate(zip(bare, docs, strict=True)))


def test_exact_duplicates(spark, edge_docs, no_docs, sf_dir):
    for df in (edge_docs, edge_docs.repartition(40), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = with_row(df)
        docs = df.select("doc_id", "text").collect()
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect())
        assert got == brute_exact(docs)
        kept = exact_dedup.drop_exact_duplicates(df)
        assert kept.columns == df.columns and kept.count() == sum(n for k, n in got.items() if k[3])
    assert exact_dedup.exact_duplicates(with_row(no_docs)).collect() == []


def test_runs_are_sorted_and_merged_by_digest(spark):
    runs = spark.createDataFrame([(0, b"a", 1, 1, (1, 1), 1)], "run int, sha binary, bytes int, check long, best struct<a:int,b:int>, n long")
    plan = exact_dedup.merged(runs)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Sort [run#" in physical and "sha#" in physical[physical.index("Sort [run#") :].split("\n")[0] and physical.count("Exchange") == 1


@pytest.mark.parametrize("drop", ["exact", "near", "similar", "leaks", "quality", "mix"])
def test_rows_keep_their_identity_when_files_are_split_anew(spark, sf_dir, tmp_path, monkeypatch, drop):
    """Every cut is followed by another number of splits, as where executors come or go."""
    path = f"{tmp_path}/docs"
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    src.union(src.filter("doc_id % 3 = 0")).write.parquet(path)
    docs = spark.read.parquet(path)
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ways = {"exact": exact_dedup.drop_exact_duplicates, "near": simhash.drop_near_duplicates, "similar": simhash.drop_similar, "leaks": lambda d: decontam.drop_leaks(d, bench), "quality": lambda d: quality.keep_quality(d, labels), "mix": mixing.apply_mix}
    run = lambda: Counter(hash(tuple(r)) for r in ways[drop](docs).collect())
    want = run()
    cut, n = _common.cut, [3]

    def moving(df):
        out = cut(df)
        n[0] = 14 - n[0]
        spark.conf.set("spark.sql.files.minPartitionNum", n[0])
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        return out

    for module in (_common, exact_dedup.c, simhash.c):
        monkeypatch.setattr(module, "cut", moving)
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_columns_that_are_named_like_the_identity_stay(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8)], "doc_id long, text string, _tmk_row int, _TMK_ROW_ int")
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns and out.collect() == [df.first()]


def test_links_grow_in_proportion_to_a_family(spark, monkeypatch):
    words, rng = [f"w{i}" for i in range(120)], np.random.default_rng(2)
    seen = []
    monkeypatch.setattr(simhash, "components", lambda e: seen.append(e.distinct().count()) or components(e))
    for n in (400, 1600):
        texts = [" ".join(w if k != at else f"x{i}" for k, w in enumerate(words)) for i, at in enumerate(rng.integers(0, 120, n).tolist())]
        rows = with_row(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        found = simhash.similar_classes(rows).collect()
        assert len(found) == n - 1 and len({r.root for r in found}) == 1
        assert max(seen) <= 4 * n
        seen.clear()


def test_exact_duplicates_stay_apart_where_only_the_digest_agrees(spark, monkeypatch):
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("ab" * 32))
    df = with_row(spark.createDataFrame([(1, "a"), (2, "b b"), (3, "bb")], "doc_id long, text string"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2)}


def test_a_file_that_is_read_twice_has_copies(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [(1, "one two three four five six", "en", "a"), (2, "another text that stands alone here", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path, path)
    assert docs.count() == 4
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [1, 2]
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == [1, 2]
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, bench).collect()) == [2, 2]
    taken = Counter(r.doc_id for r in mixing.apply_mix(docs).collect())
    assert abs(sum(taken.values()) - 6) <= 1
