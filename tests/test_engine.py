import json
import os
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.functions import jsonx, text
from tamarack.functions.vectors import cosine, inner_product, squared_l2
from tamarack.operators import cards, containment, index, knn, matching, models, records, sessions, spelling
from tamarack.plans import pipeline
from tamarack.sources import files
from tamarack.sources.catalog import Catalog, Index


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("0S8 NDIA", "0 s 8 ndia"),
        ("take 2000. Lic No. 10.0 mg P0-209-2505 1.5m9", "take 2000. lic no. 10.0 mg p 0 - 209 - 2505 1.5 m 9"),
        ("10.0.5 a", "10.0 . 5 a"),
        (None, ""),
        ("", ""),
        ("  Ça ÉTÉ là !", "ça été là"),
        ("I’m coughing", "i m coughing"),
    ],
)
def test_clean(spark, given, want):
    assert one(spark, given, text.clean) == want


def test_clean_twice_is_clean_once(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(text.clean(F.col("text")).alias("a"))
    assert d.filter(text.clean(F.col("a")) != F.col("a")).count() == 0


def test_text_functions(spark):
    assert one(spark, "beta-blocker o'neil", text.title_case) == "Beta-Blocker O'Neil"
    assert one(spark, "  x\t\n", text.strip) == "x"
    assert one(spark, ["a ", None, "  ", "b"], text.join_texts, "array<string>") == "a b"
    assert one(spark, 1.23456, text.fixed4, "double") == "1.2346"
    assert [one(spark, v, text.tri_state, "boolean") for v in (True, False, None)] == ["true", "false", "null"]
    assert one(spark, "/a/b.txt", text.basename) == "b.txt"
    assert one(spark, "x", lambda c: text.join_sources(c, F.lit(""), F.lit(None), F.lit("y"))) == "x y"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    r = df.select(squared_l2(F.col("a"), F.col("b")), inner_product(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (8.0, 11.0, pytest.approx(11 / (5**0.5 * 5)))


@pytest.mark.parametrize(("given", "ok"), [('blah {"x": {"y":1}} tail } z', None), ('Sure: {"x": {"y":1}} done', '{"x": {"y":1}}'), ("} {", None), ("none", None), ("{'a': 1}", None), ('{"a":1} {"b":2}', None), ("", None)])
def test_object_extraction(spark, given, ok):
    r = one(spark, given, jsonx.extract_object)
    assert r.parsed == ok and (r.error is None) == (ok is not None) and (r.raw_text is None) == (ok is not None)


@pytest.mark.parametrize(("given", "want"), [('{"response":"a","text":"b"}', "a"), ('{"text":"b"}', "b"), ('{"output":"c"}', "c"), ('{"results":[{"content":"d"}]}', "d"), ('{"other":1}', '{"other":1}'), ("plain", "plain")])
def test_reply(spark, given, want):
    assert one(spark, given, jsonx.reply_text) == want
    assert json.loads(models.reply_of(given)) == json.loads(want) if want.startswith("{") else models.reply_of(given) == want


def corpus(spark):
    rows = [(i, "a" if i < 3 else "b", [float(i % 4), 0.0]) for i in range(7)]
    return spark.createDataFrame(rows, "ordinal long, kb string, embedding array<float>")


def test_knn_ties_and_short_indexes(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 0.0])], "query_id long, query array<float>")
    got = [(r.query_id, r.kb, r["rank"], r.ordinal) for r in knn.knn(q, corpus(spark), 5, by=["kb"]).orderBy("query_id", "kb", "rank").collect()]
    assert got[:3] == [(1, "a", 1, 0), (1, "a", 2, 1), (1, "a", 3, 2)]
    assert [g[3] for g in got if g[:2] == (2, "b")] == [3, 6, 5, 4]
    assert knn.knn(q, corpus(spark), 3).count() == 6
    with pytest.raises(ValueError):
        knn.search_index(q, corpus(spark), "c", ["a", "b"])
    with pytest.raises(ValueError):
        knn.knn(q, corpus(spark), 1, "manhattan")


def test_knn_is_the_same_however_it_is_split(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    c = e.select(F.col("vec_id").alias("ordinal"), "embedding")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(knn.knn(q, c.coalesce(1), 4))
    assert rows(knn.knn(q, c.repartition(9), 4)) == want
    joined = knn.knn(q.repartition(5), c.repartition(3), 4, broadcast_bytes=500)
    assert rows(joined) == want
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text(joined) and "NestedLoop" not in text(joined)
    plan = text(knn.knn(q, c, 4))
    assert "WindowGroupLimit" in plan and "MapInArrow" in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_many_queries_run_once_and_not_through_the_driver(spark):
    ran, n = spark.sparkContext.accumulator(0), 17_000

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    q = spark.range(n).select(F.col("id").alias("query_id"), F.array((F.col("id") % 97).cast("float"), F.lit(0.0).cast("float")).alias("query"))
    q = q.mapInArrow(seen, q.schema)
    corpus = spark.range(200).select(F.col("id").alias("ordinal"), F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    for size in (1 << 20, 50_000):  # broadcast, joined
        asked = knn.asked(q)
        before = ran.value
        got = knn.knn(asked, corpus, 1, broadcast_bytes=size).agg(F.count(F.lit(1)), F.count_if(F.col("query_id") % 97 == F.col("ordinal")), F.max("score")).first()
        assert tuple(got) == (n, n, 0.0) and knn.knn(asked, corpus, 2).count() == 2 * n and ran.value == before
    assert ran.value == 2 * n


def test_knn_of_odd_vectors(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (0, None)], "ordinal long, embedding array<double>")
    q = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None)], "query_id string, query array<double>")
    got = {(r.query_id, r["rank"]): (r.ordinal, r.score) for r in knn.knn(q, c, 4).collect()}
    assert [got["a", i] for i in (1, 2, 3, 4)] == [(1, 0.0), (5, 4.0), (0, None), (2, None)]
    assert [got["b", i] for i in (1, 2, 3, 4)] == [(0, None), (1, None), (2, None), (3, None)]
    assert knn.knn(q.limit(0), c, 4).collect() == [] and knn.knn(q, c.limit(0), 4).collect() == []


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index(spark, sf_dir, tmp_path, metric):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = e.select(F.col("vec_id").alias("ordinal"), "embedding")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    built = index.VectorIndex.build(c, str(tmp_path / "i"), metric)
    opened = index.VectorIndex.open(spark, str(tmp_path / "i"), 64)
    assert (opened.dim, opened.count, opened.metric, sorted(opened.recall.items())) == (64, c.count(), metric, sorted(built.recall.items()))
    exact = rows(knn.knn(q, c, 5, metric))
    assert rows(opened.search_exact(q, 5)) == exact
    found = rows(opened.search(q, 5))
    pairs = lambda hits: {(h[0], h[2]) for h in hits}
    assert len(pairs(found) & pairs(exact)) >= 0.9 * len(exact) and {(h[0], h[2], h[3]) for h in exact} >= {(h[0], h[2], h[3]) for h in found if (h[0], h[2]) in pairs(exact)}
    assert rows(opened.search(q, 5, probe=10**6)) == exact
    with pytest.raises(ValueError, match="64 dimensions"):
        index.VectorIndex.open(spark, str(tmp_path / "i"), 32)
    with pytest.raises(Exception, match="2 dimensions, not 64"):
        opened.search(q.withColumn("query", F.array(F.lit(1.0), F.lit(2.0)))).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.VectorIndex.open(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="dimensions, not 64"):
        index.VectorIndex.build(c.union(spark.createDataFrame([(-1, [1.0])], "ordinal long, embedding array<float>")), str(tmp_path / "bad"), metric)


def test_an_index_skips_cells_far_away(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) + 100 * (i % 8)).tolist()) for i in range(800)]
    c = spark.createDataFrame(rows, "ordinal long, embedding array<float>")
    opened = index.VectorIndex.build(c, str(tmp_path / "i"), cells=8)
    q = c.filter("ordinal < 40").select(F.col("ordinal").alias("query_id"), F.col("embedding").alias("query"))
    sent = opened.visits(q, partial(index.needed, centres=opened.centres, radius=opened.radius, n=opened.n, k=5)).count()
    assert sent <= 2 * 40 and sorted(map(tuple, opened.search_exact(q, 5).collect())) == sorted(map(tuple, knn.knn(q, c, 5).collect()))


def test_an_index_of_many_cells(spark, tmp_path):
    from tamarack.functions import kmeans

    rng = np.random.default_rng(4)
    c = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(2000, 4)).tolist())], "ordinal long, embedding array<float>").coalesce(1)
    opened = index.VectorIndex.build(c, str(tmp_path / "i"), cells=600)
    assert len(opened.n) == 600 and opened.n.sum() == 2000 == opened.vectors.count()
    q = c.filter("ordinal % 100 = 0").select(F.col("ordinal").alias("query_id"), F.col("embedding").alias("query"))
    assert sorted(map(tuple, opened.search_exact(q, 5).collect())) == sorted(map(tuple, knn.knn(q, c, 5).collect()))
    m = rng.normal(size=(1000, 4))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(kmeans, "_PRODUCTS", 7000)
        assert (kmeans.nearest_centres(m, opened.centres) == np.argmin(((m[:, None] - opened.centres) ** 2).sum(axis=2), axis=1)).all()
        assert kmeans.nearest_centres(m[:0], opened.centres).shape == (0,)


def test_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": 1, "v": 1}\n\n{"name": "x"}\n{"id": 2}\n{"id": 1, "v": 3}\n', encoding="utf-8")
    got = {r.key: (r.ordinal, r.first_line, r.rec) for r in files.read_jsonl(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got == {"1": (0, 0, '{"id": 1, "v": 3}'), "line_2": (1, 2, '{"name": "x"}'), "2": (2, 3, '{"id": 2}')}
    assert {r.key for r in files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "name").collect()} == {"1", "x", "2"}
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": 2} trailing\n')
    with pytest.raises(Exception, match="not JSON, line 1"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"))


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 3 else "" for i in range(200)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 150)
    try:
        got = {r.line_no: r.value for r in files.numbered_lines(spark, str(tmp_path / "a.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(lines))


def test_upsert(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], "key string, line_no long, value long")
    got = {(r.key, r.ordinal, r.value) for r in records.with_ordinals(records.upsert(df)).collect()}
    assert got == {("a", 0, 3), ("b", 1, 2)}


def test_spelling(spark):
    assert spelling.osa("ca", "abc") == 3 and spelling.osa("ab", "ba") == 1 and spelling.osa("", "xy") == 2
    d = spark.createDataFrame([("cough", 50), ("tough", 90), ("vitamin", 10), ("the", 100)], "term string, count bigint")
    w = spark.createDataFrame([(x,) for x in ("cuogh", "cough", "vitamni", "xyzzy", "teh", "rough", "vitaminnn")], "token string")
    got = {r.token: (r.term, r.dist) for r in spelling.closest(w, d).collect()}
    assert got == {"cuogh": ("cough", 1), "cough": ("cough", 0), "vitamni": ("vitamin", 1), "teh": ("the", 1), "rough": ("tough", 1), "vitaminnn": ("vitamin", 2)}
    t = spark.createDataFrame([(1, "Teh 12.5 vitamni cuogh!"), (2, None), (3, "")], "id long, text string")
    assert {r.id: r.normalized for r in spelling.normalize(t, d).collect()} == {1: "the 12.5 vitamin cough", 2: "", 3: ""}


def test_deletion_join_finds_what_all_pairs_do(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(text.tokens(text.clean(F.col("text")))).alias("w")).distinct().limit(150).collect()
    ws = [r.w for r in words]
    d = spark.createDataFrame([(w, i) for i, w in enumerate(ws[:100])], "term string, count bigint")
    q = spark.createDataFrame([(w,) for w in ws[50:]], "token string")
    want = {}
    for w in ws[50:]:
        best = min((spelling.osa(w, t), -i, t) for i, t in enumerate(ws[:100]))
        if best[0] <= 2:
            want[w] = (best[2], best[0])
    assert {r.token: (r.term, r.dist) for r in spelling.closest(q, d).collect()} == want


def test_verdict_cases(spark):
    requests = spark.createDataFrame([(i, "" if i == 1 else "label") for i in range(1, 8)], "query_id long, ocr_text string")
    conditions = spark.createDataFrame([(i, 1, "cold flu", ["COUGH", "", "fever"]) for i in (1, 3, 4, 5, 6, 7)], "query_id long, rank int, disease string, symptoms array<string>")
    candidates = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (4, 1, "blocker-a"), (4, 2, "b"), (5, 1, None), (5, 2, ""), (6, 1, "x"), (6, 2, "y"), (7, 2, "n2"), (7, 1, "n1")], "query_id long, rank int, drug_name string")
    details = spark.createDataFrame([(4, 1, "for Coughing and fever"), (4, 2, "fever"), (6, 1, "headache"), (6, 2, None), (1, 1, "cough")], "query_id long, rank int, indications string")
    got = {r.query_id: (r.is_mismatch, r.explanation) for r in matching.verdicts(requests, conditions, candidates, details).collect()}
    assert [got[i][0] for i in range(1, 8)] == [None, None, None, False, None, True, True]
    assert "'Blocker-A'" in got[4][1] and "'cough'" in got[4][1]
    assert "'x, y'" in got[6][1] and "'Cold Flu'" in got[6][1] and "'n1, n2'" in got[7][1]


def test_contains(spark):
    t = spark.createDataFrame([(1, "Coughing badly"), (2, "fine"), (3, None)], "id long, text string")
    p = spark.createDataFrame([("COUGH",), ("",), (None,)], "phrase string")
    assert [r.id for r in matching.containing(t, p).collect()] == [1]


def test_context_and_cards(spark):
    r = spark.createDataFrame([(1, "u", "o", '{"error": "e", "raw_text": "r"}'), (2, "v", "", "fine")], "query_id long, user_text string, ocr_text string, llm_output string")
    h = spark.createDataFrame([(1, "a", 2, "k2", 0.5, '{"drug_name": "d", "other": 1}'), (1, "a", 1, "k1", 0.25, '{"chunk": {"disease": "c", "symptoms": ["s"]}}')], "query_id long, source string, rank int, key string, score double, rec string").withColumn("obj", F.col("key"))
    got = {x.query_id: x.context for x in cards.retrieval_context(r, ["a", "b"], h).collect()}
    assert got[1] == "\n-- Retrieved from A --\n* Result: k1 (Score: 0.2500)\n* Result: k2 (Score: 0.5000)\n\n-- Retrieved from B --\nNo results found.\n"
    made = {x.query_id: x for x in cards.summary_cards(r, h).withColumn("text", cards.report(F.col("card"))).collect()}
    assert [(i.key, i.preview) for i in made[1].card.retrieved["a"]] == [("k1", '{"disease":"c","symptoms":"[\\"s\\"]"}'), ("k2", '{"drug_name":"d"}')]
    assert "OCR: o" in made[1].text and "Error: e\nRaw Text: r" in made[1].text and "OCR:" not in made[2].text and made[2].card.retrieved == {}


def test_prompt_slots_are_not_searched_in_values(spark):
    got = one(spark, "{ocr_text}", lambda v: cards.analysis_prompt(v, F.lit(""), F.lit("U"), F.lit("O")))
    assert "{ocr_text}" in got and cards.NO_IMAGE in got


def test_sessions(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, None), (2, 2, None)], "s long, seq long, id string")
    assert sorted((r.s, r.seq) for r in sessions.consecutive(c, "s", ["seq"], "id").collect()) == [(1, 1), (1, 3), (1, 4), (2, 1), (2, 2)]
    z = spark.createDataFrame([([[1.9, 2.0], [3.0], [4.0]], ["x", "y"])], "b array<array<double>>, t array<string>")
    assert [(p.box, p.text) for p in z.select(sessions.zip_shorter(sessions.int_polygon(F.col("b")), F.col("t")).alias("z")).first().z] == [([1, 2], "x"), ([3], "y")]
    guard = spark.createDataFrame([(0, "", False), (0, "  ", False), (None, None, None), (1, "", False), (0, None, True)], "n int, t string, i boolean")
    assert [r[0] for r in guard.select(sessions.has_input(F.col("n"), F.col("t"), F.col("i"))).collect()] == [False, True, False, True, True]


def test_generation_falls_back(spark):
    calls = []

    def rest(prompt, model, options=None):
        raise models.GenerationError("down")

    ask = models.generator("m", rest=rest, cli=lambda p, m: f"{m}:{p}")()
    assert ask(["hi", None]) == [{"text": "m:hi", "error": None}, {"text": "m:", "error": None}]

    def none(p, m):
        raise models.GenerationError("no command")

    assert models.generator(rest=rest, cli=none)()(["x"])[0] == {"text": None, "error": "no command"} and not calls
    with pytest.raises(models.GenerationError):
        models.rest_generate("p", "m", url="http://127.0.0.1:9/none", timeout=1)
    with pytest.raises(models.GenerationError):
        models.cli_generate("p", "m", command="no-such-command")
    assert models.cli_generate("p", "m", command="echo") == "run m p"


def test_embeddings(spark):
    rows = models.embed_texts(spark.createDataFrame([("a b",), ("a b",), (None,), ("",)], "t string"), "t").collect()
    assert {len(r.embedding) for r in rows} == {64} and rows[0].embedding == rows[1].embedding
    assert sum(x * x for x in rows[0].embedding) == pytest.approx(1, abs=1e-6)


def test_files(spark, tmp_path):
    for name, data in {"backend/a.py": "x = 1", "backend/b.txt": "t", "other/c.py": "y", "img/p.PNG": "n", "img/q.jpg": "line\nmore", "clip.wav": "hello "}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    got = {(r.folder, r.name): r.text for r in files.inventory(spark, str(tmp_path), {"backend"}).collect()}
    assert got == {("", "clip.wav"): None, ("backend", "a.py"): "x = 1", ("backend", "b.txt"): None}
    images = models.read_images(files.read_images(spark, str(tmp_path))).select("ocr.texts").collect()
    assert [r.texts for r in images] == [["line", "more"]]
    assert [r.speech.text for r in models.transcribe(files.read_audio(spark, str(tmp_path))).collect()] == ["hello"]
    (tmp_path / "d.txt").write_text("the 100\ncough 5\n")
    assert files.read_dictionary(spark, str(tmp_path / "d.txt")).collect() == [("the", 100), ("cough", 5)]


def test_inventory_of_tables_in_parts(spark, tmp_path):
    from tamarack.plans import queries

    for name, data in {"a.parquet/part-0.parquet": "xx", "a.parquet/k=1/part-1.parquet": "y", "b.parquet": "z", "d/e.parquet/part-0.parquet": "x", "d/n.py": "p"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    got = files.inventory(spark, str(tmp_path), whole=".parquet").collect()
    assert sorted((r.folder, r.name, r.bytes, r.text or "") for r in got) == [("", "a.parquet", 3, ""), ("", "b.parquet", 1, ""), ("d", "e.parquet", 1, ""), ("d", "n.py", 1, "p")]
    assert {(r.folder, r.name, r.has_bytes) for r in queries.file_inventory(spark, str(tmp_path)).collect()} == {("", "a.parquet", True), ("", "b.parquet", True), ("d", "e.parquet", True), ("d", "n.py", True)}


def test_inventory_reads_no_file_without_text(spark, tmp_path):
    (tmp_path / "big.parquet").touch()
    os.truncate(tmp_path / "big.parquet", (1 << 31) + 1)  # a hole, longer than a value can be
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "a.p[y").write_text("z")
    got = lambda code: {r.name: (r.bytes, r.text) for r in files.inventory(spark, str(tmp_path), code=code).collect()}
    assert got(".py") == {"big.parquet": ((1 << 31) + 1, None), "a.py": (5, "x = 1"), "a.p[y": (1, None)}
    assert got(".p[y") == {"big.parquet": ((1 << 31) + 1, None), "a.py": (5, None), "a.p[y": (1, "z")}
    assert got(".none")["a.py"] == (5, None)


def test_catalog_from_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "k0"}\n{"id": "k1"}\n')
    spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "ordinal long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    cat = Catalog.load(spark, {n: {"index_path": str(tmp_path / "v"), "jsonl_path": str(tmp_path / "r.jsonl"), "id_key": "id"} for n in ("a", "b")})
    q = spark.createDataFrame([(1, [1.9])], "query_id long, query array<float>")
    assert [(r["rank"], r.key, r.rec) for r in cat.search("a", q, 2).orderBy("rank").collect()] == [(1, "line_2", None), (2, "k1", '{"id": "k1"}')]
    assert cat.search_all(q, 3).count() == 6
    with pytest.raises(ValueError):
        cat.search("c", q)


def test_pipelines(spark):
    def index(recs):
        df = models.embed_texts(spark.createDataFrame([(i, t, json.dumps(r)) for i, (t, r) in enumerate(recs)], "ordinal long, t string, rec string"), "t")
        return Index(df.select("ordinal", "embedding"), df.select("ordinal", F.concat(F.lit("k"), "ordinal").alias("key"), "rec"))

    cat = Catalog({
        "diseases": index([("cough fever cold", {"chunk": {"disease": "common cold", "symptoms": ["Cough", "fever"]}}), ("itch rash", {"chunk": {"disease": "eczema", "symptoms": ["rash"]}})]),
        "drugs": index([("syrup", {"brand_name": "syrup", "indications_and_usage": "relief of COUGHING"}), ("cream", {"brand_name": "cream", "indications_and_usage": "skin irritation"})]),
        "drug_dict": index([("syrup", {"drug_name": "syrup"}), ("cream", {"drug_name": "cream"})]),
    })
    r = spark.createDataFrame([(1, "cough fever", "SYRUP 10 mg"), (2, "itch rash", "cream"), (3, "", ""), (4, "cough", None)], "query_id long, user_text string, ocr_text string")
    live = {x.query_id: x for x in pipeline.run(r, cat).collect()}
    assert set(live) == {1, 2, 3, 4} and live[1].result.meta.mismatch is None
    assert set(live[1].result.card.retrieved) == {"diseases", "drugs", "drug_dict", "drugs_from_ocr"} and set(live[4].result.card.retrieved) == {"diseases", "drugs"}
    assert cards.NO_IMAGE in live[3].prompt
    checked = {x.query_id: x for x in pipeline.run_checked(r, cat, k=1).collect()}
    assert [checked[i].result.meta.mismatch for i in (1, 2, 3, 4)] == [False, True, None, None]
    assert checked[1].answer.error and "mismatch_analysis" in checked[1].prompt


def test_pipelines_embed_and_answer_once(spark, tmp_path, sf_dir):
    from tamarack.plans import queries

    catalog, requests = queries._catalog(spark, sf_dir)
    assert not any("MapInArrow" in i.records._jdf.queryExecution().toString() for i in catalog.indexes.values())

    def counted():
        stub = models.stub_generator()

        def answer(prompts):
            for _ in prompts:
                (tmp_path / __import__("uuid").uuid4().hex).touch()
            return stub(prompts)

        return answer

    some = requests.filter("query_id < 4")
    n = some.count()
    assert len(pipeline.run(some, catalog, generator=counted).collect()) == n == len(list(tmp_path.iterdir()))
    assert len(pipeline.run_checked(some, catalog, generator=counted).collect()) == n and len(list(tmp_path.iterdir())) == 2 * n


def test_kernels_of_searches_are_bounded(spark, monkeypatch):
    """Rows that wait for their tile keep no batch, visits go on in parts, and of rows equally near k are left."""
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from tamarack.operators import grid

    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)], "ordinal long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "query_id long, query array<float>").coalesce(1)
    scored = knn.score_cells(grid.cells(grid.tiles(same, "ordinal", "embedding"), knn.asked(q).tiles), knn.asked(q).kind, 3, "l2", [])
    assert sorted((r.query_id, r.ordinal, r.score) for r in scored.collect()) == [(1, i, 0.0) for i in range(3)] + [(2, i, 5.0) for i in range(3)]

    kernels = []
    df = spark.createDataFrame([], "cell int, id long, v array<float>")
    with monkeypatch.context() as m:
        m.setattr(Classic, "mapInArrow", lambda self, kernel, schema: kernels.append(kernel))
        grid.tiles(df, "id", "v", ["cell"])
        index.VectorIndex(None, 2, 9000, "l2", np.zeros((1000, 2)), np.zeros(1000), np.full(1000, 9), {}).visits(q, lambda x: np.ones((len(x), 1000), bool))
    tiles, visits = kernels
    seen = []

    def batches():
        for i in range(300):
            v = pa.ListArray.from_arrays(pa.array(np.arange(1001, dtype=np.int32) * 64), pa.array(np.zeros(64_000, np.float32)))
            b = pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(999), i + 1), pa.int32()), pa.array(np.arange(1000)), v], names=df.columns)
            yield b.take(pa.array(np.arange(1000)))
            seen.append(pa.total_allocated_bytes())

    before = pa.total_allocated_bytes()
    assert sum(t.column("n")[0].as_py() for t in tiles(batches())) == 300_000
    assert max(seen) - before < 40_000_000  # the 300 batches have 80 MB
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(100)), pa.array([[0.0, 0.0]] * 100, pa.list_(pa.float32()))], names=["query_id", "query"])
    rows = [b.num_rows for b in visits(iter([asked]))]
    assert sum(rows) == 100_000 and max(rows) < 10_000


def test_models_are_made_once_in_a_worker(spark, tmp_path):
    def factory():
        (tmp_path / __import__("uuid").uuid4().hex).touch()
        return models.stub_embedder()

    df = spark.range(400).repartition(60).select(F.col("id").cast("string").alias("t"))
    for _ in range(2):
        assert models.embed_texts(df, "t", factory=factory).select("embedding").distinct().count() > 50
    assert 1 <= len(list(tmp_path.iterdir())) <= 16  # workers, not the 120 tasks
    other = models.embed_texts(df.limit(1), "t", factory=lambda: models.stub_embedder(8)).first()
    assert len(other.embedding) == 8


def test_generation_has_prompts_under_way_together():
    import time

    def slow(prompt, model, options=None):
        time.sleep(0.3)
        return prompt.upper()

    began = time.time()
    assert [r["text"] for r in models.generator(rest=slow, concurrency=4)()(list("abcdefgh"))] == list("ABCDEFGH")
    assert time.time() - began < 1.8


def test_contains_over_several_pieces(spark, monkeypatch):
    t = spark.createDataFrame([(1, "Coughing badly"), (2, "fine \U0001f600 cough"), (3, None), (3, None), (4, "")], "id long, text string")
    p = spark.createDataFrame([("COUGH", 1), ("", 2), (None, 3), ("bad", 4), ("cough", 5), ("\U0001f600", 6), ("ing", 7)], "phrase string, n int")
    for most in (1 << 20, 4):
        monkeypatch.setattr(containment, "_PIECE", most)
        assert sorted(r.id for r in matching.containing(t, p).collect()) == [1, 2]
        assert sorted((r.id, r.n) for r in matching.containing(t, p, "inner").collect()) == [(1, 1), (1, 4), (1, 5), (1, 7), (2, 1), (2, 5), (2, 6)]
    assert matching.containing(t, p.limit(0)).collect() == []


def test_native_swaps_equal_the_plain_measure(spark):
    import random

    rng = random.Random(1)
    pairs = [(w, "".join(x)) for w, x in ((w, rng.sample(w, len(w)) if rng.random() < 0.3 else w[::1]) for w in ("".join(rng.choices("abé", k=rng.randint(0, 7))) for _ in range(800)))]
    pairs += [(a, b) for a, b in (("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(800))] + [("ca", "abc"), ("abcd", "badc"), ("ab", "ba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("d", spelling.osa_within_2(F.col("a"), F.col("b"))).collect():
        assert r.d == min(3, spelling.osa(r.a, r.b)), r


def test_knn_of_vectors_that_cannot_be_measured(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "query_id long, query array<float>")
    c = spark.createDataFrame([(5, [0.0, 1.0]), (6, None), (7, [1.0]), (4, [2.0, 0.0])], "ordinal long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.ordinal, r.score) for r in knn.knn(q, c, 3).collect()}
    assert got == {(1, 1): (5, 1.0), (1, 2): (4, 4.0), (1, 3): (6, None), (2, 1): (4, None), (2, 2): (5, None), (2, 3): (6, None), (3, 1): (4, 1.0), (3, 2): (5, 2.0), (3, 3): (6, None)}
    assert {r.ordinal: r.score for r in knn.knn(q, c, 2, "cosine").filter("query_id = 3").collect()} == {4: 1.0, 5: 0.0}
    assert knn.knn(q.limit(0), c, 2).collect() == [] and knn.knn(q, c.limit(0), 2).collect() == []


def test_boxes_ids_dumps_and_files(spark, tmp_path):
    import numpy as np

    image = models.boxed(np.full((5, 6, 3), 255, np.uint8), [[[1, 1], [4, 1], [4, 3], [1, 3]], [[9, 9], [20, 9]]])
    assert models.ppm(image).startswith(b"P6 6 5 255\n") and (image[1, 1:5] == (255, 0, 0)).all() and (image[2, 2:4] == 255).all()
    shots = models.read_images(spark.createDataFrame([("a/b.ppm", b"one\ntwo"), ("c.ppm", b"x")], "name string, content binary")).select("name", F.col("ocr.preview").alias("content"))
    assert files.write_files(shots, str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "a_b.ppm").read_bytes().startswith(b"P6 25 20 255\n")
    ids = [r.id for r in sessions.with_ids(spark.createDataFrame([(None,), ("k",)], "id string")).collect()]
    assert ids[1] == "k" and len(ids[0]) == 36
    (tmp_path / "src" / "backend").mkdir(parents=True)
    (tmp_path / "src" / "backend" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "backend" / "b.py").write_bytes(b"\xff\xfe")
    (tmp_path / "src" / "z.txt").write_text("t")
    dump = files.code_dump(files.inventory(spark, str(tmp_path / "src"), {"backend"}), "src").first().text
    assert dump == "Main Folder: src\n\nFile: z.txt\n\nSubfolder: backend\n\nFile: a.py\n------ CODE START ------\nx = 1\n------ CODE END ------\n\nFile: b.py\n------ CODE START ------\n[Error reading file: not UTF-8]\n------ CODE END ------"
    card = spark.createDataFrame([("o", "a"), ("", "b")], "ocr_text string, llm_output string").select(cards.page(F.struct("*")).alias("p"))
    assert [r.p for r in card.collect()] == ["**OCR:** o\n\na", "b"]


def test_registered_pipelines_equal_plain_loops(spark, sf_dir):
    """Spelling, embedding, search, context, verdict and prompt of every request, one after the other."""
    import re

    import duckdb
    import numpy as np

    from tamarack.plans import queries

    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    plain = dict(con.execute(queries.ORACLE_SQL["normalize_spelled"]).fetchall())
    catalog, requests = queries._catalog(spark, sf_dir)
    index = {}
    for n, i in catalog.indexes.items():
        rows = i.vectors.orderBy("ordinal").collect()
        index[n] = (np.array([r.embedding for r in rows], np.float64), [r.ordinal for r in rows], {r.ordinal: (r.key, r.rec) for r in i.records.collect()})
    words = {w: n for w, n in con.execute(queries.ORACLE_SQL["token_vocab"]).fetchall() if n >= 2}

    def correct(word):
        near = [(spelling.osa(word, w), -n, w) for w, n in words.items() if abs(len(w) - len(word)) <= 2]
        best = min(near, default=(3, 0, ""))
        return best[2] if best[0] <= 2 and not word[0].isdigit() else word

    def spelled(name):  # a source's name: its digits stand alone
        return " ".join(map(correct, re.sub(r"(\d+)", r" \1 ", name.lower()).split()))

    embed = lambda t: np.array(models.stub_embedder()([t])[0], np.float32).astype(np.float64)

    def search(name, text, k):
        m, ordinals, recs = index[name]
        d = ((m - embed(text)) ** 2).sum(1)
        return [(*recs[ordinals[i]], d[i]) for i in np.lexsort((ordinals, d))[:k]]

    def context(found):
        return "".join(f"\n-- Retrieved from {n.upper()} --\n" + "".join(f"* Result: {rec} (Score: {d:.4f})\n" for _, rec, d in hits) for n, hits in found.items())

    live = {r.query_id: r for r in queries.rag_pipeline(spark, sf_dir).collect()}
    checked = {r.query_id: r for r in queries.rag_checked_pipeline(spark, sf_dir).collect()}
    asked = requests.collect()
    assert len(live) == len(checked) == len(asked)
    for r in asked:
        t = plain[r.query_id]
        by_user = {n: search(n, t, 5) for n in ("diseases", "drugs")}
        by_ocr = {"drug_dict": search("drug_dict", t, 5), "drugs_from_ocr": search("drugs", t, 5)} if r.ocr_text else {}
        slots = {"user_text": r.user_text, "ocr_text": r.ocr_text or cards.NO_IMAGE, "user_context": context(by_user), "ocr_context": context(by_ocr)}
        assert live[r.query_id].prompt == cards.ANALYSIS_PROMPT.format(**slots)
        got = json.loads(live[r.query_id].result)["card"]["retrieved"]
        want = by_user | by_ocr
        assert list(got) == list(want) and {n: [i["key"] for i in v] for n, v in got.items()} == {n: [h[0] for h in v] for n, v in want.items()}
        verdict = None
        if r.ocr_text:
            symptoms = {s for _, rec, _ in search("diseases", t, 3) for s in json.loads(rec)["chunk"]["symptoms"] if s}
            names = [json.loads(rec)["drug_name"] for _, rec, _ in search("drug_dict", t, 3)]
            uses = [json.loads(search("drugs", spelled(n), 1)[0][1])["indications_and_usage"] for n in names]
            verdict = not any(s in u.lower() for s in symptoms for u in uses)
        assert json.loads(checked[r.query_id].result)["meta"].get("mismatch") == verdict


def test_consecutive_clips_in_a_stream(spark, tmp_path):
    from tamarack.streaming.clips import consecutive_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "s long, seq long, id string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "x")], schema).coalesce(1).write.mode("append").parquet(src)

    def go():
        q = consecutive_stream(spark.readStream.schema(schema).parquet(src), "s", "seq", "id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()

    go()
    spark.createDataFrame([(1, 3, "a"), (1, 4, "b"), (2, 2, "x")], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    assert sorted((r.s, r.seq) for r in spark.read.parquet(out).collect()) == [(1, 1), (1, 4), (2, 1)]


def test_a_saved_dictionary_is_not_moved(spark, tmp_path):
    d = spark.createDataFrame([("cough", 50), ("tough", 90), ("vitamin", 10), ("the", 100), ("a", 9)], "term string, count bigint")
    w = spark.createDataFrame([(x,) for x in ("cuogh", "cough", "vitamni", "xyzzy", "teh", "rough", "vitaminnn", "a", "cough")], "token string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        saved = spelling.SpellIndex.save(d, "test_spelling", buckets=8)
        for measure in ("osa", "levenshtein"):
            assert rows(spelling.closest(w, saved, measure=measure)) == rows(spelling.closest(w, d, measure=measure))
        plan = spelling.corrected(w, spelling.SpellIndex.open(spark, "test_spelling"))._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [i for i, x in enumerate(plan) if "test_spelling" in x and "Scan" in x]
        assert len(scans) == 1
        for i in scans:
            depth, above = len(plan[i]) - len(plan[i].lstrip(" :+-*()0123456789")), []
            for x in reversed(plan[:i]):
                own = len(x) - len(x.lstrip(" :+-*()0123456789"))
                if own < depth:
                    above.append(x)
                    depth = own
            join = next(k for k, x in enumerate(above) if "Join" in x)
            assert not any("Exchange" in x for x in above[:join])
        t = spark.createDataFrame([(1, "Teh 12.5 vitamni cuogh!"), (2, None)], "id long, text string")
        assert rows(spelling.normalize(t, saved)) == rows(spelling.normalize(t, d))
        with pytest.raises(ValueError, match="2 edits, not 3"):
            spelling.SpellIndex.open(spark, "test_spelling", 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS test_spelling")


def test_a_stream_of_requests_is_answered_as_the_table_is(spark, sf_dir, tmp_path):
    from tamarack.plans import queries
    from tamarack.streaming.requests import answer_stream

    catalog, requests = queries._catalog(spark, sf_dir)
    requests = requests.filter("query_id < 12")
    for i in range(2):
        requests.filter(F.col("query_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = lambda df: sorted((r.query_id, r.prompt, str(r.result)) for r in df.collect())
    want = rows(pipeline.run(requests, catalog))
    for cp in ("a", "b"):  # the second time all batches come again
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        answer_stream(stream, catalog, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.read.parquet(str(tmp_path / "out"))) == want


def test_boxes_are_drawn_on_the_photo(spark):
    rng = np.random.default_rng(1)
    photo = rng.integers(0, 200, (400, 700, 3), dtype=np.uint8)
    data = b"P6\n# Take two\n# daily\n700 400 255\n" + photo.tobytes()
    assert (models.pixels(data) == photo).all() and models.pixels(b"text") is None and models.pixels(data[:-1]) is None and models.pixels(None) is None
    box = [[300, 280], [650, 280], [650, 390], [300, 390]]
    df = spark.createDataFrame([(1, data, [box]), (2, b"no image", [[[1, 1], [3, 1], [3, 3]]]), (3, None, None)], "id int, content binary, boxes array<array<array<int>>>")
    got = {r.id: models.pixels(bytes(r.preview)) for r in models.draw_boxes(df).collect()}
    want = models.boxed(photo, [box])
    assert (got[1] == want).all() and (got[1][280, 300:651] == (255, 0, 0)).all() and (got[1] != photo).any(axis=2).sum() < 1000
    assert got[2].shape == (4, 4, 3) and got[3].shape == (1, 1, 3)
    read = models.read_images(df).filter("id = 1").first().ocr
    assert read.texts == ["Take two", "daily"] and models.pixels(bytes(read.preview)).shape == photo.shape


def test_images_go_through_the_model_in_parts(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    kernels = []
    df = spark.createDataFrame([], "content binary, id int")
    with monkeypatch.context() as m:
        m.setattr(Classic, "mapInArrow", lambda self, kernel, schema: kernels.append(kernel))
        models.read_images(df)
    page = "\n".join(["a line of forty characters, more or less"] * 40).encode()
    items = [page] * 300 + [None, b"", page * 1000] + [page * 300] * 3
    out = list(kernels[0]([pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((items, pa.binary()), (range(len(items)), pa.int32()))], names=df.columns), pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int32())], names=df.columns)]))
    own = [b.column(2) for b in out]
    assert max(b.num_rows for b in out) <= 16 and max(o.field("preview").nbytes for o in own) <= 16 * (3 * 256 * 256 + 100)
    assert [i for b in out for i in b.column(1).to_pylist()] == list(range(len(items)))
    assert [x for o in own for x in o.to_pylist()] == models.stub_ocr()(items)
