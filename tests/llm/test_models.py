import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import langid, quality


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    net = langid.new_network(["a", "b", "c"], 3, rng)
    for k in "xuwb":
        setattr(net, k, getattr(net, k).astype(np.float64))
    codes, label = rng.integers(60, 70, (7, 5)), np.array([0, 1, 2, 1, 0])
    _, grads = langid.loss_and_gradients(net, codes, label)
    for k in "xuwb":
        a = getattr(net, k)
        for _ in range(6):
            i = tuple(int(rng.integers(0, s)) for s in a.shape)
            old, losses = a[i], []
            for step in (0.01, -0.01):
                a[i] = old + step
                losses.append(langid.loss_and_gradients(net, codes, label)[0])
            a[i] = old
            assert (losses[0] - losses[1]) / 0.02 == pytest.approx(float(grads[k][i]), abs=2e-4)


def test_pooling_in_windows_equals_position_by_position():
    net = langid.new_network(["a", "b"], 4, np.random.default_rng(3))
    text = "Wörter über Brücken and boats, " * 9
    data = text.encode()
    total = np.zeros(2)
    sig = lambda v: 0.5 + 0.5 * np.tanh(v)
    for at in range(0, len(data), langid.WINDOW):
        w = data[at : at + langid.WINDOW]
        states = []
        for d, order in ((0, range(len(w))), (1, range(len(w) - 1, -1, -1))):
            h, own = np.zeros(4), {}
            for t in order:
                a = net.x[d][:, w[t]] + net.u[d] @ h
                h = h + sig(a[:4]) * (np.tanh(a[4:]) - h)
                own[t] = h
            states.append(own)
        for t in range(len(w)):
            e = np.exp(net.w[0] @ states[0][t] + net.w[1] @ states[1][t] + net.b[:, 0])
            total += e / e.sum()
    got = langid.text_probabilities(net, ["", text, None, "x"])
    assert got[1] == pytest.approx(total / len(data), abs=1e-5)
    assert (got[[0, 2]] == 0).all()


def test_languages_of_held_out_documents(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [i for i in true if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r.held_out} == set(out)
    assert np.mean([rows[i].lang_pred == true[i] for i in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())
    net = langid.fit(docs, per_lang=20, rounds=5)
    edge = langid.predict_language(edge_docs, net).collect()
    assert len(edge) == edge_docs.count()
    assert {r.lang_pred for r in edge if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.identify_languages(no_docs).collect() == []
    assert {r.lang_pred for r in langid.predict_language(edge_docs, None).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    out = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(rows[i].held_out for i, _ in out)
    assert np.mean([rows[i].predicted == q for i, q in out]) > 0.98
    assert quality.keep_quality(docs, labels).count() == sum(r.predicted for r in rows.values())


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(2)
    x = [rng.standard_normal((60, quality.FEATURES)) * (k + 1) + k for k in (0, 1)]
    n = np.array([60.0, 60.0])
    model = quality.discriminant(n, np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.3)
    cov = [np.cov(a.T, bias=True) for a in x]
    pooled = np.diag(np.diag((cov[0] + cov[1]) / 2) + 1e-4)
    q = rng.standard_normal((5, quality.FEATURES))
    logs = []
    for a, s in zip(x, cov, strict=True):
        s, d = 0.7 * s + 0.3 * pooled, q - a.mean(0)
        logs.append(-0.5 * (d * np.linalg.solve(s, d.T).T).sum(1) - 0.5 * np.linalg.slogdet(s)[1])
    assert model.scores(q) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (8, None), (6, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_quality(edge_docs, labels).columns == edge_docs.columns
    assert {r.score for r in quality.quality_scores(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(no_docs, labels).collect() == []


@pytest.mark.parametrize("doc_id", [0, 3])
def test_the_sample_of_languages_is_of_rows(spark, monkeypatch, doc_id):
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, labels, langs, **_: seen.append((len(windows), langs)))
    many = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("words and "), F.col("id").cast("string")).alias("text"))
    taken = next(i for i in range(5, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rare = spark.createDataFrame([(taken, "fr", "un seul texte")], "doc_id long, lang string, text string")
    langid.fit(many.union(rare), per_lang=100)
    assert seen == [(101, ["en", "fr"])]
