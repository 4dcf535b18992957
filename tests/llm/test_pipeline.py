import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack.llm import quality
from test_dedup import alike
from test_text_ops import levels


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    score = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    kept = [i for i in sorted(texts) if score[i] >= 0.5]
    best = {}
    for i in kept:
        b = re.sub(r"[\x20\x09-\x0D]", "", texts[i][0])
        best[b] = min(best.get(b, (1, 0)), (-len(texts[i][0]), i))
    kept = sorted(i for _, i in best.values())
    of = alike([texts[i][0] for i in kept])
    first = {}
    for i, k in zip(kept, of, strict=True):
        first.setdefault(k, i)
    kept = sorted(first.values())
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [i for i in kept if not any(t in texts[i][0] for t in items)]
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert out.columns == [*docs.columns, "mix_copy"]
    sizes, taken = {}, {}
    for i in kept:
        sizes[texts[i][1]] = sizes.get(texts[i][1], 0) + len(texts[i][0].split())
    for r in rows:
        assert r.doc_id in set(kept) and r.text == texts[r.doc_id][0]
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert len({(r.doc_id, r.mix_copy) for r in rows}) == len(rows) and {r.mix_copy for r in rows} <= {1, 2}
    want = levels(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 3000 for s in want)
    assert np.isclose(sum(want.values()), 1.5 * sum(sizes.values()))


def test_stages_keep_columns_and_take_edge_cases(spark, edge_docs, no_docs, sf_dir):
    for docs in (edge_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns[: len(columns)] == columns, name
            docs.select(F.count(F.lit(1))).collect()
