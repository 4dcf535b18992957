import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.lineage import with_row
from tamarack.operators import containment


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_containing_is_what_all_pairs_give(spark, monkeypatch, piece):
    monkeypatch.setattr(containment, "_PIECE", piece)
    rng = np.random.default_rng(5)
    letters = list("abcAB é\U0001f600\n")
    word = lambda n: "".join(rng.choice(letters, n))
    texts = [(i, word(int(rng.integers(0, 120)))) for i in range(120)] + [(200, None), (201, ""), (202, "the same start, then one"), (202, "the same start, then one")]
    phrases = [word(int(rng.integers(1, 5))) for _ in range(15)] + [t[a : a + 12] for _, t in texts[:40] for a in (3,) if t] + [word(20) for _ in range(10)]
    phrases += [f"The same start, then {x}" for x in ("one", "two", "three")] + ["", None, "the same start, THEN one", "same sta", "same start"]
    t = spark.createDataFrame(texts, "id long, text string").repartition(3).withColumns({"_tmk_row": F.lit(1), "_phrase_": F.lit(2)})
    p = spark.createDataFrame([(i, x) for i, x in enumerate(phrases)], "n long, phrase string")
    lower = lambda c: c.lower()
    want = sorted((i, n) for i, x in texts for n, y in enumerate(phrases) if x and y and lower(y) in lower(x))
    got = containment.containing(t, p, "inner")
    assert sorted((r.id, r.n) for r in got.collect()) == want and set(t.columns) <= set(got.columns)
    semi = containment.containing(t, p)
    assert semi.columns == t.columns and sorted(r.id for r in semi.collect()) == sorted(i for i, x in texts if x and any(y and lower(y) in lower(x) for y in phrases))
    assert containment.containing(t, p.limit(0)).collect() == [] and containment.containing(t.limit(0), p).collect() == []


def test_phrases_with_a_common_start_are_keyed_by_what_is_rare(spark):
    t = spark.createDataFrame([(i, f"it is known that number {i} is here") for i in range(300)], "_tmk_row long, text string")
    p = spark.createDataFrame([(f"it is known that number {i} is",) for i in range(0, 300, 3)], "phrase string")
    keys = containment.keyed(p, t).collect()
    assert len(keys) == 100 and len({k.gram for k in keys}) == 100 and all(k["size"] == containment.Q for k in keys)


def test_rows_of_files_read_twice_and_of_random_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("id", "id AS _tmk_row_at", "'x' AS _tmk_file").coalesce(1).write.parquet(path)
    plain = with_row(spark.read.parquet(path))
    assert plain.select("_tmk_row").distinct().count() == 50 and plain.columns == ["id", "_tmk_row_at", "_tmk_file", "_tmk_row"]
    twice = with_row(spark.read.parquet(path, path))
    assert twice.count() == 100 and twice.select("_tmk_row").distinct().count() == 100
    some = with_row(spark.read.parquet(path).filter(F.rand() < 0.5).withColumn("r", F.rand()))
    assert some.collect() == some.collect()
