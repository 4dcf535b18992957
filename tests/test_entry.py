import json
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == cols
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_catalog_has_whole_texts(spark, sf_dir):
    from tamarack.plans.queries import _catalog

    read = lambda t, i: {str(r[i]): r.text for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()}
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    catalog, requests = _catalog(spark, sf_dir)
    drugs = {r.key: json.loads(r.rec)["indications_and_usage"] for r in catalog.index("drugs").records.collect()}
    assert max(map(len, drugs.values())) > 200 and drugs == {k: docs[k] for k in drugs}
    seen = {str(r.query_id): r.ocr_text for r in requests.collect() if r.ocr_text}
    assert seen and seen == {k: items[k] for k in seen}
