import os

import duckdb
import pytest

import corpus_pipeline
from moderata.llm.oracles import ORACLES
from moderata.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    df = QUERIES[name](spark, data)
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    place = {c: i for i, c in enumerate(columns)}
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([r[place[c]] for c in df.columns]) for r in result.fetchall())
    assert sorted(repr(list(r)) for r in df.collect()) == want


def test_all_operators_are_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


def test_pipeline_packs_what_its_stages_keep(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} <= ids and len(rows) > 0.5 * len(ids)
    assert len(corpus_pipeline.STAGES) == 5 and "text" in columns
