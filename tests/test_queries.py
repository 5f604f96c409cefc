import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from moderata.plans.catalog import QUERIES
from moderata.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and v != v else v
    return sorted(columns), sorted(repr([clean(r[i]) for i in order]) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["dataset", "n", "correct", "accuracy"]


# Row-wise or grouped operators that must stay free of Python and of one-task windows over data.
NATIVE = [
    "labelled_docs", "filter_not_null", "dropna_then_project", "binarize_threshold", "concat_sources", "batch_ids",
    "shuffle_order", "split_exact", "split_stratified", "length_stats", "html_to_text", "chunk_documents", "encode_fixed",
    "chat_render", "tfidf_index", "kto_examples", "dpo_pairs", "nb_train", "nb_predict", "accuracy_rollup", "epoch_elapsed",
]


@pytest.mark.parametrize("name", NATIVE)
def test_plan_stays_in_the_jvm(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for marker in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMap", "CartesianProduct", "NestedLoop"):
        assert marker not in plan, marker
