from pyspark.sql import functions as F

from moderata.functions import labels as lb
from moderata.operators import curate

NAN = float("nan")


def test_sum_above_is_strict_and_missing_is_zero(spark):
    rows = [(2.5, 3.0), (3.0, 3.0), (None, 5.0), (NAN, 5.0), (5.6, None), (6.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(lb.sum_above(F.col("a"), F.col("b"))).collect()]
    assert got == [0, 1, 0, 0, 0, 1]


def test_above_is_strict_and_missing_is_zero(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (None,), (NAN,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(lb.above(F.col("x"), 0.5)).collect()] == [0, 1, 0, 0, 1]


def test_differs_counts_missing_as_different(spark):
    df = spark.createDataFrame([("Neutral",), ("other",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(lb.differs(F.col("c"))).collect()] == [0, 1, 1, 1]


def test_casts(spark):
    df = spark.createDataFrame([("0",), ("2",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(lb.as_int(F.col("c"))).collect()] == [0, 2, None, None]
    numbers = spark.createDataFrame([(0,), (1,), (2,)], "n int")
    assert [r[0] for r in numbers.select(lb.as_bool(F.col("n"))).collect()] == [False, True, True]


def test_null_drop_and_projection_do_not_commute(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", NAN)], "text string, other double")
    before = curate.project(curate.drop_any_null(df), {"text": "text"})
    after = curate.drop_any_null(curate.project(df, {"text": "text"}))
    assert [r.text for r in before.collect()] == ["b"]
    assert sorted(r.text for r in after.collect()) == ["a", "b", "c"]


def test_not_null_filter_reaches_the_scan(spark, data):
    df = curate.filter_not_null(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_concat_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, text string")
    b = spark.createDataFrame([(2, "y", 3)], "id bigint, text string, extra int")
    rows = curate.concat_tagged({"a": a, "b": b}).orderBy("id").collect()
    assert [(r.id, r.text, r.extra, r.dataset) for r in rows] == [(1, "x", None, "a"), (2, "y", 3, "b")]
