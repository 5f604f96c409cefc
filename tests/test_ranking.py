import hashlib
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from moderata.session import settle
from moderata.operators import evaluate, ranking


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n, size", [(0, 0.2), (1, 0.2), (11, 0.2), (100, 0.05), (1000, 0.07)])
def test_split_is_exact(spark, n, size):
    df = spark.range(n)
    train, test = ranking.split(df, "id", size)
    got = {r.id for r in test.collect()}
    want = set(sorted(range(n), key=key)[: math.ceil(size * n)])
    assert got == want
    assert {r.id for r in train.collect()} == set(range(n)) - want


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    marks = [
        sorted(map(tuple, ranking.with_split(d, "id", 0.2).collect()))
        for d in (df, df.repartition(7), df.orderBy(F.col("id").desc()))
    ]
    assert marks[0] == marks[1] == marks[2]
    other = ranking.with_split(df, "id", 0.2, seed=7).where("is_test")
    assert {r.id for r in other.collect()} != {m[0] for m in marks[0] if m[1]}


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_split_is_the_same_for_any_prefix(spark, digits):
    rows = ranking.with_split(spark.range(300), "id", 0.3, prefix_digits=digits).where("is_test")
    assert {r.id for r in rows.collect()} == set(sorted(range(300), key=key)[:90])


def test_group_split_keeps_equal_values_together(spark):
    df = spark.range(400).withColumn("text", F.concat(F.lit("t"), F.col("id") % 40))
    marked = ranking.with_split(df, "id", 0.3, group_by="text")
    sides = marked.groupBy("text").agg(F.countDistinct("is_test").alias("n"))
    assert sides.where("n > 1").count() == 0
    assert 0 < marked.where("is_test").count() < 400


def test_split_never_shuffles_the_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = ranking.with_split(docs, "doc_id", 0.2)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("+- Subquery")[0]
    assert "Exchange" not in main and "Window" not in main


def test_stratified_quotas_by_largest_remainder(spark):
    sizes = {"a": 7, "b": 13, "c": 1, "d": 300}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)] + [("none", None)]
    df = spark.createDataFrame(rows, "id string, s string")
    total = sum(sizes.values())
    wanted = math.ceil(0.2 * total)
    base = {s: n * wanted // total for s, n in sizes.items()}
    left = wanted - sum(base.values())
    for s in sorted(sizes, key=lambda s: (-(sizes[s] * wanted % total), s))[:left]:
        base[s] += 1
    want = {i for s in sizes for i in sorted((f"{s}{k}" for k in range(sizes[s])), key=key)[: base[s]]}
    for limit in (1000, 0):
        marked = ranking.with_stratified_split(df, "id", "s", 0.2, broadcast_rows=limit)
        assert {r.id for r in marked.where("is_test").collect()} == want
        assert marked.count() == len(rows)


def test_positions_with_a_hot_group(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.hash("id") % 11).alias("o"),
    )
    got = ranking.with_position(df, ["o", "id"], ["g"])
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert sorted(map(tuple, got.select("id", "position").collect())) == sorted(
        map(tuple, want.select("id", F.col("position").cast("bigint")).collect())
    )
    overall = ranking.with_position(df.select("o", "id"), ["o", "id"])
    assert sorted(r.position for r in overall.collect()) == list(range(1, 3001))


def test_shuffle_is_a_permutation(spark, tmp_path):
    df = spark.range(100)
    rows = ranking.shuffle_positions(df, "id").orderBy("position").collect()
    assert [r.id for r in rows] == sorted(range(100), key=key)
    ranking.write_shuffled(df, "id", str(tmp_path / "s"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == list(range(100))


def test_batches_keep_order_and_the_short_rest(spark):
    rows = ranking.with_batch(spark.range(70).repartition(5), ["id"], 32).collect()
    assert all(r.batch_id == r.id // 32 for r in rows)


def test_next_row_is_stitched_over_partitions(spark):
    rng = random.Random(3)
    # One group with most rows, its timestamps sparse and uneven, beside small ones.
    stamps = sorted({int(10 ** rng.uniform(0, 15)) for _ in range(1500)})
    rows = [("hot", t, f"v{t}") for t in stamps] + [(f"g{g}", t, f"{g}{t}") for g in range(60) for t in range(0, 5 * (g % 4), 5)]
    df = spark.createDataFrame(rows, "g string, t bigint, v string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = settle(ranking.with_next(df, "g", "t", ["v"]))
        blocks = df.repartitionByRange("g", "t").withColumn("b", F.spark_partition_id()).where("g = 'hot'")
        assert blocks.select("b").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = df.withColumn("next_v", F.lead("v").over(Window.partitionBy("g").orderBy("t")))
    columns = ["g", "t", "next_v"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


@pytest.mark.parametrize("digits", [1, 4])
def test_split_by_radix_selection(spark, monkeypatch, digits):
    monkeypatch.setattr(ranking, "FEW_KEYS", 3)
    df = spark.range(500)
    want = set(sorted(range(500), key=key)[:101])
    assert {r.id for r in ranking.with_split(df, "id", 0.2019, prefix_digits=digits).where("is_test").collect()} == want
    assert ranking.with_split(df, "id", 0.0).where("is_test").count() == 0
    assert ranking.with_split(df, "id", 1.0).where("is_test").count() == 500
    assert ranking.with_split(df.limit(0), "id", 0.5).count() == 0
    same = spark.createDataFrame([(1,)] * 20, "id int")
    assert ranking.with_split(same, "id", 0.1, prefix_digits=digits).where("is_test").count() == 20
    with pytest.raises(ValueError, match="1 rows have no id"):
        ranking.with_split(spark.createDataFrame([(1,), (None,)], "id int"), "id", 0.5)


def test_null_groups_keep_their_rows(spark):
    rows = [(1, 1), (1, 2), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g int, t int")
    placed = ranking.with_position(df, ["t"], group_by=["g"]).collect()
    assert sorted((r.t, r.g, r.position) for r in placed) == [(1, 1, 1), (2, 1, 2), (3, None, 1), (4, None, 2)]
    following = ranking.with_next(df, "g", "t", ["t"]).collect()
    assert sorted((r.t, r.next_t) for r in following) == [(1, 2), (2, None), (3, 4), (4, None)]
    steps = evaluate.progress_rows(evaluate.with_step(df, ["t"], epoch="g"), epoch="g", every=1).collect()
    assert sorted((r.t, r.g, r.steps) for r in steps) == [(2, 1, 2), (4, None, 2)]
