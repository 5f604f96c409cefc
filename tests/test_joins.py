import pytest
from pyspark.sql import functions as F

from moderata.operators import logistic
from moderata.operators.joins import heavy_keys, lookup_join
from moderata.session import settle


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [1000, 0])
def test_lookup_join_with_a_hot_key(spark, how, limit):
    facts = spark.range(2000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 90))
        .alias("key"),
    )
    lookup = (
        facts.where("key is not null and key not like 'k1%'")
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.length(F.first("key")).alias("v"))
    )
    got = lookup_join(facts, lookup, ["key"], row_id=["id"], matches="n", how=how, broadcast_rows=limit, rows_per_task=50)
    want = facts.join(lookup.drop("n"), ["key"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_is_spread(spark):
    facts = spark.range(10000).select("id", F.lit("hot").alias("key"))
    lookup = facts.groupBy("key").agg(F.count("*").alias("n"), F.lit(1).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(
            facts, lookup, ["key"], row_id=["id"], matches="n", broadcast_rows=0, rows_per_task=500
        )
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in sizes) == 10000
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 10000


def spread_of(joined):
    """Rows of the joined table by the task that made them."""
    counts = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    return sorted((r["count"] for r in counts), reverse=True)


@pytest.mark.parametrize("token", ["absent", None, "t5"])
def test_a_key_is_dealt_by_the_facts_own_count(spark, token):
    facts = spark.range(100_000).select(
        "id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("t"), (F.col("id") % 997).cast("string"))).otherwise(F.lit(token)).alias("t")
    )
    lookup = spark.range(997).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(facts, lookup, ["t"], row_id=["id"], how="left", broadcast_rows=0, rows_per_task=1000)
        sizes = spread_of(joined)
        rows = {r["id"]: r["n"] for r in joined.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == len(rows) == 100_000 and sizes[0] < 45_000
    want = {"t5": 5}.get(token)
    assert all(n == (i % 997 if i % 10 == 0 else want) for i, n in rows.items())


def test_heavy_keys_are_found_whatever_the_lookup(spark):
    facts = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    heavy = heavy_keys(facts, ["k"], 1000)
    # The sketch may count a little too much.
    assert len(heavy) == 1 and 25 <= next(iter(heavy.values())) <= 30 and heavy_keys(facts.limit(0), ["k"]) == {}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_facts_of_common_keys_stay_where_they_are(spark, how):
    word = F.when(F.col("id") % 20 > 0, F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).otherwise(F.col("id").cast("string"))
    facts = settle(spark.range(20_000).select("id", F.when(F.col("id") % 400 > 0, word).alias("key")))
    lookup = settle(
        facts.where("key IS NOT NULL AND key <> '20'").groupBy("key").agg(F.count("*").alias("n"), F.length("key").alias("v"))
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lookup_join(facts, lookup, ["key"], row_id=["id"], common="n", how=how, settled=True, broadcast_rows=10)
        rows, plan = got.collect(), got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = facts.join(lookup.drop("n"), ["key"], how)
    assert got.columns == want.columns
    assert sorted(map(str, rows)) == sorted(map(str, want.collect()))
    assert plan.count("BroadcastHashJoin") >= 2
    assert "LeftAnti" in plan


def test_weights_carry_the_rows_of_a_term(spark):
    rows = [(i, f"a b{i % 3} c{i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, text string, label int")
    at_once = logistic.train(df, "id")
    apart = logistic.train(df, "id", broadcast_rows=5)
    weights = lambda t: {r["term"]: (round(r["weight"], 9), r["n_rows"]) for r in t.collect()}
    assert weights(at_once) == weights(apart) and weights(apart)["a"][1] == 40 and len(weights(apart)) == 45
    scored = lambda b: sorted(map(str, logistic.score(df, apart, "id", broadcast_rows=b).collect()))
    assert scored(5) == scored(1000)


def test_the_length_of_a_text_is_added_up_once(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, None), (3, "")], "id bigint, text string")
    table = logistic.term_table(df, "id")
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "/ SQRT(" not in plan and "/ sqrt(" not in plan
    rows = sorted((r["id"], r["term"], round(r["x"], 6)) for r in table.collect())
    assert rows == [(1, "", 1.0), (1, "a", 0.894427), (1, "b", 0.447214), (2, "", 1.0), (3, "", 1.0)]
