from pyspark.sql import functions as F

from moderata.operators import classify, logistic
from moderata.plans import flows
from moderata.session import settle
from moderata.sources import index_store


def test_train_and_evaluate_with_retrieval(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("nice word"), F.col("id") % 4))
        .otherwise(F.concat(F.lit("nasty word"), F.col("id") % 4))
        .alias("tweet"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.lit("train").alias("split"),
    )
    rows.write.partitionBy("split").parquet(f"{base}/tweets")
    scored = rows.select(F.col("tweet").alias("Text"), F.col("label").cast("double").alias("Label"))
    for split in ("train", "test"):
        scored.withColumn("split", F.lit(split)).write.mode("append").partitionBy("split").parquet(f"{base}/gender")

    train, val = flows.prepare(spark, {"twitter": f"{base}/tweets", "gender": f"{base}/gender"}, f"{base}/set")
    assert (train.count(), val.count()) == (48 + 60, 12 + 60)
    assert val.select("row_id").distinct().count() == 72
    model = settle(classify.train_naive_bayes(train))
    docs = spark.createDataFrame([(1, "About words. A word0 is fine."), (2, "Nothing here.")], "doc_id bigint, text string")
    index = index_store.build_index(docs, f"{base}/index")
    got = flows.evaluate_models(val, {"a": model, "b": model}, index).collect()
    table = {(r.model_id, r.rag, r.dataset): (r.n, r.accuracy) for r in got}
    assert len(got) == 3 * 3 * 3
    assert table["a", "false", "twitter"] == (12, 1.0)
    assert table["a", "true", "gender"][0] == 60
    assert table["(all)", "(all)", "(all)"][0] == 4 * 72
    weights = logistic.train(train, "row_id")
    both = {"a": model, "lr": lambda r: logistic.score(r, weights, "row_id", "terms", carry=["dataset", "label"])}
    scores = {(r.model_id, r.dataset): r.accuracy for r in flows.evaluate_models(val, both).collect()}
    assert scores["lr", "(all)"] == scores["a", "(all)"] == 1.0
    plain = flows.evaluate_models(val, {"a": model})
    assert {r.rag for r in plain.collect()} == {"false", "(all)"}


def test_preference_set(spark, tmp_path):
    rows = spark.range(40).select(
        F.concat(F.lit("p"), F.col("id")).alias("prompt"),
        (F.col("id") % 2).cast("int").alias("prompt_label"),
        F.when(F.col("id") != 3, F.concat(F.lit("g"), F.col("id"))).alias("generation"),
        F.lit("train").alias("split"),
    )
    rows.write.partitionBy("split").parquet(str(tmp_path / "t" / "train"))
    train, val = flows.preference_set(spark, str(tmp_path / "t"), str(tmp_path / "out"))
    assert (train.count(), val.count()) == (37, 2)
    assert train.columns == ["prompt", "completion", "label"]
