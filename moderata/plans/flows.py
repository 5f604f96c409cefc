"""The three whole jobs: multi-dataset training, evaluation with retrieval, preference sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderata.operators import classify, curate, evaluate, retrieval, terms
from moderata.sources import registry
from moderata.sources.index_store import Index


Scorer = Callable[[DataFrame], DataFrame]


def _store(df: DataFrame, path: str) -> DataFrame:
    """Write rows with a ``row_id`` and read them back, so that the ids are fixed."""
    df.withColumn("row_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare(spark: SparkSession, folders: Mapping[str, str], path: str) -> registry.Pair:
    """Load the named datasets, concatenate each side and store both below ``path``.

    The rows are ``row_id, dataset, text, label``; null texts are dropped.
    """
    pairs = {name: registry.load(spark, name, folder) for name, folder in folders.items()}

    def side(at: int, name: str) -> DataFrame:
        frames = {
            dataset: registry.check_layout(
                pair[at].select("text", F.col("label").cast("bigint").alias("label")), registry.SUPERVISED
            )
            for dataset, pair in pairs.items()
        }
        rows = curate.filter_not_null(curate.concat_tagged(frames))
        return _store(rows, f"{path.rstrip('/')}/{name}")

    return side(0, "train"), side(1, "validation")


def preference_set(spark: SparkSession, folder: str, path: str) -> registry.Pair:
    """Store the unpaired preference rows with a prompt, split into train and validation."""
    stored = []
    for name, rows in zip(("train", "validation"), registry.load(spark, "toxigen_preference", folder)):
        kept = curate.filter_not_null(rows.select("prompt", "completion", "label"), "prompt")
        kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        stored.append(spark.read.parquet(f"{path.rstrip('/')}/{name}"))
    return stored[0], stored[1]


def evaluate_models(
    rows: DataFrame,
    models: Mapping[str, DataFrame | Scorer],
    index: Index | None = None,
    k: int = 1,
) -> DataFrame:
    """Accuracy of each model on ``rows(row_id, dataset, text, label)``.

    A model is a naive Bayes table or a function that takes ``row_id, dataset, label, text, terms``
    and returns at least ``dataset, label, pred``. Texts are split into terms once for all models and the index.
    With an ``index`` each model also scores the retrieval prompts. The result
    has a row for every combination of model, mode and dataset and their totals;
    the union of the datasets is a total, not a second pass.
    """
    carry = ["dataset", "label", "text"]
    inputs = {False: terms.term_table(rows, "row_id", carry=carry)}
    if index is not None:
        hits = retrieval.retrieve(inputs[False], "row_id", index.vectors, index.idf, k, text="terms")
        prompts = retrieval.augment(rows, "row_id", hits, index.chunks)
        inputs[True] = terms.term_table(prompts, "row_id", carry=carry)

    def scores(model: DataFrame | Scorer, texts: DataFrame) -> DataFrame:
        if callable(model):
            return model(texts)
        return classify.score_naive_bayes(texts, model, "row_id", "terms", carry=["dataset", "label"])

    scored = [
        scores(model, texts).select(
            F.lit(name).alias("model_id"), F.lit(rag).alias("rag"), "dataset", "label", "pred"
        )
        for name, model in models.items()
        for rag, texts in inputs.items()
    ]
    return evaluate.accuracy_cube(curate.concat(scored))
