"""Saving and loading trained classifiers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_naive_bayes(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_naive_bayes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_logistic(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_logistic(path: str) -> PipelineModel:
    return PipelineModel.load(path)
