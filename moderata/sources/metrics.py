"""The metrics tables: evaluation results and training-log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVALUATION = ("model_id", "dataset", "rag", "metric", "value")
# Log, save and evaluate every so many steps.
LOGGING_STEPS, SAVE_STEPS, EVAL_STEPS = 1000, 2000, 2000


def append_evaluation(
    accuracies: DataFrame, path: str, model_id: Column | str, rag: Column | bool = False
) -> None:
    """Append accuracy rows ``(dataset, accuracy)`` to the table at ``path``."""
    given = lambda v: v if isinstance(v, Column) else F.lit(v)
    accuracies.select(
        given(model_id).cast("string").alias("model_id"),
        "dataset",
        given(rag).cast("boolean").alias("rag"),
        F.lit("accuracy").alias("metric"),
        F.col("accuracy").alias("value"),
    ).write.mode("append").parquet(path)


def every(log: DataFrame, steps: int, step: str = "step") -> DataFrame:
    """Log rows due every ``steps`` steps."""
    return log.where((F.col(step) > 0) & (F.pmod(F.col(step), F.lit(steps)) == 0))


def append_log(log: DataFrame, path: str, steps: int = LOGGING_STEPS) -> None:
    """Append the due rows of a training log ``(run, epoch, step, loss, ts)``."""
    every(log, steps).select("run", "epoch", "step", "loss", "ts").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
