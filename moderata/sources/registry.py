"""Dataset registry: each named source to ``(train, validation)`` in one layout.

Every loader follows its source's own order of steps, because null drop,
threshold and projection give different rows in a different order. Loaders take
tables; :func:`load` reads them by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata.functions import labels as lb
from moderata.operators import curate
from moderata.operators.ranking import split, with_stratified_split
from moderata.sources.tables import ROW_ID, read_tsv, read_with_row_id

SUPERVISED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.LongType())]
)
UNPAIRED = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("label", T.BooleanType()),
    ]
)
PAIRED = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", T.StringType()),
        T.StructField("rejected", T.StringType()),
    ]
)
CATEGORY_FILE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("labels", T.StringType()),
    ]
)


def check_layout(df: DataFrame, layout: T.StructType) -> DataFrame:
    """Fail early if ``df`` lacks a column of ``layout`` or has it with another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in layout.fields:
        if have.get(field.name) != field.dataType:
            raise TypeError(f"{field.name}: expected {field.dataType}, found {have.get(field.name)}")
    return df


Pair = tuple[DataFrame, DataFrame]


def statements(train: DataFrame) -> DataFrame:
    """Generated statements: rows with any null go first, then the two columns."""
    whole = curate.drop_any_null(train)
    kept = curate.project(whole, {"generation": "text", "prompt_label": "label"})
    return kept.withColumn("label", lb.as_int(F.col("label")))


def annotations(annotated: DataFrame) -> DataFrame:
    """Annotated statements: label 1 where both toxicity scores add up to over 5.5."""
    return annotated.select(
        "text", lb.sum_above(F.col("toxicity_ai"), F.col("toxicity_human")).alias("label")
    )


def toxigen(train: DataFrame, annotated: DataFrame) -> Pair:
    return statements(train), annotations(annotated)


def toxigen_raw(train: DataFrame, annotated: DataFrame) -> Pair:
    """As :func:`toxigen`, but all columns and nulls stay in the train rows."""
    renamed = train.withColumnsRenamed({"prompt_label": "label", "generation": "text"})
    return renamed, annotations(annotated)


def toxigen_preference(
    train: DataFrame, row_id: str = ROW_ID, test_size: float = 0.05, seed: int = 42
) -> Pair:
    """Unpaired preference rows; exact seeded split."""
    kept = curate.drop_any_null(train).select(
        row_id,
        "prompt",
        F.col("generation").alias("completion"),
        lb.as_bool(F.col("prompt_label")).alias("label"),
    )
    train_rows, test_rows = split(kept, row_id, test_size, seed)
    return train_rows.drop(row_id), test_rows.drop(row_id)


def twitter(df: DataFrame, row_id: str = ROW_ID, test_size: float = 0.2, seed: int = 42) -> Pair:
    """Tweets: rename, integer label, drop rows with any null, exact split."""
    rows = df.withColumnRenamed("tweet", "text").withColumn("label", lb.as_int(F.col("label")))
    train_rows, test_rows = split(curate.drop_any_null(rows), row_id, test_size, seed)
    return train_rows.drop(row_id), test_rows.drop(row_id)


def tweets_stratified(
    df: DataFrame, row_id: str = ROW_ID, test_size: float = 0.2, seed: int = 42
) -> Pair:
    """Tweets with the label shares kept on both sides."""
    rows = df.withColumnRenamed("tweet", "text")
    marked = with_stratified_split(rows, row_id, "label", test_size, seed, name="_is_test")
    return (
        marked.where(~F.col("_is_test")).drop("_is_test", row_id),
        marked.where(F.col("_is_test")).drop("_is_test", row_id),
    )


def berkeley(df: DataFrame, row_id: str = ROW_ID, test_size: float = 0.2, seed: int = 42) -> Pair:
    """Scored comments: threshold first, so a missing score is 0 and only null text drops."""
    rows = df.select(
        row_id, "text", lb.above(F.col("hate_speech_score"), lb.SCORE_THRESHOLD).alias("label")
    )
    train_rows, test_rows = split(curate.drop_any_null(rows), row_id, test_size, seed)
    return train_rows.drop(row_id), test_rows.drop(row_id)


def gender(train: DataFrame, test: DataFrame) -> Pair:
    """Two given splits, threshold before the null drop."""

    def harmonise(df: DataFrame) -> DataFrame:
        label = lb.above(F.col("Label"), lb.SCORE_THRESHOLD).alias("label")
        return curate.drop_any_null(df.select(F.col("Text").alias("text"), label))

    return harmonise(train), harmonise(test)


def cad(train: DataFrame, dev: DataFrame, test: DataFrame) -> Pair:
    """Category files: train and dev together, id dropped, anything not neutral is 1."""

    def harmonise(df: DataFrame) -> DataFrame:
        renamed = df.drop("id").withColumnRenamed("labels", "label")
        return curate.drop_any_null(renamed.withColumn("label", lb.differs(F.col("label"))))

    return harmonise(curate.concat([train, dev])), harmonise(test)


@dataclass(frozen=True)
class Dataset:
    """A named source: its text and label column and how to load it from a folder."""

    text: str
    label: str
    read: Callable[[SparkSession, str], Pair]


def _split_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One named split: the folder is partitioned by ``split``, so only it is read."""
    return spark.read.parquet(folder).where(F.col("split") == name).drop("split")


def _config(spark: SparkSession, folder: str, config: str, split_name: str) -> DataFrame:
    return _split_of(spark, f"{folder.rstrip('/')}/{config}", split_name)


def _train_with_id(spark: SparkSession, folder: str) -> DataFrame:
    return read_with_row_id(spark, folder).where(F.col("split") == "train").drop("split")


def _tsv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_tsv(spark, f"{folder.rstrip('/')}/{name}.tsv", CATEGORY_FILE)


DATASETS: dict[str, Dataset] = {
    "toxigen": Dataset(
        "generation",
        "prompt_label",
        lambda s, d: toxigen(_config(s, d, "train", "train"), _config(s, d, "annotated", "test")),
    ),
    "toxigen_human": Dataset(
        "text",
        "label",
        lambda s, d: (
            annotations(_config(s, d, "annotated", "train")),
            annotations(_config(s, d, "annotated", "test")),
        ),
    ),
    "toxigen_raw": Dataset(
        "generation",
        "prompt_label",
        lambda s, d: toxigen_raw(_config(s, d, "train", "train"), _config(s, d, "annotated", "test")),
    ),
    "toxigen_preference": Dataset(
        "prompt", "prompt_label", lambda s, d: toxigen_preference(_train_with_id(s, f"{d.rstrip('/')}/train"))
    ),
    "twitter": Dataset("tweet", "label", lambda s, d: twitter(_train_with_id(s, d))),
    "tweets": Dataset("tweet", "label", lambda s, d: tweets_stratified(_train_with_id(s, d))),
    "berkeley": Dataset("text", "hate_speech_score", lambda s, d: berkeley(_train_with_id(s, d))),
    "gender": Dataset(
        "Text", "Label", lambda s, d: gender(_split_of(s, d, "train"), _split_of(s, d, "test"))
    ),
    "cad": Dataset(
        "text", "labels", lambda s, d: cad(_tsv(s, d, "train"), _tsv(s, d, "dev"), _tsv(s, d, "test"))
    ),
}


def load(spark: SparkSession, name: str, folder: str) -> Pair:
    """``(train, validation)`` of a registered dataset stored below ``folder``.

    Parquet datasets are folders partitioned by ``split`` (below a folder per
    configuration where there are several); category files are
    ``train.tsv``, ``dev.tsv`` and ``test.tsv``.
    """
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name].read(spark, folder)
