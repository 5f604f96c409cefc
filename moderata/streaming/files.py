"""File streams through the row-wise operators.

Label rules, null filters, text rendering, HTML and chunking work on one row at
a time and accept a streaming table as it is. Operators that count, rank or join
run per micro-batch through :func:`process_batches`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from moderata.session import new_folder


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    names: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """New Parquet files below ``folder`` whose name matches ``names``, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def append_stream(
    df: DataFrame,
    path: str,
    transform: Callable[[DataFrame], DataFrame],
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Apply a row-wise ``transform`` to what has arrived and append it to ``path``."""
    return (
        df.transform(transform)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or new_folder(df.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )


def merge_batches(
    df: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame], checkpoint: str | None = None
) -> StreamingQuery:
    """Run a grouped ``transform`` on each micro-batch and keep its rows in ``path``, once whatever is replayed.

    For operators that count, rank or join inside what has arrived, such as scoring or top-k retrieval of new rows.
    """
    return process_batches(df, lambda batch, number: merge_batch(batch.transform(transform), number, path), checkpoint)


def merge_batch(rows: DataFrame, number: int, path: str) -> None:
    """The rows of one micro-batch take the place of what the same batch wrote before.

    A batch has a folder of its own, named by its number. A batch that failed half way or is run again after a
    restart overwrites its folder alone, so the table is as after one run.
    """
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def process_batches(
    df: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Hand what has arrived to ``handle(batch, batch_id)`` as ordinary tables."""
    return (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or new_folder(df.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
