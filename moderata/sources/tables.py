"""Table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata.functions import text as tx
from moderata.sources.delimited import read_delimited

# Field contents that mean null in a delimited file.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ROW_ID = "row_id"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_with_row_id(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet rows with a stable unique ``row_id``: file path and row number in it.

    It stands for the row index of an in-memory frame and is the same however
    the scan is partitioned or repeated. A stored ``row_id`` is kept: with it a split also stays
    the same when the files are rewritten.
    """
    df = spark.read.parquet(*paths)
    if ROW_ID in df.columns:
        return df
    meta = F.concat_ws(
        ":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")
    )
    return df.withColumn(ROW_ID, meta)


def _null_words(column: Column) -> Column:
    return F.when(~column.isin(*NULL_WORDS), column)


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Tab-separated files with a header; quoted fields may span lines.

    Columns are taken by their names in the header: their order is free, others are
    ignored and a missing one is an error. All files must have the same header.
    Fields are read as text, the usual null words become null, then each column
    is cast to its type in ``schema``. A file of any size is read by many tasks.
    """
    df = read_delimited(spark, path)
    return df.select(
        *[_null_words(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def page_documents(pages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Crawled pages ``(page_id, url, html)`` to documents ``(doc_id, url, text)``.

    With ``seeds(url)`` only the listed pages are kept (semi join).
    """
    if seeds is not None:
        pages = pages.join(seeds.select("url"), "url", "left_semi")
    return pages.select(
        F.col("page_id").alias("doc_id"), "url", tx.html_to_text(F.col("html")).alias("text")
    )
