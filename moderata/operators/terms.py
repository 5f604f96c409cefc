"""The term table: each text is split into tokens once, and every operator on terms reads the counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from moderata.functions import arrays as ar
from moderata.functions import text as tx
from moderata.session import settle


def _is_counted(df: DataFrame, columns: Sequence[str]) -> bool:
    return len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, ArrayType)


def counts(df: DataFrame, text: str | Sequence[str]) -> Column:
    """``array<struct<term, tf>>`` of a row, sorted by term.

    ``text`` names a column of a term table, which is taken as it is, or text columns,
    which are joined by a blank and split here. The terms of one null text are null.
    """
    columns = [text] if isinstance(text, str) else list(text)
    if _is_counted(df, columns):
        return F.col(columns[0])
    if len(columns) == 1:
        content = F.col(columns[0])
        return F.when(content.isNotNull(), ar.term_counts(tx.tokens(content)))
    return ar.term_counts(tx.tokens(F.concat_ws(" ", *columns)))


def distinct(df: DataFrame, text: str | Sequence[str]) -> Column:
    """The terms of a row, each once; an empty array for null."""
    columns = [text] if isinstance(text, str) else list(text)
    if _is_counted(df, columns):
        return F.coalesce(F.col(columns[0])["term"], F.array().cast("array<string>"))
    return F.array_distinct(tx.tokens(F.concat_ws(" ", *columns)))


def occurrences(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep, term, tf`` to be added up: a row per term of a term table, or per token of a text column.

    Where sums follow, counting inside the row first costs more than the map-side sums save.
    """
    if _is_counted(df, [text]):
        return df.select(*keep, F.inline(text))
    return df.select(*keep, F.explode(tx.tokens(F.col(text))).alias("term"), F.lit(1).cast("bigint").alias("tf"))


def term_table(
    df: DataFrame, row_id: str, text: str | Sequence[str] = "text", carry: Sequence[str] = (), name: str = "terms"
) -> DataFrame:
    """``row_id, carry, terms`` in the shared folder, one row per row of ``df``.

    The counts stay in their row, so reading them needs no shuffle, and texts are not read again
    by term weights, vectors, vocabularies or classifiers that are given ``text="terms"``.
    """
    return settle(df.select(row_id, *carry, counts(df, text).alias(name)))
