"""Vocabulary and fixed-length encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.functions import arrays as ar
from moderata.functions import text as tx
from moderata.operators import terms
from moderata.operators.joins import BROADCAST_ROWS, ROWS_PER_TASK, lookup_join
from moderata.operators.ranking import with_position

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2

# Length and batch budget, plain and with retrieved context.
PLAIN_LENGTH, PLAIN_BATCH = 256, 16
RETRIEVAL_LENGTH, RETRIEVAL_BATCH = 256 + 1024, 8


def build_vocabulary(
    df: DataFrame, text: str = "text", max_vocab: int | None = None, first_id: int = FIRST_ID
) -> DataFrame:
    """All tokens with their counts and ids by rank; ties by token.

    Counts are combined before the shuffle and ranks are given in range partitions.
    ``max_vocab`` asks for the most frequent tokens only.
    """
    counts = (
        terms.occurrences(df, text)
        .groupBy(F.col("term").alias("token"))
        .agg(F.sum("tf").alias("n"))
    )
    if max_vocab is not None:
        counts = counts.orderBy(F.col("n").desc(), "token").limit(max_vocab)
    ranked = with_position(counts.withColumn("_rarity", -F.col("n")), ["_rarity", "token"], name="_rank")
    return ranked.select("token", "n", (F.col("_rank") + F.lit(first_id - 1)).cast("int").alias("token_id"))


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    row_id: str,
    text: str = "text",
    carry: Sequence[str] = (),
    max_length: int = PLAIN_LENGTH,
    pad_id: int = PAD_ID,
    unknown_id: int = UNKNOWN_ID,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``row_id, carry, input_ids, attention_mask``, both arrays ``max_length`` long.

    Tokens are cut to ``max_length`` before they become rows, so a row's group is
    bounded; the ids are put together again in the task that split them and only
    whole arrays are shuffled. ``row_id`` must be unique.
    """
    vocabulary = vocabulary.select(F.col("token").alias("_token"), "token_id")
    pieces = df.select(
        row_id,
        *carry,
        F.posexplode_outer(F.slice(tx.tokens(F.col(text)), 1, max_length)).alias("_at", "_token"),
    )
    known = lookup_join(
        pieces,
        vocabulary,
        ["_token"],
        row_id=[row_id],
        how="left",
        broadcast_rows=broadcast_rows,
        rows_per_task=rows_per_task,
    )
    token_id = F.coalesce(F.col("token_id"), F.lit(unknown_id)).cast("int")
    entry = F.when(F.col("_token").isNotNull(), F.struct("_at", token_id.alias("id")))
    ids = (
        known.groupBy(row_id, *carry)
        .agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
        .withColumn("_ids", F.col("_entries.id"))
    )
    return ids.select(
        row_id,
        *carry,
        ar.fix_length(F.col("_ids"), max_length, pad_id).alias("input_ids"),
        ar.attention_mask(F.col("_ids"), max_length).alias("attention_mask"),
    )


def budget(with_retrieval: Column) -> tuple[Column, Column]:
    """Token length and batch size for a row, by mode."""
    length = F.when(with_retrieval, F.lit(RETRIEVAL_LENGTH)).otherwise(F.lit(PLAIN_LENGTH))
    batch = F.when(with_retrieval, F.lit(RETRIEVAL_BATCH)).otherwise(F.lit(PLAIN_BATCH))
    return length, batch
