"""Unpaired and paired preference rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.functions import labels as lb
from moderata.functions import text as tx
from moderata.operators.joins import BROADCAST_ROWS, ROWS_PER_TASK, lookup_join
from moderata.operators.ranking import with_next, with_position

# Length limits of a preference row and the two example weights.
MAX_PROMPT_LENGTH = 256
MAX_LENGTH = 256
DESIRABLE_WEIGHT = 1.0
UNDESIRABLE_WEIGHT = 1.0


def conversation_heads(turns: DataFrame) -> DataFrame:
    """Per conversation: the system text, the first user text and the number of turns."""
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    return turns.groupBy("conv_id").agg(
        first("system").alias("system"), first("user").alias("first_user"), F.count(F.lit(1)).alias("_turns")
    )


def with_heads(
    rows: DataFrame,
    turns: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``system`` and ``first_user`` of the conversation to rows with ``conv_id, turn``.

    Rows without a ``conv_id`` are one conversation, as they are in :func:`turn_pairs`.
    """
    # A null id is a value of the key.
    key = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"))
    joined = lookup_join(
        rows.withColumn("_conv", F.to_json(key)),
        conversation_heads(turns).withColumn("_conv", F.to_json(key)).drop("conv_id"),
        ["_conv"],
        row_id=["turn"],
        matches="_turns",
        broadcast_rows=broadcast_rows,
        rows_per_task=rows_per_task,
    )
    return joined.drop("_conv")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right behind it.

    ``conv_id, turn, prompt, completion``, where ``turn`` is that of the answer.
    """
    ahead = with_next(turns, "conv_id", "turn", ["role", "text", "turn"])
    return ahead.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        "conv_id",
        F.col("next_turn").alias("turn"),
        F.col("text").alias("prompt"),
        F.col("next_text").alias("completion"),
    )


def unpaired(
    df: DataFrame,
    prompt: str = "prompt",
    completion: str = "completion",
    label: str = "label",
    system: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``prompt, completion, label``: system message + text, completion, boolean label."""
    start = tx.system_prefix(F.col(system)) if system else F.lit("")
    return df.select(
        *carry,
        F.concat(start, F.col(prompt)).alias("prompt"),
        F.col(completion).alias("completion"),
        lb.as_bool(F.col(label)).alias("label"),
    )


def weights(
    label: Column, desirable: float = DESIRABLE_WEIGHT, undesirable: float = UNDESIRABLE_WEIGHT
) -> Column:
    """Example weight by label."""
    return F.when(label, F.lit(float(desirable))).otherwise(F.lit(float(undesirable)))


def with_lengths(
    df: DataFrame, max_prompt_length: int = MAX_PROMPT_LENGTH, max_length: int = MAX_LENGTH
) -> DataFrame:
    """Token counts of a preference row after the prompt and the total limit.

    The prompt is cut to ``max_prompt_length`` (and never above ``max_length``),
    the completion to what is left of ``max_length``; ``truncated`` says whether
    anything was cut.
    """
    return (
        df.withColumn("_p", F.size(tx.tokens(F.col("prompt"))))
        .withColumn("_c", F.size(tx.tokens(F.col("completion"))))
        .withColumn("prompt_len", F.least("_p", F.lit(min(max_prompt_length, max_length))))
        .withColumn("completion_len", F.least("_c", F.lit(max_length) - F.col("prompt_len")))
        .withColumn(
            "truncated", (F.col("prompt_len") < F.col("_p")) | (F.col("completion_len") < F.col("_c"))
        )
        .drop("_p", "_c")
    )


def pair(
    df: DataFrame,
    order_by: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Unpaired rows to pairs of one good and one bad completion of the same prompt.

    Completions are paired in order; the shorter side is gone through again
    until the longer side is used up. Every completion of a prompt that has both
    labels occurs, and the number of pairs is that of the longer side, not the
    product of both. ``order_by`` must be unique.
    """
    rows = df.select("prompt", "completion", "label", *order_by).where(
        F.col("prompt").isNotNull() & F.col("label").isNotNull()
    )
    placed = with_position(rows, order_by, group_by=["prompt", "label"], name="_place")
    good = F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0))
    sizes = (
        placed.groupBy("prompt")
        .agg(good.alias("_good"), F.count(F.lit(1)).alias("_all"))
        .withColumn("_bad", F.col("_all") - F.col("_good"))
        .where((F.col("_good") > 0) & (F.col("_bad") > 0))
    )
    sized = lookup_join(
        placed,
        sizes,
        ["prompt"],
        row_id=order_by,
        matches="_all",
        broadcast_rows=broadcast_rows,
        rows_per_task=rows_per_task,
    )
    short = F.least("_good", "_bad")
    is_long = F.col("label") == (F.col("_good") >= F.col("_bad"))
    slots = sized.withColumn("_slot", F.pmod(F.col("_place") - 1, short))
    longer = slots.where(is_long).select("prompt", "_slot", "completion", "label", *order_by)
    shorter = slots.where(~is_long).select(
        "prompt",
        "_slot",
        F.col("completion").alias("_other"),
        F.ceil(F.greatest("_good", "_bad") / short).alias("_uses"),
    )
    joined = lookup_join(
        longer,
        shorter,
        ["prompt", "_slot"],
        row_id=order_by,
        matches="_uses",
        broadcast_rows=broadcast_rows,
        rows_per_task=rows_per_task,
    )
    return joined.select(
        "prompt",
        F.when(F.col("label"), F.col("completion")).otherwise(F.col("_other")).alias("chosen"),
        F.when(F.col("label"), F.col("_other")).otherwise(F.col("completion")).alias("rejected"),
    )


def render_paired(
    df: DataFrame,
    text: str = "prompt",
    system: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``prompt, chosen, rejected`` with chat markers.

    The prompt is the system message, if any, and the user turn with the
    generation prompt; both answers get the end-of-turn marker.
    """
    start = tx.system_prefix(F.col(system)) if system else F.lit("")
    return df.select(
        *carry,
        F.concat(start, tx.chat_message("user", F.col(text), add_generation_prompt=True)).alias("prompt"),
        F.concat("chosen", F.lit(tx.TURN_END)).alias("chosen"),
        F.concat("rejected", F.lit(tx.TURN_END)).alias("rejected"),
    )


def unpair(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Each pair to two unpaired rows, the chosen one true and the rejected one false."""
    both = F.array(
        F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")),
        F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")),
    )
    return df.select(*carry, "prompt", F.inline(both))
