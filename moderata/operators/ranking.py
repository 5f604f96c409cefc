"""Seeded order, exact splits, positions and batches without a one-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moderata.operators.joins import BROADCAST_ROWS, checked_broadcast
from moderata.session import settle

# 4 hex digits = 65,536 buckets of equal expected size: at 100 billion rows one
# bucket holds about 1.5 million keys.
PREFIX_DIGITS = 4
# Hex digits of a key, and how many keys are sorted at the end of a selection.
KEY_DIGITS = 32
FEW_KEYS = 1024


def order_key(row_id: str | Column, seed: int = 42) -> Column:
    """Seeded random order key; depends on the seed and the id only."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"))


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], broadcast: bool = False) -> DataFrame:
    """Inner join on ``on`` in which null keys match each other, as they do in a window."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    right = checked_broadcast(right) if broadcast else right
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(right, same).drop(*[f"_right_{c}" for c in on])


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """1-based rank of each row in a total order, also inside groups of any size.

    The rows are range-partitioned on ``group_by + order_by`` together, so one
    huge group spreads over many tasks; a row's rank is its place in its
    partition plus the rows of its group in earlier partitions. The sorted rows
    are settled, because the partition borders are sampled and must not move
    when a stage is run again. Pass only the columns needed; ``order_by`` must
    be unique inside a group. Rows with a null group are a group too.
    """
    group_by, order_by = list(group_by), list(order_by)
    ordered = df.repartitionByRange(*group_by, *order_by).sortWithinPartitions(*group_by, *order_by)
    placed = settle(
        ordered.withColumn("_row_at", F.monotonically_increasing_id()).withColumn(
            "_row_block", F.shiftright("_row_at", 33)
        )
    )
    earlier = (
        Window.partitionBy(*group_by).orderBy("_row_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (group, partition): at most partitions + groups rows.
    starts = settle(
        placed.groupBy(*group_by, "_row_block")
        .agg(F.count(F.lit(1)).alias("_row_n"), F.min("_row_at").alias("_row_first"))
        .withColumn("_row_before", F.coalesce(F.sum("_row_n").over(earlier), F.lit(0)))
        .drop("_row_n")
    )
    return (
        _join_null_safe(placed, starts, [*group_by, "_row_block"], broadcast=True)
        .withColumn(name, F.col("_row_before") + F.col("_row_at") - F.col("_row_first") + 1)
        .drop("_row_at", "_row_block", "_row_first", "_row_before")
    )


def shuffle_positions(df: DataFrame, row_id: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Ids in seeded random order with their position in it."""
    keyed = df.select(row_id, order_key(row_id, seed).alias("_key"))
    return with_position(keyed, ["_key", row_id], name=name).drop("_key")


def write_shuffled(df: DataFrame, row_id: str, path: str, seed: int = 42) -> None:
    """Write the rows in seeded random order: file order, then row order."""
    keyed = df.withColumn("_key", order_key(row_id, seed))
    keyed.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key").write.mode(
        "overwrite"
    ).parquet(path)


def with_split(
    df: DataFrame,
    row_id: str,
    test_size: float,
    seed: int = 42,
    name: str = "is_test",
    group_by: str | None = None,
    prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Mark exactly ``ceil(test_size * n)`` rows as test, the rest as train.

    The rows themselves are never shuffled. The last test key is found digit by digit, as in a radix
    selection: counts per next ``prefix_digits`` digits of the key (at most ``16 ** prefix_digits`` rows) say in which
    prefix the cut falls, and that prefix is counted further until it holds at most ``FEW_KEYS`` keys. The result
    compares each row's key with that one value, so using it again costs nothing.
    ``row_id`` must be unique; a null one is an error.

    With ``group_by`` the key is taken from that column, so equal values stay on
    one side; the cut is then a share of the key range and sizes are approximate.
    """
    if group_by is not None:
        # 15 hex digits of the key as a number, against the same share of their range.
        key = order_key(group_by, seed)
        place = F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")
        return df.withColumn(name, place < F.lit(int(test_size * 16**15)))

    key = order_key(row_id, seed)
    keys = df.select(key.alias("_key"))
    sizes = _prefix_sizes(keys, "", prefix_digits)
    if None in sizes:
        raise ValueError(f"{sizes[None]} rows have no {row_id}, so they have no place in a split")
    need = math.ceil(float(test_size) * sum(sizes.values()))
    if not need:
        return df.withColumn(name, F.lit(False))
    prefix = ""
    while True:
        for digits in sorted(sizes):
            if need <= sizes[digits]:
                break
            need -= sizes[digits]
        prefix += digits
        if len(prefix) >= KEY_DIGITS or sizes[digits] <= FEW_KEYS:
            break
        sizes = _prefix_sizes(keys, prefix, prefix_digits)
    last = prefix
    if len(prefix) < KEY_DIGITS:
        few = sorted(r["_key"] for r in keys.where(F.startswith("_key", F.lit(prefix))).collect())
        last = few[need - 1]
    return df.withColumn(name, F.coalesce(key <= F.lit(last), F.lit(False)))


def _prefix_sizes(keys: DataFrame, prefix: str, digits: int) -> dict[str | None, int]:
    """Rows by the next digits of their key, of those that begin with ``prefix``; at most ``16 ** digits`` entries."""
    if prefix:
        keys = keys.where(F.startswith("_key", F.lit(prefix)))
    counts = keys.groupBy(F.substring("_key", len(prefix) + 1, digits).alias("_digits")).count()
    return {r["_digits"]: r["count"] for r in counts.collect()}


def split(df: DataFrame, row_id: str, test_size: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of :func:`with_split`."""
    marked = with_split(df, row_id, test_size, seed, name="_is_test")
    return (
        marked.where(~F.col("_is_test")).drop("_is_test"),
        marked.where(F.col("_is_test")).drop("_is_test"),
    )


def with_stratified_split(
    df: DataFrame,
    row_id: str,
    stratum: str,
    test_size: float,
    seed: int = 42,
    name: str = "is_test",
    prefix_digits: int = PREFIX_DIGITS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Mark ``ceil(test_size * n)`` rows as test, shared out over the strata.

    Each stratum gets its proportional share rounded down; the rows left over go
    to the largest remainders, ties by stratum. As in :func:`with_split` only
    the bucket holding a stratum's cut is ranked, so a stratum of any size is
    spread over tasks.
    """
    key = order_key(row_id, seed)
    keys = df.where(F.col(stratum).isNotNull()).select(
        stratum, key.alias("_key"), F.substring(key, 1, prefix_digits).alias("_bucket")
    )
    counts = settle(keys.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("_n")))

    whole = Window.partitionBy()
    total = F.sum("_size").over(whole)
    wanted = F.ceil(F.lit(float(test_size)) * total).cast("decimal(19,0)")
    share = (F.col("_size").cast("decimal(19,0)") * wanted).cast("decimal(38,0)")
    by_remainder = Window.orderBy(F.col("_rest").desc(), F.col(stratum))
    quotas = (
        counts.groupBy(stratum)
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_wanted", wanted)
        .withColumn("_rest", F.pmod(share, total.cast("decimal(38,0)")))
        .withColumn("_base", ((share - F.col("_rest")) / total.cast("decimal(38,0)")).cast("bigint"))
        .withColumn("_left", F.col("_wanted").cast("bigint") - F.sum("_base").over(whole))
        .withColumn(
            "_quota",
            F.col("_base") + (F.row_number().over(by_remainder) <= F.col("_left")).cast("bigint"),
        )
        .select(stratum, "_quota")
    )
    running = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        counts.withColumn("_upto", F.sum("_n").over(running))
        .join(quotas, stratum)
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(stratum, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    cuts = checked_broadcast(settle(cuts), broadcast_rows)
    in_bucket = Window.partitionBy(stratum, "_bucket").orderBy("_key")
    last_keys = settle(
        keys.join(cuts, [stratum, "_bucket"])
        .withColumn("_rank", F.row_number().over(in_bucket))
        .where(F.col("_rank") == F.col("_need"))
        .select(stratum, F.col("_key").alias("_last"))
    )
    return (
        df.join(checked_broadcast(last_keys, broadcast_rows), stratum, "left")
        .withColumn(name, F.coalesce(key <= F.col("_last"), F.lit(False)))
        .drop("_last")
    )


def with_batch(
    df: DataFrame, order_by: Sequence[str], batch_size: int, name: str = "batch_id"
) -> DataFrame:
    """Sequential batches of ``batch_size`` rows in the given order; the last may be short."""
    ranked = with_position(df, order_by, name="_position")
    return ranked.withColumn(
        name, F.floor((F.col("_position") - 1) / F.lit(batch_size)).cast("bigint")
    ).drop("_position")


def with_next(df: DataFrame, group_by: str, order_by: str, columns: Sequence[str]) -> DataFrame:
    """Add ``next_<column>`` from the following row of the group, null at its end.

    Rows are range-partitioned by group and order, so a group of any size and any spread of values is on
    many tasks. A window looks ahead inside a partition; the last row of a group in a partition takes the
    group's first row in the next partition that has one, from a table with one row per group and
    partition. ``order_by`` must be unique inside a group. Rows with a null group are a group too.
    """
    row = F.struct(*[F.col(c) for c in columns])
    ordered = df.repartitionByRange(group_by, order_by).withColumn("_block", F.spark_partition_id())
    placed = settle(ordered)
    ahead = Window.partitionBy(group_by, "_block").orderBy(order_by)
    inside = placed.withColumn("_next", F.lead(row).over(ahead))
    following = Window.partitionBy(group_by).orderBy("_block")
    # At most partitions + groups rows.
    heads = placed.groupBy(group_by, "_block").agg(F.min_by(row, F.col(order_by)).alias("_head"))
    stitched = heads.withColumn("_head", F.lead("_head").over(following)).where(F.col("_head").isNotNull())
    stitched = stitched.withColumnsRenamed({group_by: "_right_group", "_block": "_right_block"})
    same = F.col(group_by).eqNullSafe(F.col("_right_group")) & (F.col("_block") == F.col("_right_block"))
    joined = inside.join(checked_broadcast(settle(stitched)), same, "left")
    following_row = F.coalesce("_next", "_head")
    added = {f"next_{c}": following_row[c] for c in columns}
    return joined.withColumns(added).drop("_right_group", "_right_block", "_block", "_next", "_head")
