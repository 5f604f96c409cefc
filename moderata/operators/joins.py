"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.session import settle

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 4_000_000
NULL_PARTS = 1024
# Keys that a sketch tracks, and how many of the heaviest it names.
TRACKED = 10_000
HEAVY = 1_000


def _width(name: str, kind: str) -> Column:
    """Bytes of a value: texts and binary by their own length, nested values by their JSON."""
    column = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(16)


def fits(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a settled table is small in rows and in bytes of its values.

    Rows are counted first, so the texts of a large table are not read.
    """
    if table.count() > max_rows:
        return False
    width = [_width(c, kind) for c, kind in table.dtypes]
    size = table.select(F.sum(reduce(add, width).cast("bigint"))).first()[0] or 0
    return size <= max_bytes


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a settled table only if it is small."""
    return F.broadcast(small) if fits(small, max_rows) else small


def heavy_keys(facts: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> dict[int, int]:
    """Hash of the keys that hold more than ``rows_per_task`` of ``facts``, and over how many tasks to deal each.

    A heavy-hitter sketch counts the facts themselves: every task keeps at most ``TRACKED`` keys, the sketches
    are merged, and the driver gets at most ``TRACKED`` of them. A key with more than about ``rows / TRACKED`` facts
    cannot be missed, a null key and one that no lookup knows included.
    """
    sketch = F.expr(f"approx_top_k(_key, {HEAVY}, {TRACKED})")
    top = facts.select(F.xxhash64(*on).alias("_key")).agg(sketch.alias("top")).first()["top"]
    return {t["item"]: -(-t["count"] // rows_per_task) for t in top or [] if t["count"] > rows_per_task}


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    row_id: Sequence[str | Column],
    matches: str | None = None,
    common: str | None = None,
    how: str = "inner",
    settled: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join many ``facts`` to a ``lookup`` table with one row per key.

    The lookup is settled first (unless ``settled`` says that it is a stored table already), so its size is known:

    * up to ``broadcast_rows`` rows and ``BROADCAST_BYTES`` it is broadcast and the facts do not move;
    * beyond that the facts of a key with more than ``rows_per_task`` of them are dealt by a hash of ``row_id``
      over several tasks, and only that key's lookup row is repeated. The heavy keys are found by
      :func:`heavy_keys`, which reads the facts' keys once more.

    ``matches`` names a lookup column that says how many facts share the key, where that has been counted; it is
    dropped from the result and spares the sketch. ``common`` names one that only says which keys facts are likely to have; it is
    dropped too. Then as many of the most common keys as may be broadcast are, and only facts of the
    others move (:func:`_common_apart`). Facts with a null key match nothing and are
    dealt over ``NULL_PARTS`` then.
    """
    on = list(on)
    lookup = lookup if settled else settle(lookup)
    if fits(lookup, broadcast_rows):
        return facts.join(F.broadcast(lookup.drop(*[c for c in (matches, common) if c])), on, how)
    if common is not None:
        return _common_apart(facts, lookup, on, row_id, common, how, broadcast_rows, rows_per_task)
    if matches is None:
        return _dealt_by_sketch(facts, lookup, on, row_id, how, rows_per_task)

    parts = F.ceil(F.col(matches) / F.lit(rows_per_task)).cast("int")
    lookup = lookup.withColumn("_parts", F.greatest(parts, F.lit(1))).drop(matches)
    # At most ``total matches / rows_per_task`` rows.
    hot = checked_broadcast(settle(lookup.where("_parts > 1").select(*on, "_parts")))
    has_null = reduce(or_, [F.col(c).isNull() for c in on])
    n_parts = F.when(has_null, F.lit(NULL_PARTS)).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = facts.join(hot, on, "left").withColumn(
        "_part",
        F.pmod(F.xxhash64(*row_id), n_parts).cast("int"),
    )
    return _joined_parts(dealt.drop("_parts"), lookup, on, how)


def _dealt_by_sketch(
    facts: DataFrame, lookup: DataFrame, on: list[str], row_id: Sequence[str | Column], how: str, rows_per_task: int
) -> DataFrame:
    heavy = heavy_keys(facts, on, rows_per_task)
    if not heavy:
        return facts.join(lookup, on, how)
    # At most HEAVY entries.
    known = F.create_map(*[F.lit(x).cast("bigint") for pair in sorted(heavy.items()) for x in pair])
    n_parts = F.coalesce(known[F.xxhash64(*on)], F.lit(1)).cast("int")
    dealt = facts.withColumn("_part", F.pmod(F.xxhash64(*row_id), n_parts).cast("int"))
    return _joined_parts(dealt, lookup.withColumn("_parts", n_parts), on, how)


# Steps of a doubling by which the least common key to be broadcast is found.
STEPS = 4


def _common_apart(
    facts: DataFrame, lookup: DataFrame, on: list[str], row_id: Sequence[str | Column], common: str, how: str,
    broadcast_rows: int, rows_per_task: int,
) -> DataFrame:
    """Facts of the most common keys joined where they are, and the others by a shuffle.

    The driver gets a count for each step of a scale, at most some 250 rows.
    """
    step = F.floor(F.log2(F.greatest(F.col(common), F.lit(1)).cast("double")) * STEPS)
    width = reduce(add, [_width(c, kind) for c, kind in lookup.dtypes])
    sizes = lookup.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("size"))
    least, n, size = None, 0, 0
    for row in sorted(sizes.collect(), key=lambda r: -r["step"]):
        n, size = n + row["n"], size + row["size"]
        if n > broadcast_rows or size > BROADCAST_BYTES:
            break
        least = row["step"]
    if least is None:
        return _dealt_by_sketch(facts, lookup.drop(common), on, row_id, how, rows_per_task)
    often = lookup.where(step >= least).drop(common)
    near = facts.join(F.broadcast(often), on)
    apart = facts.join(F.broadcast(often.select(*on)), on, "left_anti")
    rest = lookup.where(step < least).drop(common)
    return near.unionByName(_dealt_by_sketch(apart, rest, on, row_id, how, rows_per_task))


def _joined_parts(dealt: DataFrame, lookup: DataFrame, on: list[str], how: str) -> DataFrame:
    """Facts with a ``_part`` joined to lookup rows that are repeated for each of their ``_parts``."""
    repeated = lookup.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.join(repeated.drop("_parts"), [*on, "_part"], how).drop("_part")
