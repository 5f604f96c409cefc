"""Array expressions: arg-max, fixed-length padding, masks and term counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """Index of the largest value, the first one on ties; null for null or empty."""
    return (F.array_position(values, F.array_max(values)) - F.lit(1)).cast("int")


def fix_length(ids: Column, length: Column | int, pad_id: int = 0) -> Column:
    """Cut to ``length`` and pad on the right with ``pad_id``."""
    length = F.lit(length) if isinstance(length, int) else length
    kept = F.slice(ids, F.lit(1), length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), length - F.size(kept)))


def attention_mask(ids: Column, length: Column | int) -> Column:
    """1 for each kept id, then 0; the mask, not the pad id, tells padding apart."""
    length = F.lit(length) if isinstance(length, int) else length
    used = F.least(F.size(ids), length)
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), length - used))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even inside other lambdas.

    A derived column can be copied into each place that uses it, also into a
    lambda that runs per element; a bound variable cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, counted inside the row.

    The tokens are sorted and run-length coded, so no shuffle is needed.
    """

    def runs(words: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1),
            lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
        )
        return let(
            F.when(F.size(words) > 0, starts).otherwise(F.array().cast("array<int>")),
            lambda firsts: F.transform(
                firsts,
                lambda first, k: F.struct(
                    F.get(words, first).alias("term"),
                    (F.coalesce(F.get(firsts, k + 1), F.size(words)) - first).cast("bigint").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)
