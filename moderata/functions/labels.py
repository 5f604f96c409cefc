"""Label rules: thresholds, categories and casts with exact null and NaN behaviour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and the negative category of the known datasets.
SCORE_SUM_THRESHOLD = 5.5
SCORE_THRESHOLD = 0.5
NEGATIVE_CATEGORY = "Neutral"


def above(score: Column, threshold: float) -> Column:
    """1 where ``score`` is strictly above ``threshold``; null and NaN give 0.

    Spark orders NaN above every number, so NaN is excluded by hand.
    """
    score = score.cast("double")
    return F.coalesce(~F.isnan(score) & (score > F.lit(float(threshold))), F.lit(False)).cast("bigint")


def sum_above(first: Column, second: Column, threshold: float = SCORE_SUM_THRESHOLD) -> Column:
    """1 where the two scores add up to strictly more than ``threshold``; missing gives 0."""
    return above(first.cast("double") + second.cast("double"), threshold)


def differs(category: Column, negative: str = NEGATIVE_CATEGORY) -> Column:
    """1 where ``category`` is not ``negative``; a missing category counts as different."""
    return (~category.eqNullSafe(F.lit(negative))).cast("bigint")


def as_int(label: Column) -> Column:
    """Label as bigint; text that is no number gives null instead of an error."""
    return label.try_cast("bigint")


def as_bool(label: Column) -> Column:
    """Label as boolean, non-zero is true."""
    return label.cast("boolean")
