"""Quality classifier: cumulative-link regression on graded ratings.

One score per text, a sum of weights of its hashed words, word beginnings and shapes, is
compared with ordered thresholds: ``P(grade <= k) = logistic(threshold_k - score)``. The
weights are shared by all grades. A feature enters scaled by what it tells about a grade
on its own, shrunken towards nothing for rare ones, so chance words carry no weight.
The expected grade and the probability of the highest grades decide which documents are
selected.

The model is fitted on at most ``MAX_LABELLED`` labelled rows, chosen by a hash of their
id; every document is scored, as a whole text, without a shuffle.

Defined results: a text without words is never selected and has grade 0; labels without a
document or a grade are left out, as are all but one of a document's; with no labels, or
only one grade among them, thresholds keep their start; repeated rows are scored
one by one; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata.llm.common import forget, fresh, ship

N_GRADES = 3
N_FEATURES = 1 << 18
MAX_LABELLED = 12_000
MIN_TAIL = 0.5
STEPS = 150
RATE = 1.0
DECAY = 1e-3
# Rows that a feature must outweigh, and the log-odds below which it is left out.
PRIOR_ROWS = 10
MIN_LOG_ODDS = 1.0

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER = bytes(range(0x41, 0x5B))
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'-")
_BOUNDS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95)


def grades(quality: Column, toxic: Column) -> Column:
    """0 for low quality, 1 for toxic text of good quality, 2 for the rest; null if unrated."""
    good = (quality == 1) & (toxic == 0)
    return F.when(quality == 0, F.lit(0)).when(toxic == 1, F.lit(1)).when(good, F.lit(2))


def _shape(text: bytes, words: list[bytes]) -> list[bytes]:
    """Names of ranges in which the share of capitals, signs, distinct windows and the word length fall."""
    n = len(words)
    shares = {
        b"capitals": 1 - len(text.translate(None, _UPPER)) / max(1, len(text)),
        b"signs": 1 - len(text.translate(None, _SIGNS)) / max(1, len(text)),
        b"windows": len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
        b"length": min(1.0, sum(map(len, words)) / max(1, n) / 20),
    }
    return [b"%s\x00%d" % (name, sum(share >= b for b in _BOUNDS)) for name, share in shares.items()]


def features(text: str | None) -> np.ndarray:
    """Numbers of the features of a text, ascending; none if it has no words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.empty(0, dtype=np.int32)
    distinct = set(_WORDS.findall(raw.lower()))
    begins = {b"^" + w[:4] for w in distinct if len(w) > 5}
    names = (*distinct, *begins, *_shape(raw, words))
    return np.unique(np.fromiter((zlib.crc32(w) % N_FEATURES for w in names), dtype=np.int32, count=len(names)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        numbers = features(text)
        return float(self.weights[numbers].sum(dtype=np.float64)) if len(numbers) else math.nan

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for every threshold ``k``, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def log_odds(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """How far a feature alone moves the odds of some threshold, shrunken by ``PRIOR_ROWS``."""
    seen = np.zeros((N_GRADES, N_FEATURES))
    for numbers, grade in zip(rows, labels, strict=True):
        seen[grade, numbers] += 1
    total = np.bincount(labels, minlength=N_GRADES)
    moved = np.zeros(N_FEATURES)
    for k in range(1, N_GRADES):
        share = total[:k].sum() / total.sum()
        if 0 < share < 1:
            own = (seen[:k].sum(axis=0) + PRIOR_ROWS * share) / (seen.sum(axis=0) + PRIOR_ROWS)
            own = np.clip(own, 1e-9, 1 - 1e-9)
            moved = np.maximum(moved, np.abs(np.log(own / (1 - own)) - math.log(share / (1 - share))))
    return moved


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with decayed weights, by Adam over all rows at once.

    The first threshold is free and each further one lies a positive step above.
    """
    weights, raw = np.zeros(N_FEATURES), np.zeros(N_GRADES - 1)
    if not rows:
        return Model(weights.astype(np.float32), _ordered(raw))
    scale = log_odds(rows, labels)
    scale[scale < MIN_LOG_ODDS] = 0.0
    # Feature 0 stands in for a row of which nothing is left.
    kept = [r[scale[r] > 0] for r in rows]
    kept = [r if len(r) else np.zeros(1, dtype=np.int32) for r in kept]
    sizes = np.array([len(r) for r in kept])
    numbers = np.concatenate(kept)
    values = scale[numbers]
    owner = np.repeat(np.arange(len(kept)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Only features that occur are moved.
    used, local = np.unique(numbers, return_inverse=True)
    state = np.zeros(len(used) + len(raw))
    first, second = np.zeros_like(state), np.zeros_like(state)
    slope = lambda p: p * (1 - p)
    for step in range(1, steps + 1):
        weight, raw = state[: len(used)], state[len(used) :]
        score = np.add.reduceat(values * weight[local], starts)
        bounds = np.concatenate([[-np.inf], _ordered(raw), [np.inf]])
        above, below = _logistic(bounds[labels + 1] - score), _logistic(bounds[labels] - score)
        likely = np.maximum(above - below, 1e-12)
        d_score = (slope(above) - slope(below)) / likely / len(kept)
        d_bounds = np.array(
            [
                (np.sum((slope(below) / likely)[labels == k + 1]) - np.sum((slope(above) / likely)[labels == k]))
                / len(kept)
                for k in range(N_GRADES - 1)
            ]
        )
        d_raw = np.cumsum(d_bounds[::-1])[::-1].copy()
        d_raw[1:] *= np.exp(raw[1:])
        d_weight = np.bincount(local, weights=values * d_score[owner], minlength=len(used)) + DECAY * weight
        gradient = np.concatenate([d_weight, d_raw])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
        # Thresholds go slower than the weights of single features.
        move[len(used) :] *= 0.1
        state = state - RATE * (1 - (step - 1) / steps) * move
    weights[used] = state[: len(used)] * scale[used]
    return Model(weights.astype(np.float32), _ordered(state[len(used) :]))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -500, 500)))


def _ordered(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality, toxic)``.

    At most ``max_labelled`` labelled documents, the first in order of a hash of their
    id, send their feature numbers to the driver.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def extracted(texts: pd.Series) -> pd.Series:
        forget()
        return texts.map(features)

    # Else the filter on its size would run it a second time.
    extracted = extracted.asNondeterministic()
    rated = labels.select("doc_id", grades(F.col("quality"), F.col("toxic")).alias("grade")).where(
        F.col("doc_id").isNotNull() & F.col("grade").isNotNull()
    )
    order = F.xxhash64("doc_id")
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(order, "doc_id").limit(max_labelled)
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``max_labelled`` rows
        .select("doc_id", "grade", extracted("text").alias("numbers"))
        .where(F.size("numbers") > 0)
        .dropDuplicates(["doc_id"])
        .toArrow()
        .sort_by("doc_id")
    )
    rows = [np.asarray(n.values, dtype=np.int32) for n in sample["numbers"]]
    return fit_rows(rows, np.asarray(sample["grade"], dtype=np.int64))


def score(text: Column, model: Model, spark_context: object) -> Column:
    """Score of a text; NaN if it has no words."""
    shared = spark_context.broadcast(model.weights)  # 1 MB

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        forget()
        own = Model(shared.value, np.zeros(0))
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return scored(text)


def with_grades(docs: DataFrame, model: Model, min_tail: float = MIN_TAIL) -> DataFrame:
    """``docs`` plus ``expected_grade``, ``p_at_least_1``, ``p_at_least_2`` and ``kept``."""
    ship(docs.sparkSession)
    name = fresh(docs, "_score")
    scored = docs.withColumn(name, score(F.col("text"), model, docs.sparkSession.sparkContext))
    blank = F.isnan(name)
    tails = [
        F.when(blank, F.lit(0.0)).otherwise(1 / (1 + F.exp(F.lit(float(t)) - F.col(name)))) for t in model.thresholds
    ]
    named = {f"p_at_least_{k + 1}": tail for k, tail in enumerate(tails)}
    made = {"expected_grade": sum(tails, F.lit(0.0)), **named, "kept": tails[-1] >= min_tail}
    return scored.withColumns(made).drop(name)


def select(docs: DataFrame, labels: DataFrame, min_tail: float = MIN_TAIL, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose probability of the best grade is at least ``min_tail``."""
    graded = with_grades(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"),
                         fit(docs, labels, max_labelled), min_tail)
    return graded.where("kept").select("row.*")
