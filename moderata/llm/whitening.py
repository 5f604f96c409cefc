"""Embedding whitening with covariances by polarisation.

Entries become integers, so every statistic is exact: with ``n`` vectors and their sums ``S`` the
integer deviation of an entry is ``y = n * x - S``. One pass adds up ``(y_i + y_j)^2`` for every pair of
dimensions and ``(2 y_i)^2 = 4 y_i^2`` on the diagonal. A variance of a sum is the sum of both variances
plus twice the covariance, so the differences of these sums are the cross-covariances; no product of two
different entries is ever formed. The matrix goes to ``eigh`` on the driver.

Every pass reads the whole table. A task keeps one number per pair of dimensions and emits it once; Spark
adds them up. What reaches the driver has the size of the matrix, whatever the number of vectors.

Defined results: a vector that is null, empty, holds a null or non-finite entry or one beyond
``LARGEST`` is dropped, and so is one whose length differs from the most frequent length (of equally frequent
ones the longest). Repeated ids and vectors count and return row by row. A component without variance
has a null ``whitened`` and stands outside ``identity_error``, which is null if no component has any. An empty
table gives no rows; other columns are not read. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.llm.common import ship

SCALE = 64
SHIFT = 1_000_000
N_COMPONENTS = 32
# Beyond that a double has no exact integer for 64 times the entry.
LARGEST = 2.0**46
# Rows of a batch that are worked on together, and bits of a limb: 2^20 products of 42 bits fit in a long.
STEP_ROWS = 4096
LIMB = 21
_LONG = 1 << 63

Batches = Iterator[pa.RecordBatch]


@dataclass
class Whitening:
    """``n`` fitted vectors, sums ``s``, unit eigenvectors as columns, all eigenvalues, falling, and the trace."""

    n: int
    s: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Which of the components have variance beyond rounding."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values[: self.vectors.shape[1]] > max(top, 0.0) * len(self.s) * np.finfo(float).eps

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of integer deviations; NaN for components without variance."""
        live = self.live
        scale = np.where(live, np.sqrt(np.where(live, self.values[: len(live)], 1.0)), np.nan)
        return (y.astype(np.float64) / self.n) @ self.vectors / scale


def usable(vector: Column) -> Column:
    """Whether a vector holds finite entries of an exact range only, and at least one."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(LARGEST), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fits, F.lit(False))


def fit_list(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The usable rows of the table's own length, and that length (0 for none)."""
    rows = df.where(usable(F.col(vector)))
    size = F.size(vector).alias("size")
    top = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    return (rows, 0) if top is None else (rows.where(F.size(vector) == top["size"]), top["size"])


def _integers(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n * x - s``; exact as longs modulo 2^64, which is the value itself as long as it fits."""
    if max((abs(v) for v in (n * int(x.max()) - min(s), n * int(x.min()) - max(s))), default=0) >= 1 << 61:
        return n * x.astype(object) - np.array(s, dtype=object)
    wrapped = np.array([v % (1 << 64) for v in s], dtype=np.uint64).astype(np.int64)
    return np.int64(n) * x - wrapped


def squared_sums(z: np.ndarray) -> list[int]:
    """Exact sums of squares of each column."""
    if z.dtype == object:
        return [int(v) for v in (z * z).sum(axis=0)]
    largest = int(np.abs(z).max()) if z.size else 0
    if largest * largest * len(z) < _LONG:
        return np.einsum("rc,rc->c", z, z).tolist()
    mask = (1 << LIMB) - 1
    a, b, c = z >> (2 * LIMB), (z >> LIMB) & mask, z & mask
    dot = lambda p, q: [int(v) for v in np.einsum("rc,rc->c", p, q)]
    parts = zip(dot(a, a), dot(a, b), dot(a, c), dot(b, b), dot(b, c), dot(c, c), strict=True)
    return [
        (aa << 4 * LIMB) + (ab << 3 * LIMB + 1) + ((2 * ac + bb) << 2 * LIMB) + (bc << LIMB + 1) + cc
        for aa, ab, ac, bb, bc, cc in parts
    ]


def _steps(batches: Batches, at: int, size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield _integers(batch.column(at).slice(start, STEP_ROWS), size)


def sums(rows: DataFrame, size: int, vector: str = "embedding") -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def add(batches: Batches) -> Batches:
        n, total = 0, [0] * size
        for x in _steps(batches, 0, size):
            n += len(x)
            total = [t + int(v) for t, v in zip(total, x.sum(axis=0), strict=True)]
        whole = pa.array(total, pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size), whole], ["i", "n", "s"])

    made = rows.select(vector).mapInArrow(add, "i int, n bigint, s decimal(38,0)")
    found = sorted(made.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def polarised(rows: DataFrame, size: int, n: int, s: list[int], vector: str = "embedding") -> dict[tuple[int, int], int]:
    """Over all rows, the exact sum of ``(y_i + y_j)^2`` for every pair ``i <= j``."""

    def add(batches: Batches) -> Batches:
        total = [[0] * (size - i) for i in range(size)]
        for x in _steps(batches, 0, size):
            y = _deviations(x, n, s)
            for i in range(size):
                own = squared_sums(y[:, i:] + y[:, i : i + 1])
                total[i] = [t + v for t, v in zip(total[i], own, strict=True)]
        for i, own in enumerate(total):
            j = pa.array(range(i, size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(own), pa.int32()), j, pa.array(own, pa.decimal128(38, 0))], ["i", "j", "q"]
            )

    made = rows.select(vector).mapInArrow(add, "i int, j int, q decimal(38,0)")
    # One row for each pair of dimensions, however many vectors.
    return {(r["i"], r["j"]): int(r["q"]) for r in made.groupBy("i", "j").agg(F.sum("q").alias("q")).collect()}


def covariance(q: dict[tuple[int, int], int], size: int, n: int) -> np.ndarray:
    """The matrix from the polarised sums; each entry is one correctly rounded quotient of whole numbers."""
    out = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            # q_ii is 4 times the sum of squares of y_i.
            twice = q[i, j] - q[i, i] // 4 - q[j, j] // 4
            out[i, j] = out[j, i] = twice / (2 * n**3)
    return out


def fit(rows: DataFrame, size: int, n_components: int = N_COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """Fit on all of ``rows``, which :func:`fit_list` has chosen; None if there are none."""
    n, s = sums(rows, size, vector) if size else (0, [])
    if not n:
        return None
    matrix = covariance(polarised(rows, size, n, s, vector), size, n)
    values, vectors = np.linalg.eigh(matrix)
    return Whitening(n, s, vectors[:, ::-1][:, :n_components], values[::-1], float(np.trace(matrix)))


def _added(rows: DataFrame, model: Whitening, vector: str, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``value(whitened rows)``, an array of fixed size."""
    size = len(model.s)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches: Batches) -> Batches:
        own, total = shared.value, None
        for x in _steps(batches, 0, size):
            part = value(own.project(_deviations(x, own.n, own.s))).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "v"])

    made = rows.select(vector).mapInArrow(add, "at int, v double")
    return np.array([r["v"] for r in sorted(made.groupBy("at").agg(F.sum("v").alias("v")).collect())])


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened values' covariance minus the identity, over all rows."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return None
    mean = _added(rows, model, vector, lambda w: w[:, live].sum(axis=0)) / model.n

    def products(w: np.ndarray) -> np.ndarray:
        centred = w[:, live] - mean
        return centred.T @ centred

    own = _added(rows, model, vector, products).reshape(len(live), len(live)) / model.n
    return float(np.abs(own - np.eye(len(live))).max())


def whiten(
    df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", n_components: int = N_COMPONENTS
) -> DataFrame:
    """Per usable row and component ``row_id, component, n, deviation, whitened, explained, identity_error``.

    At most ``n_components`` components, fewer if the vectors are shorter.
    """
    id_type = df.schema[row_id].dataType.simpleString()
    schema = (
        f"`{row_id}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double"
    )
    ship(df.sparkSession)
    rows, size = fit_list(df.select(row_id, vector), vector)
    model = fit(rows, size, n_components, vector)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, vector)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def made(batches: Batches) -> Batches:
        own = shared.value
        width = own.vectors.shape[1]
        explained = own.values[:width] / own.trace if own.trace > 0 else np.full(width, np.nan)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                y = _deviations(_integers(part.column(1), size), own.n, own.s)
                whole = [squared_sums(row[:, None]) for row in y] if y.dtype == object else squared_sums(y.T)
                total = [v if isinstance(v, int) else v[0] for v in whole]
                each = np.repeat(np.arange(len(y)), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(y))),
                        pa.array(np.full(len(each), own.n)),
                        pa.array([t if t < _LONG else None for t in total], pa.int64()).take(pa.array(each)),
                        pa.array(own.project(y).ravel(), from_pandas=True),
                        pa.array(np.tile(explained, len(y)), from_pandas=True),
                        pa.array([error] * len(each), pa.float64()),
                    ],
                    names=[row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(made, schema)
