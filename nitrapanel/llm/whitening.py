"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 12).

Method: entries become integers; every distinct vector once is the fit list, stored in
the shared folder.  Its covariance is never formed: a block of directions Q is multiplied
by it in one pass of the tasks, each adding up its own centred XᵀXQ, and the driver gets
one dimension x block matrix.  A Chebyshev polynomial of the covariance, by its three-term
recurrence over such passes, damps the part of the spectrum below the block's least Ritz
value; then follow QR and a Rayleigh-Ritz step.  Rounds end when the residual of every
wanted pair is at the level of rounding (certified), or when residuals that have come
within a thousandth of that no longer fall.

Defined results: a vector that is null, empty or holds a null or a non-finite entry takes
no part, nor does one of another length than most have (of equally common lengths the
smaller counts); NULL ids and repeated rows are projected like any others, equal vectors
count once in the fit; components without variance are not returned, so a table of one
distinct vector and an empty table give no rows; ``deviation`` is NULL where the exact
value does not fit a long.  Scaled entries must lie below 2**40.  Other columns are left
behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.llm.frames import arrow_map, record_batch
from nitrapanel.llm.tokens import _arrow
from nitrapanel.llm.vectors import in_many_tasks, matrix, summed, whole_vectors
from nitrapanel.session import materialize

SCALE, SHIFT = 64, 1_000_000  # an entry c becomes floor(SCALE * c) + SHIFT
COMPONENTS = 16
GUARD = 24  # directions kept beside the wanted ones
DEGREE = 10  # of the filter: passes a round
NULL_PART = 1e-12  # of the largest eigenvalue: variance below it is none
CERTIFIED = 4e-15  # residual, as part of the largest eigenvalue, times the root of the dimension
MOST_ROUNDS = 60

WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Basis(NamedTuple):
    n: int  # vectors in the fit list
    sums: np.ndarray  # of each dimension
    vectors: np.ndarray  # dimension x components, unit columns
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float
    residual: float  # largest residual of a component, as part of the largest eigenvalue
    certified: bool


def scaled(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(shift).cast("long"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean: the difference is exact before it is rounded once."""
    return (n * x - sums) / n


def fit_basis(fit: DataFrame, dimension: int, components: int = COMPONENTS, seed: int = 11) -> Basis:
    """Leading eigenpairs of the covariance of the column ``x`` (arrays of longs) of a stored table."""
    d, many = dimension, in_many_tasks(fit)
    first = summed(fit, lambda b: np.concatenate([[b.num_rows], matrix(b.column(0), d).sum(axis=0)]), np.zeros(d + 1, np.int64), many)
    n, sums = int(first[0]), first[1:]
    none = Basis(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0.0, True)
    if not n:
        return none
    trace = float(summed(fit, lambda b: np.square(centred(matrix(b.column(0), d), n, sums)).sum(), np.zeros(()), many)) / n
    if trace == 0:
        return none

    def times(q: np.ndarray) -> np.ndarray:
        """Covariance times the block: one pass."""

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = centred(matrix(batch.column(0), d), n, sums)
            return x.T @ (x @ q)

        return summed(fit, part, q, many) / n

    k = min(d, components + GUARD)
    block, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, k)))
    best, past = None, np.inf
    for _ in range(MOST_ROUNDS):
        image = times(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
        block, image = block @ turn, image @ turn
        wanted = int((values[:components] > NULL_PART * values[0]).sum())
        misses = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0)
        residual = float(misses.max() / values[0])
        if best is None or residual < best[0]:
            best = (residual, block[:, :wanted], values[:wanted])
        enough = CERTIFIED * d**0.5
        if residual <= enough or (residual <= 1000 * enough and residual > past / 2):
            break
        past = residual
        # Variance is never negative, so the unwanted spectrum lies between zero and ``high``.
        high = max(values[-1], 0.1 * values[wanted - 1])
        block, _ = np.linalg.qr(chebyshev(times, block, image, DEGREE, high, values[0]))
    residual, vectors, values = best
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    into = vectors / np.sqrt(values)

    def white(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(matrix(batch.column(0), d), n, sums) @ into
        return y.T @ y

    identity = summed(fit, white, np.zeros((len(values),) * 2), many) / n
    return Basis(n, sums, vectors, values, trace, float(np.abs(identity - np.eye(len(values))).max()), residual, residual <= 1000 * CERTIFIED * d**0.5)


def chebyshev(times, block: np.ndarray, image: np.ndarray, degree: int, high: float, top: float) -> np.ndarray:
    """Scaled Chebyshev polynomial of the covariance on (0, high), times the block; ``image`` is the first product."""
    half = middle = high / 2
    first = half / (top - middle)
    sigma = first
    before, now = block, (image - middle * block) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (after / half) * (times(now) - middle * now) - sigma * after * before
        sigma = after
    return now


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum of squares of n * x - sums for each row; None where it does not fit a long."""
    off = n * x - sums
    if not off.size or int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each vector that takes part and each component."""
    spark = rows.sparkSession
    own, d = whole_vectors(rows, vector_col, {"vec_id": F.col(id_col).cast("long")})
    if not d:
        return spark.createDataFrame([], WHITE)
    own = own.select("vec_id", scaled(F.col("v"), scale, shift).alias("x"))
    fit = materialize(own.select("x").distinct(), "fit")
    basis = fit_basis(fit, d, components)
    if not basis.certified:
        raise ArithmeticError(f"residual {basis.residual:.1e} after {MOST_ROUNDS} rounds")
    return project(own, basis)


def project(own: DataFrame, basis: Basis) -> DataFrame:
    """Whitened coordinates of ``vec_id, x`` in a basis, a row for each component."""
    schema = _arrow(own.sparkSession, WHITE)
    into, m = basis.vectors / np.sqrt(basis.values), len(basis.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows if m else 0, 1024):
                batch = whole_batch.slice(at, 1024)
                x = matrix(batch.column(1), len(basis.sums))
                rows = batch.num_rows
                yield record_batch(
                    schema,
                    {
                        "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(rows), m))),
                        "component": np.tile(np.arange(1, m + 1, dtype=np.int32), rows),
                        "n": np.full(rows * m, basis.n),
                        "deviation": [v for v in deviations(x, basis.n, basis.sums) for _ in range(m)],
                        "whitened": (centred(x, basis.n, basis.sums) @ into).ravel(),
                        "explained": np.tile(basis.values / basis.trace, rows),
                        "identity_error": np.full(rows * m, basis.identity_error),
                    },
                )

    return arrow_map(own, run, WHITE)
