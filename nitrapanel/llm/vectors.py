"""What the operators on embeddings share: whole vectors, Arrow matrices, sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.llm.frames import arrow_map

DIRECT = 64  # partial sums that may go to the driver without meeting in tasks before
MEET = 16  # tasks in which more of them meet


def whole(vector: Column) -> Column:
    """Neither null nor empty, and no entry null, NaN or infinite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def whole_vectors(rows: DataFrame, vector_col: str, kept: dict[str, Column]) -> tuple[DataFrame, int]:
    """(``kept`` columns and ``v`` as doubles, dimension): whole vectors of the commonest length.

    Of equally common lengths the smaller counts; rows of another length take no part.
    """
    out = rows.select(F.col(vector_col).cast("array<double>").alias("v"), *[c.alias(n) for n, c in kept.items()])
    out = out.where(whole(F.col("v")))
    common = out.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return out, 0
    return out.where(F.size("v") == common["d"]), common["d"]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def in_many_tasks(rows: DataFrame) -> bool:
    """Whether more tasks read the rows than may send their sums to the driver."""
    return rows.select(F.spark_partition_id().alias("p")).distinct().count() > DIRECT


def summed(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], like: np.ndarray, many: bool) -> np.ndarray:
    """Sum over all rows of arrays shaped as ``like``; each task adds up its own.

    The sums of ``many`` tasks are added up in a few tasks before the driver gets them, so
    what it gets is bounded by ``DIRECT`` arrays, whatever the input.
    """
    shape, kind = like.shape, like.dtype

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            total += values(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = arrow_map(rows, own, "part binary")
    if many:
        parts = arrow_map(parts.repartition(MEET), meet, "part binary")
    return sum((np.frombuffer(bytes(r["part"]), kind).reshape(shape) for r in parts.collect()), np.zeros(shape, kind))
