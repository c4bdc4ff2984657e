"""Small helpers shared by the operators: keys, Arrow batches, bounded samples."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nitrapanel.session import ship_package

BATCH_ROWS = 256  # rows a task works on at a time
BATCH_CHARS = 400_000  # code points after which such a batch ends early


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names; all other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts))


def small_batches(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """Python lists of the columns, a bounded number of rows and code points at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            lists = [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
            texts = lists[-1]
            start = held = 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held >= BATCH_CHARS:
                    yield [values[start : i + 1] for values in lists]
                    start, held = i + 1, 0
            if start < len(texts):
                yield [values[start:] for values in lists]


def record_batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def crc(raw: bytes | memoryview) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of ``key``: the same rows for any partitioning.

    A count and a threshold leave about as many rows as are asked for, so that the
    final ordered limit sees a bounded number of them from all partitions together.
    """
    span = 1 << 30
    total = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(span))
    if total > most:
        cut = int(span * (most + 8 * most**0.5 + 64) / total) + 1
        rows = rows.where(draw < cut)
    return rows.orderBy(draw, key).limit(most)


def arrow_map(rows: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)
