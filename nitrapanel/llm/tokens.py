"""Token ids in fixed-width bit-packed files (operator 1).

Method: every id is stored in the least number of bits that the vocabulary needs.
Eight ids fill exactly ``width`` bytes, so blocks start on byte borders; a table of
block offsets gives random access, and numpy unpacks whole blocks at once.

A file set is a folder with ``segments`` (Parquet, written and committed by Spark, one
row per segment: its documents, their lengths, and the image of the packed ids) and
``shards`` (ids before each shard).  An image is::

    4 bytes  "TIDS"        2 bytes version      2 bytes width in bits
    8 bytes  number of ids 4 bytes ids a block  4 bytes number of blocks
    8 bytes for each block and one more: byte offsets into the payload
    payload

Defined results: NULL text is the empty text (only the end id is stored); NULL ids come
first; repeated ids keep all their rows, ordered by a hash of the text; an empty table
gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.llm.coder import coder
from nitrapanel.llm.frames import arrow_map, crc, id_and_text, record_batch

MAGIC = b"TIDS"
HEAD = struct.Struct("<4sHHQII")
BLOCK = 8_192  # ids a block; a multiple of eight
SEGMENT_IDS = 1 << 20  # a segment ends with the document that reaches this

SEGMENTS = "shard int, segment int, shard_start long, n_tokens long, doc_ids array<long>, lengths array<long>, image binary"
SHARDS = "shard int, n_tokens long, base long"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
TOKENS = "doc_id long, start long, ids array<int>"


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids one after the other, ``width`` bits each, low bits first."""
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    groups = -(-len(ids) // 8)
    padded = np.zeros(groups * 8, dtype=np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 8)
    out = np.zeros((groups, width), dtype=np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = padded[:, lane] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack_ids(raw: bytes | memoryview, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed run."""
    groups = -(-n // 8)
    have = np.frombuffer(raw, dtype=np.uint8)[: groups * width]
    if len(have) < groups * width:
        have = np.concatenate([have, np.zeros(groups * width - len(have), dtype=np.uint8)])
    have = have.reshape(groups, width)
    out = np.empty((groups, 8), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = np.zeros(groups, dtype=np.uint64)
        for k in range((shift + width + 7) // 8):
            value |= have[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = ((value >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.reshape(-1)[:n]


def write_image(ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    parts = [pack_ids(ids[at : at + block], width) for at in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)]).astype("<u8")
    head = HEAD.pack(MAGIC, 1, width, len(ids), block, len(parts))
    return b"".join([head, offsets.tobytes(), *parts])


class Image:
    """Random access to the ids of one segment."""

    def __init__(self, raw: bytes) -> None:
        magic, version, self.width, self.n, self.block, blocks = HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token image")
        self.offsets = np.frombuffer(raw, dtype="<u8", count=blocks + 1, offset=HEAD.size)
        self.payload = memoryview(raw)[HEAD.size + 8 * (blocks + 1) :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the blocks that hold them are unpacked."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = self.payload[int(self.offsets[first]) : int(self.offsets[last + 1])]
        have = min(self.n, (last + 1) * self.block) - first * self.block
        return unpack_ids(raw, self.width, have)[start - first * self.block : stop - first * self.block]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the file set below ``path`` in ascending order of the id.

    One range exchange puts the documents in order; each task packs its own range.  The
    driver sees one number a task.  Retried tasks give the same rows, and Spark's commit
    keeps one of them.
    """
    spark = docs.sparkSession
    schema = _arrow(spark, SEGMENTS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(tokenizer)
        width = bits_for(max(tool.vocab_size, (end_id or 0) + 1))
        end = b"" if end_id is None else struct.pack("<I", end_id)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        raws: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            image = write_image(np.frombuffer(b"".join(raws), dtype="<u4"), width)
            row = (shard, segment, before, held, doc_ids, [len(r) // 4 for r in raws], image)
            return record_batch(schema, dict(zip(schema.names, ([v] for v in row))))

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for part in tool.encode_column(batch.column(1)):
                for raw in part:
                    raws.append(raw + end)
                    doc_ids.append(next(ids))
                    held += len(raws[-1]) // 4
                    if held >= SEGMENT_IDS:
                        yield close()
                        segment, before, held, doc_ids, raws = segment + 1, before + held, 0, [], []
        if doc_ids:
            yield close()

    ordered = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    arrow_map(ordered, encode, SEGMENTS).write.parquet(f"{path}/segments")
    # One row for each task of the write: bounded by the number of partitions, not by the data.
    totals = spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    rows, base = [], 0
    for row in totals:
        rows.append((row["shard"], row["n"], base))
        base += row["n"]
    spark.createDataFrame(rows, SHARDS).coalesce(1).write.parquet(f"{path}/shards")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``base``, the number of ids before the segment."""
    # The shard table has one row for each task of the write.
    shards = F.broadcast(spark.read.schema(SHARDS).parquet(f"{path}/shards").select("shard", "base"))
    rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(shards, "shard")
    return rows.withColumn("base", F.col("base") + F.col("shard_start"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Image(row["image"]).ids()
            ends = np.cumsum(row["lengths"])
            for doc_id, end, n in zip(row["doc_ids"], ends.tolist(), row["lengths"]):
                yield doc_id, row["base"] + end - n, ids[end - n : end]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids and the number of ids before it, from the files."""
    schema = _arrow(spark, TOKENS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, start, ids in _documents(batches):
            yield record_batch(schema, {"doc_id": [doc_id], "start": [start], "ids": [ids.astype(np.int32)]})

    return arrow_map(segments(spark, path).select("base", "doc_ids", "lengths", "image"), decode, TOKENS)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens``, with a checksum of the ids in place of the ids."""
    schema = _arrow(spark, DIGESTS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc_id, start, ids in _documents(batches):
            rows.append((doc_id, start, len(ids), crc(ids.astype("<u4").tobytes())))
            if len(rows) >= 4096:
                yield record_batch(schema, dict(zip(schema.names, map(list, zip(*rows)))))
                rows = []
        if rows:
            yield record_batch(schema, dict(zip(schema.names, map(list, zip(*rows)))))

    return arrow_map(segments(spark, path).select("base", "doc_ids", "lengths", "image"), decode, DIGESTS)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole file set; only segments that hold them are read."""
    rows = segments(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > start))
    parts = [(r["base"], Image(r["image"]).ids(max(0, start - r["base"]), stop - r["base"])) for r in rows.select("base", "image").collect()]
    return np.concatenate([ids for _, ids in sorted(parts, key=lambda p: p[0])] or [np.empty(0, np.uint32)])


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
