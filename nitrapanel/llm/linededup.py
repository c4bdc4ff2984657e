"""Line deduplication through a sharded minimal perfect hash (operator 11).

Method: a line's key is the line without white space at its ends and with A to Z in lower
case; its hash has 128 bits.  One aggregation counts, for each distinct hash, the
documents that hold it.  Hashes found in ``least`` documents or more are dealt to shards
of bounded size, and each shard builds a minimal perfect hash over its hashes: levels of
bit arrays in which a hash that has its place to itself is settled and the others go one
level down; the rank of a set bit is the slot.  The slots index two compact arrays, a
64-bit fingerprint and a count.  Documents probe the arrays: slot by the first half of
the hash and the shard's levels, then the fingerprint decides whether the line is a
member at all.  No line is joined with anything.

An index up to ``BROADCAST_BYTES`` (checked from its number of hashes before it is read)
is sent to the workers whole.  A larger one stays in its shards: only line hashes travel,
salted by document, and stream past their shard's arrays, whose row is sorted before
them; the places of the lines to drop come back.  Both ways give the same rows (tested).

A hash is unseen in the index but passes with chance 2**-64, two keys share a hash with
chance 2**-128.

Defined results: each row is a document of its own, also where ids or whole rows repeat;
NULL and empty texts are one empty line; a key without code points is never dropped;
a text that loses all its lines becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrapanel.llm.frames import arrow_map, record_batch
from nitrapanel.session import materialize, ship_package

LEAST = 10  # documents from which a line is dropped
BLANK = b" \t\n\x0b\x0c\r"  # fixed values
SHARD_KEYS = 1 << 16  # hashes a shard is meant to have
ROOM = 2  # bits of a level for each hash that reaches it
SALTS = 32  # groups in which a shard's probes are dealt where the index is not broadcast
SLOT_BYTES = 13  # fingerprint, count and about eight bits of the levels
BROADCAST_BYTES = 64 << 20
HEAD = struct.Struct("<QI")
KINDS = [("kept_text", "string"), ("n_lines", "long"), ("n_dropped", "long")]


# -- keys and hashes ---------------------------------------------------------------


def keys_of(text: bytes) -> list[bytes]:
    return [line.strip(BLANK) for line in text.lower().split(b"\n")]  # bytes.lower changes A to Z only


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """n x 2 unsigned 64-bit halves of the keys' hashes."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def texts_of(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``a, b, n``: halves of every distinct key's hash and the number of documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes] = []
            for text in texts_of(batch, 0):
                own = set(keys_of(text))
                own.discard(b"")
                held.extend(own)
                if len(held) >= 1 << 16:
                    yield counted(held)
                    held = []
            if held:
                yield counted(held)

    def counted(held: list[bytes]) -> pa.RecordBatch:
        found, n = np.unique(hashes_of(held).view("<u8,<u8").ravel(), return_counts=True)
        parts = [pa.array(found["f0"].view(np.int64)), pa.array(found["f1"].view(np.int64)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(parts, ["a", "b", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return arrow_map(texts, run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


# -- the minimal perfect hash --------------------------------------------------------


def places(halves: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Place of each hash in a level of ``size`` bits; every level mixes both halves anew."""
    with np.errstate(over="ignore"):
        h = halves[:, 0] ^ (halves[:, 1] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h % np.asarray(size, np.uint64)).astype(np.int64)


def build(halves: np.ndarray, counts: np.ndarray) -> bytes:
    """Image of one shard: number of hashes and levels, sizes and bits of the levels, fingerprints, counts."""
    n, rest, levels, slots = len(halves), np.arange(len(halves)), [], []
    while len(rest):
        size = ROOM * len(rest) + 8 - ROOM * len(rest) % 8
        at = places(halves[rest], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        settled = alone[at]
        slots.append(rest[settled][np.argsort(at[settled])])  # by place: the order of the ranks
        rest = rest[~settled]
    order = np.concatenate(slots) if slots else rest
    sizes = np.array([len(x) for x in levels], "<u8").tobytes()
    bits = b"".join(np.packbits(x, bitorder="little").tobytes() for x in levels)
    capped = np.minimum(counts[order], (1 << 32) - 1).astype("<u4")
    return b"".join([HEAD.pack(n, len(levels)), sizes, bits, halves[order, 1].astype("<u8").tobytes(), capped.tobytes()])


class Index:
    """Shards laid end to end, so that one vectorised probe serves all of them."""

    def __init__(self, images: list[bytes]) -> None:
        heads, bits, prints, counts, sizes = [], [], [], [], []
        for image in images:
            n, levels = HEAD.unpack_from(image)
            own = np.frombuffer(image, "<u8", levels, HEAD.size).astype(np.int64)
            at = HEAD.size + 8 * levels
            length = int(own.sum()) // 8
            bits.append(np.frombuffer(image, np.uint8, length, at))
            prints.append(np.frombuffer(image, "<u8", n, at + length))
            counts.append(np.frombuffer(image, "<u4", n, at + length + 8 * n))
            sizes.append(own)
            heads.append((n, levels))
        self.shards = len(images)
        self.depth = max((levels for _, levels in heads), default=0)
        self.sizes = np.zeros((self.shards, self.depth), np.int64)
        self.starts = np.zeros((self.shards, self.depth), np.int64)
        at = 0
        for i, own in enumerate(sizes):
            self.sizes[i, : len(own)] = own
            self.starts[i, : len(own)] = at + np.cumsum(own) - own
            at += int(own.sum())
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.bits, self.prints, self.counts = join(bits, np.uint8), join(prints, np.uint64), join(counts, np.uint32)
        # Set bits before each byte: the rank of a bit needs one lookup and one byte.
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)]).astype(np.uint32 if at < 1 << 32 else np.int64)

    def count(self, halves: np.ndarray, shard: np.ndarray | None = None) -> np.ndarray:
        """Documents of each hash, zero for a hash that is not in the index."""
        out = np.zeros(len(halves), np.int64)
        if not self.shards:
            return out
        shard = shard_of(halves, self.shards) if shard is None else shard
        rest = np.arange(len(halves))
        for level in range(self.depth):
            rest = rest[self.sizes[shard[rest], level] > 0]
            if not len(rest):
                break
            own = shard[rest]
            bit = self.starts[own, level] + places(halves[rest], level, self.sizes[own, level])
            byte, lane = bit >> 3, (bit & 7).astype(np.uint8)
            value = self.bits[byte]
            hit = (value >> lane) & 1 == 1
            below = np.bitwise_count(value[hit] & ((np.uint8(1) << lane[hit]) - np.uint8(1)))
            slot = self.before[byte[hit]].astype(np.int64) + below
            found = rest[hit]
            out[found] = np.where(self.prints[slot] == halves[found, 1], self.counts[slot], 0)
            rest = rest[~hit]
        return out


def shard_of(halves: np.ndarray, shards: int) -> np.ndarray:
    return (halves[:, 0] % np.uint64(shards)).astype(np.int64)


def build_index(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(``shard, image`` in the shared folder, number of shards, number of hashes)."""
    often = materialize(document_counts(docs, text_col).where(F.col("n") >= least), "line_counts")
    n = often.count()
    shards = max(1, -(-n // SHARD_KEYS))
    # The shard is the first half, unsigned, modulo the number of shards.
    top, low = F.shiftrightunsigned("a", 32), F.col("a").bitwiseAND(F.lit(0xFFFFFFFF))
    shard = ((top % shards) * F.lit((1 << 32) % shards) + low % shards) % shards
    ship_package(docs.sparkSession)

    def shard_image(key: tuple, table: pa.Table) -> pa.Table:
        halves = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("a", "b")], axis=1)
        image = build(halves, table.column("n").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "image": pa.array([image], pa.binary())})

    dealt = often.withColumn("shard", shard.cast("long"))
    return materialize(dealt.groupBy("shard").applyInArrow(shard_image, "shard long, image binary"), "line_index"), shards, n


# -- documents probe it --------------------------------------------------------------


def drop_lines(docs: DataFrame, least: int = LEAST, text_col: str = "text", keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns (all, if None) with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    index, shards, n = build_index(docs, least, text_col)
    added = [c for c, _ in KINDS]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("text"))
    if n * SLOT_BYTES <= broadcast_bytes:
        out = _probe_whole(source, index, shards)
    else:
        out = _probe_shards(source, index, shards)
    return out.withColumnsRenamed({f"k_{i}": c for i, c in enumerate(names)})


def _fields(source: DataFrame):
    fields = source.drop("text").schema
    for name, kind in KINDS:
        fields = fields.add(name, kind)
    return fields


def _cut(text: bytes, drop: np.ndarray) -> tuple[str, int, int]:
    lines = text.split(b"\n")
    if not drop.any():
        return text.decode(), len(lines), 0
    return b"\n".join(x for x, d in zip(lines, drop.tolist()) if not d).decode(), len(lines), int(drop.sum())


def _probe_whole(source: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Every worker holds the index; its size has been checked."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = _fields(source)
    schema, width = to_arrow_schema(fields), len(source.columns) - 1
    images = {r["shard"]: bytes(r["image"]) for r in index.collect()}
    sent = source.sparkSession.sparkContext.broadcast([images.get(i, build(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))) for i in range(shards)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Index(sent.value)
        for batch in batches:
            texts = texts_of(batch, width)
            at = 0
            while at < len(texts):
                own, keys = [], []
                first = at
                while at < len(texts) and len(keys) < 1 << 16:
                    more = keys_of(texts[at])
                    own.append(len(more))
                    keys += more
                    at += 1
                filled = np.array([len(k) > 0 for k in keys])
                often = (table.count(hashes_of(keys)) > 0) & filled
                parts = np.split(often, np.cumsum(own)[:-1])
                made = [_cut(t, d) for t, d in zip(texts[first:at], parts)]
                kept = batch.slice(first, at - first).columns[:width]
                yield record_batch(schema, dict(zip(schema.names, [*kept, *map(list, zip(*made))])))

    return arrow_map(source, run, fields)


def _probe_shards(source: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Line hashes go to the shards and the places of the lines to drop come back; memory holds one shard."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = materialize(source.withColumn("row", F.monotonically_increasing_id()), "line_rows")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
                keys = keys_of(text)
                for at in range(0, len(keys), 1 << 16):
                    part = keys[at : at + (1 << 16)]
                    filled = np.flatnonzero(np.array([len(k) > 0 for k in part]))
                    if len(filled):
                        halves = hashes_of([part[i] for i in filled.tolist()])
                        shard = shard_of(halves, shards)
                        columns = [shard, np.full(len(filled), row % SALTS), halves[:, 0].view(np.int64), halves[:, 1].view(np.int64), np.full(len(filled), row), filled + at]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "salt", "a", "b", "row", "line"])

    probes = arrow_map(rows.select("row", "text"), emit, "shard long, salt long, a long, b long, row long, line long")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    arrays = index.select("shard", salts.alias("salt"), "image")
    mixed = probes.withColumn("image", F.lit(None).cast("binary")).withColumn("late", F.lit(1))
    mixed = mixed.unionByName(arrays.withColumn("late", F.lit(0)), allowMissingColumns=True)
    mixed = mixed.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "late")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, Index([])
        for batch in batches:
            shard = batch.column(0).to_numpy()
            halves = np.stack([batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (2, 3)], axis=1)
            late = batch.column(7).to_numpy()
            hit = np.zeros(len(shard), bool)
            edges = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1) | (late == 0))
            for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)]):
                if late[start] == 0:
                    at, table = shard[start], Index([batch.column(6)[start].as_py()])
                elif shard[start] != at:
                    at, table = shard[start], Index([])
                own = slice(start + (late[start] == 0), stop)
                hit[own] = table.count(halves[own], np.zeros(len(halves[own]), np.int64)) > 0
            mask = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch.column(4).filter(mask), batch.column(5).filter(mask)], ["row", "line"])

    drops = arrow_map(mixed.select("shard", "salt", "a", "b", "row", "line", "image", "late"), probe, "row long, line long")
    drops = drops.groupBy("row").agg(F.collect_list("line").alias("lines"))
    joined = rows.join(drops, "row", "left").drop("row")
    fields = _fields(joined.drop("lines"))
    schema, width = to_arrow_schema(fields), len(source.columns) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, lines in zip(texts_of(batch, width), batch.column(width + 1).to_pylist()):
                drop = np.zeros(text.count(b"\n") + 1, bool)
                drop[lines or []] = True
                made.append(_cut(text, drop))
            if made:
                yield record_batch(schema, dict(zip(schema.names, [*batch.columns[:width], *map(list, zip(*made))])))

    return arrow_map(joined, cut, fields)
