"""Minimax contiguous sharding (operator 10).

Method: documents of equal text are one atomic group; groups are ordered by a 60-bit digest
of their text.  The smallest feasible shard capacity is found by binary search over the
ordered sizes, each guess being checked by filling greedily.

The driver sees ranges of digests, not groups: first ``2**FIRST_BITS`` of them.  A range of
several groups can be left whole unless a cut may fall into it, which bounds from below
(ranges that may be cut anywhere) and above (ranges that may not be cut) tell; those ranges
are split by further bits of the digest until every range that a cut may fall into is one
group.  So the capacity is the least over the groups themselves, while a round reads a few
hundred ranges of ``2**MORE_BITS`` parts at most.  Among the cuts with that capacity the one
with the largest smallest shard is taken, by a second binary search.

Places inside a shard are counted in pieces of the stored rows, so neither a large group nor
equal rows meet in one task.

Defined results: NULL text has no bytes and the checksum of the empty text; repeated
rows keep their own places; texts whose 60 bits agree count as one group; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nitrapanel.session import materialize

DIGEST_BITS = 60
FIRST_BITS, MORE_BITS = 16, 11
ROW_BYTES = 8  # added to the bytes of a text
PIECE_ROWS = 2_000  # rows that are numbered in one go


def cut(sizes: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Ends of the shards when each takes atoms as long as they fit; None if that needs more shards."""
    if len(sizes) and int(sizes.max()) > capacity:
        return None
    total, at, ends = np.concatenate([[0], np.cumsum(sizes)]), 0, []
    while at < len(sizes):
        if len(ends) == shards:
            return None
        at = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        ends.append(at)
    return ends


def minimax(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity with which the ordered atoms fit into the shards, and the shards' ends."""
    sizes = np.asarray(sizes, dtype=np.int64)
    low = max(int(sizes.max(initial=0)), -(-int(sizes.sum()) // shards))
    high = int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if cut(sizes, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, cut(sizes, shards, low) or []


def balanced(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Ends of exactly ``shards`` shards of at most the capacity, the smallest as large as can be (empty ones allowed)."""
    total = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])

    def reached(least: int) -> list[np.ndarray] | None:
        """Ends that the first j shards can have, for each j; None if the last cannot end at the end."""
        low, high = np.searchsorted(total, total - capacity), np.searchsorted(total, total - least, side="right")
        now = np.zeros(len(total), bool)
        now[0] = True
        steps = [now]
        for _ in range(shards):
            before = np.concatenate([[0], np.cumsum(now)])
            now = before[np.maximum(high, low)] > before[low]
            steps.append(now)
        return steps if now[-1] else None

    least, most = 0, int(total[-1]) // shards
    while least < most:
        middle = (least + most + 1) // 2
        if reached(middle) is None:
            most = middle - 1
        else:
            least = middle
    steps = reached(least)
    if steps is None:
        raise ValueError("the capacity is too small")
    ends, at = [], len(total) - 1
    for step in reversed(steps[:-1]):
        ends.append(at)
        fits = np.flatnonzero(step & (total >= total[at] - capacity) & (total <= total[at] - least))
        # Of the starts that fit, the one nearest to even shards.
        want = total[-1] * (shards - len(ends)) / shards
        at = int(fits[np.abs(total[fits] - want).argmin()])
    return ends[::-1]


class Ranges(NamedTuple):
    """Consecutive ranges of the digest: where each starts, its bytes, and whether it is a single group."""

    start: np.ndarray
    bits: np.ndarray  # leading bits of the digest that the range has in common
    sizes: np.ndarray
    single: np.ndarray


def to_split(ranges: Ranges, shards: int, lowest: int, capacity: int) -> np.ndarray:
    """Ranges of several groups into which a cut may fall, for capacities from ``lowest`` to ``capacity``.

    The j-th cut of a greedy filling lies no further than j full shards, and no nearer than
    where a filling of whole ranges gets with the lowest capacity.
    """
    total = np.concatenate([[0], np.cumsum(ranges.sizes)])
    several, out = ~ranges.single, np.zeros(len(ranges.sizes), bool)
    at = 0
    for j in range(1, shards):
        last = int(np.searchsorted(total, min(j * capacity, int(total[-1])), side="right"))
        at = max(at, int(np.searchsorted(total, total[at] + lowest, side="right")) - 1)
        out[at : last] = True
    return out & several


def _summed(rows: DataFrame, bits: int) -> DataFrame:
    """Bytes and number of groups of the ranges with these leading bits."""
    width = DIGEST_BITS - bits
    start = F.shiftleft(F.shiftright("digest", width), width)
    groups = F.min("digest") == F.max("digest")
    return rows.groupBy(start.alias("start")).agg(F.sum("size").alias("bytes"), groups.alias("single"))


def _collected(summed: DataFrame, bits: int) -> Ranges:
    got = summed.orderBy("start").collect()  # bounded by the bits and the ranges that are split
    column = lambda name, kind: np.array([r[name] for r in got], dtype=kind)
    return Ranges(column("start", np.int64), np.full(len(got), bits), column("bytes", np.int64), column("single", bool))


def shard_starts(rows: DataFrame, shards: int, first_bits: int = FIRST_BITS) -> tuple[int, list[int]]:
    """(least capacity, first digest of each shard but the first) for stored ``digest, size``."""
    ranges = _collected(_summed(rows, first_bits), first_bits)
    if not len(ranges.sizes):
        return 0, []
    largest = rows.groupBy("digest").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0]
    lowest = max(int(largest), -(-int(ranges.sizes.sum()) // shards))
    while True:
        capacity, _ = minimax(ranges.sizes, shards)
        split = to_split(ranges, shards, lowest, capacity) if capacity > lowest else np.zeros(len(ranges.sizes), bool)
        if not split.any():
            break
        bits = min(DIGEST_BITS, int(ranges.bits[split].min()) + MORE_BITS)
        split &= ranges.bits < bits
        width = DIGEST_BITS - ranges.bits[split]
        spans = rows.sparkSession.createDataFrame(list(zip(ranges.start[split].tolist(), width.tolist())), "at long, width int")
        kinds = sorted(set(width.tolist()))
        parts = [
            rows.join(F.broadcast(spans.where(F.col("width") == w)), F.shiftleft(F.shiftright("digest", w), w) == F.col("at"), "left_semi")
            for w in kinds
        ]
        inside = parts[0]
        for part in parts[1:]:
            inside = inside.unionByName(part)
        fine = _collected(_summed(inside, bits), bits)
        merged = [np.concatenate([a[~split], b]) for a, b in zip(ranges, fine)]
        order = np.argsort(merged[0], kind="stable")
        ranges = Ranges(*(x[order] for x in merged))
    ends = balanced(ranges.sizes, shards, capacity)
    beyond = np.concatenate([ranges.start, [1 << DIGEST_BITS]])
    return capacity, [int(beyond[e]) for e in ends[:-1]]


def digest_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def shard_documents(docs: DataFrame, shards: int, first_bits: int = FIRST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, digest, shard, slot``: one row for each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        digest_of(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "sizes")
    _, starts = shard_starts(rows, shards, first_bits)
    # As many literals as there are shards.
    passed = F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= F.col("digest"))) if starts else F.lit(0)
    placed = rows.withColumn("shard", passed.cast("int")).withColumn("piece", F.floor(F.col("row") / PIECE_ROWS))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "piece").orderBy("row")))
    slot = (F.col("skip") + F.col("at") - 1).cast("long")
    return numbered.join(offsets, ["shard", "piece"]).select("doc_id", "size", "text_crc32", "digest", "shard", slot.alias("slot"))
