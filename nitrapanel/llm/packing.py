"""Hierarchical multi-length packing into training sequences (operator 4).

Method: documents are routed to context-size tiers by length.  Whole multiples of the
longest context become sequences of their own; the rest of a document goes to the
smallest tier that holds it.  Each tier opens a window for each of its rests; gaps of
long windows are filled from the shorter tiers (largest piece that fits, at last one
cut), so windows end exactly at their tier's size, a power of two, and need no padding.
Sequences are then dealt into step groups of equal token counts, large ones first.

Every task packs its own partition in windows of bounded size and carries what does not
fill a sequence into the next window; what is left at the end of the partition is cut
into powers of two.  Nothing is shuffled and nothing is padded.

Defined results: NULL text is the empty text (one end id); repeated rows are packed like
any others; an empty table gives no rows; other columns are ignored.  Rows are sorted by
id and a hash of the text within the partition, so a retried task packs alike.
"""

from __future__ import annotations

import struct
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrapanel.llm.coder import coder
from nitrapanel.llm.frames import arrow_map, crc, id_and_text, record_batch
from nitrapanel.llm.tokens import _arrow

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16 * 2048  # tokens of a step group
WINDOW_TOKENS = 1 << 20  # tokens a task packs at a time

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, step_group long"
)


class Piece(NamedTuple):
    length: int
    doc: int  # index into the packer's documents
    start: int


class Packer:
    """Packs documents of one partition; ``add`` and ``finish`` return closed step groups."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, window_tokens: int = WINDOW_TOKENS) -> None:
        if any(a != 2 * b for a, b in zip(tiers, tiers[1:])) or tiers[0] & (tiers[0] - 1) or step_tokens % tiers[0]:
            raise ValueError("tiers are powers of two, each half the one before; a step is a multiple of the longest")
        self.tiers, self.step_tokens, self.window_tokens = tiers, step_tokens, window_tokens
        self.docs: dict[int, tuple] = {}
        self.next_doc = 0
        self.held = 0
        self.rests: list[Piece] = []
        self.waiting: list[list[Piece]] = []  # sequences without a step group

    def add(self, doc_id: int | None, raw: bytes) -> list[list[list[Piece]]]:
        n, doc, longest = len(raw) // 4, self.next_doc, self.tiers[0]
        self.docs[doc] = (doc_id, raw)
        self.next_doc += 1
        self.held += n
        whole = n - n % longest
        self.waiting += [[Piece(longest, doc, at)] for at in range(0, whole, longest)]
        if n > whole:
            self.rests.append(Piece(n - whole, doc, whole))
        return self._pack(False) if self.held >= self.window_tokens else []

    def finish(self) -> list[list[list[Piece]]]:
        return self._pack(True)

    def _tier(self, length: int) -> int:
        return next(i for i in range(len(self.tiers) - 1, -1, -1) if length <= self.tiers[i])

    def _pack(self, last: bool) -> list[list[list[Piece]]]:
        pools: list[list[Piece]] = [[] for _ in self.tiers]
        for piece in sorted(self.rests):
            pools[self._tier(piece.length)].append(piece)
        open_ones: list[Piece] = []
        for at, size in enumerate(self.tiers):
            lowest = at == len(self.tiers) - 1
            while pools[at]:
                window, gap = [pools[at].pop()], size
                gap -= window[0].length
                while gap:
                    filler = self._filler(pools, at if lowest else at + 1, gap)
                    if filler is None:
                        break
                    window.append(filler)
                    gap -= filler.length
                if gap:
                    open_ones += window
                else:
                    self.waiting.append(window)
        self.rests, self.held = open_ones, sum(p.length for p in open_ones)
        if last:
            self._close_rests()
        return self._steps(last)

    def _filler(self, pools: list[list[Piece]], first: int, gap: int) -> Piece | None:
        """The largest piece of the tiers from ``first`` on that fits, else the front of the shortest."""
        for pool in pools[max(first, self._tier(gap)) :]:
            k = bisect_right(pool, (gap, float("inf"), 0))
            if k:
                return pool.pop(k - 1)
        for pool in reversed(pools[first:]):
            if pool:
                piece = pool.pop(0)
                rest = Piece(piece.length - gap, piece.doc, piece.start + gap)
                insort(pools[self._tier(rest.length)], rest)
                return Piece(gap, piece.doc, piece.start)
        return None

    def _close_rests(self) -> None:
        """Lay the remaining pieces end to end and cut the run into the longest powers of two."""
        left = sum(p.length for p in self.rests)
        room, window = 0, []
        for piece in self.rests:
            length, doc, start = piece
            while length:
                if not room:
                    room = min(self.tiers[0], 1 << (left.bit_length() - 1))
                    window = []
                    self.waiting.append(window)
                take = min(room, length)
                window.append(Piece(take, doc, start))
                start, length, room, left = start + take, length - take, room - take, left - take
        self.rests, self.held = [], 0

    def _steps(self, last: bool) -> list[list[list[Piece]]]:
        """Deal sequences, longest first, into groups of ``step_tokens``; powers of two fill them exactly."""
        self.waiting.sort(key=lambda w: -sum(p.length for p in w))
        groups, group, filled = [], [], 0
        for window in self.waiting:
            group.append(window)
            filled += sum(p.length for p in window)
            if filled >= self.step_tokens:
                groups.append(group)
                group, filled = [], 0
        if last and group:
            groups.append(group)
            group = []
        self.waiting = group
        return groups

    def forget(self) -> None:
        """Drop documents of which nothing is left to emit."""
        live = {p.doc for p in self.rests} | {p.doc for w in self.waiting for p in w}
        self.docs = {d: v for d, v in self.docs.items() if d in live}


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its document, place there, checksum, sequence, place in it, step group."""
    schema = _arrow(docs.sparkSession, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end, packer = coder(tokenizer), struct.pack("<I", end_id), Packer(tiers)
        task = TaskContext.get().partitionId() << 40
        sequences = steps = 0

        def rows(groups: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            out: list[tuple] = []
            for group in groups:
                for window in group:
                    total, offset = sum(p.length for p in window), 0
                    for length, doc, start in window:
                        doc_id, raw = packer.docs[doc]
                        check = crc(memoryview(raw)[4 * start : 4 * (start + length)])
                        out.append((doc_id, start, length, check, len(raw) // 4, task | sequences, offset, total, task | steps))
                        offset += length
                    sequences += 1
                steps += 1
            packer.forget()
            for at in range(0, len(out), 4096):
                yield record_batch(schema, dict(zip(schema.names, map(list, zip(*out[at : at + 4096])))))

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for part in tool.encode_column(batch.column(1)):
                for raw in part:
                    if groups := packer.add(next(ids), raw + end):
                        yield from rows(groups)
        yield from rows(packer.finish())

    ordered = id_and_text(docs, id_col, text_col).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return arrow_map(ordered, run, PIECES)
