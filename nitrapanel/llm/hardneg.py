"""Hard negatives by angular triangle filtering with integer scores (operator 13).

Method: entries become integers.  Every row stores its norm and its angles to a few
reference directions.  By the triangle inequality of angles, those of an anchor and of a
row bound the angle between them from both sides; the cosines of the bounds, multiplied
by the norms and widened by more than the rounding errors, bound the score.  Rows are
stored in blocks of neighbouring angles with the ranges of their angles and norms, so a
whole block is passed over at once where its bounds miss an anchor's windows; inside the
blocks that are left the same test is made for each row, and only rows whose bounds
overlap an open window are scored, by exact integer inner products.

Two passes: one for the anchors' best rows of their own label (the positives), one for
the best rows of other labels whose score lies in the window of a positive.  An open
window narrows as better rows are found.  Each task returns at most the wanted number of
rows for each anchor or positive; they meet in a ranked aggregation.

Anchors go round in groups of at most ``ROUND_ANCHORS``, a stated bound on what is sent
to the workers; each group is held against all blocks.  Reference directions are means
of labels in a bounded sample (``SAMPLE`` rows); they affect speed only.

Defined results: rows with a null label, or whose vector is null, empty, of another
length than most, or holds a null or non-finite entry, take no part; a row with a NULL id
is no anchor, and its id counts as the largest; repeated rows are rows of their own, so a
repeated anchor has its rows twice and each copy may be the other's positive; ties go to
the smaller id; an anchor without positives, or a positive without negatives in its
window, gives no row; an empty table gives no rows.  Integer entries must lie below
2**25 / sqrt(dimension).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nitrapanel.llm.frames import arrow_map, hash_sample
from nitrapanel.llm.vectors import matrix, whole_vectors
from nitrapanel.session import materialize, scratch_path

SCALE = 256  # an entry x becomes floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # hundredths of the positive's score between which a negative lies
REFERENCES = 12
SAMPLE = 2_000  # rows the reference directions are made of
BLOCK = 512  # rows stored together
ROUND_ANCHORS = 8_192  # anchors sent at a time
STEP_ANCHORS = 1_024  # anchors held against a block at a time
SLACK = 1e-6  # radians: more than the error of an angle made in double precision
NO_ID = (1 << 63) - 1
NONE = -(1 << 62)

BLOCKS = "cell int, ids binary, labels binary, vectors binary, norms binary, angles binary"
FOUND = "anchor long, slot int, id long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# -- angles and bounds ----------------------------------------------------------------


def angles_to(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles of each row to each unit reference); a zero vector has right angles."""
    norms = np.linalg.norm(vectors, axis=1)
    cosine = (vectors @ references.T) / np.where(norms > 0, norms, 1.0)[:, None]
    return norms, np.arccos(np.clip(cosine, -1.0, 1.0))


def angle_interval(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the angle between points whose angles to one reference lie in two ranges."""
    least = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0.0)
    both = high_a + high_b
    # Past a half turn the way round the other side is the shorter.
    most = np.where(both <= np.pi, both, np.minimum(np.pi, 2 * np.pi - (low_a + low_b)))
    return least, most


def score_bounds(least: np.ndarray, most: np.ndarray, low_norm: np.ndarray, high_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner product from those of the angle and of the product of the norms."""
    high = np.cos(np.clip(least - SLACK, 0.0, np.pi))
    low = np.cos(np.clip(most + SLACK, 0.0, np.pi))
    upper = np.where(high >= 0, high * high_norm, high * low_norm)
    lower = np.where(low >= 0, low * low_norm, low * high_norm)
    widen = 1.0 + 1e-9 * high_norm
    return np.floor(lower - widen), np.ceil(upper + widen)


def bounds(norm_a: np.ndarray, angles_a: np.ndarray, norm_b: np.ndarray, angles_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds of all rows ``a`` against all rows ``b``."""
    least, most = np.zeros((len(norm_a), len(norm_b))), np.full((len(norm_a), len(norm_b)), np.pi)
    for r in range(angles_a.shape[1]):
        a, b = angles_a[:, r, None], angles_b[None, :, r]
        np.maximum(least, np.abs(a - b), out=least)
        both = a + b
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    product = norm_a[:, None] * norm_b[None, :]
    return score_bounds(least, most, product, product)


# -- blocks -----------------------------------------------------------------------------


class Block:
    """Rows of one stored block, or the anchors of a round."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, norms: bytes, angles: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        n = len(self.ids)
        self.vectors = np.frombuffer(vectors, "<i4").reshape(n, -1)
        self.norms, self.angles = np.frombuffer(norms, "<f8"), np.frombuffer(angles, "<f8").reshape(n, -1)

    def overlap(self, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score bounds of each given row against the block as a whole."""
        low, high = self.angles.min(axis=0), self.angles.max(axis=0)
        least, most = angle_interval(angles, angles, low[None, :], high[None, :])
        return score_bounds(least.max(axis=1), most.min(axis=1), norms * self.norms.min(), norms * self.norms.max())


def references_of(rows: DataFrame, dimension: int) -> np.ndarray:
    """Unit directions: means of the commonest labels in the sample, filled up with seeded random ones."""
    got = hash_sample(rows.select("id", "label", "x"), "id", SAMPLE).collect()  # at most SAMPLE rows
    out = np.random.default_rng(23).standard_normal((REFERENCES, dimension))
    if got:
        labels, x = np.array([r["label"] for r in got]), np.array([r["x"] for r in got], dtype=np.float64)
        names, counts = np.unique(labels, return_counts=True)
        for i, name in enumerate(names[np.argsort(-counts, kind="stable")][:REFERENCES]):
            mean = x[labels == name].mean(axis=0)
            if np.linalg.norm(mean) > 0:
                out[i] = mean
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def integers(rows: DataFrame, label: F.Column, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """``id, label, x`` of the rows that take part, and the dimension."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    own, dimension = whole_vectors(rows, vector_col, {"id": ids, "label": label.cast("long")})
    x = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("int"))
    return own.where("label IS NOT NULL").select("id", "label", x.alias("x")), dimension


def store_blocks(rows: DataFrame, dimension: int, references: np.ndarray) -> DataFrame:
    """Blocks in the shared folder: rows are ordered by their nearest reference and the angle to it.

    The id is the last key of the order, so any number of equal vectors spreads over tasks.
    """
    placed_type = "id long, label long, x array<int>, cell int, near double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, angles = angles_to(matrix(batch.column(2), dimension).astype(np.float64), references)
            cell = angles.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angles.min(axis=1))], ["id", "label", "x", "cell", "near"])

    placed = arrow_map(rows.select("id", "label", "x"), place, placed_type)
    ordered = placed.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for start, stop in zip(cuts, cuts[1:]):
                for at in range(start, stop, BLOCK):
                    part = batch.slice(at, min(BLOCK, stop - at))
                    if held and (held[0].column(3)[0] != part.column(3)[0] or sum(map(len, held)) + len(part) > BLOCK):
                        yield packed(held)
                        held = []
                    held.append(part)
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x = matrix(rows.column(2), dimension)
        norms, angles = angles_to(x.astype(np.float64), references)
        raw = [rows.column(0).to_numpy().astype("<i8"), rows.column(1).to_numpy().astype("<i8"), x.astype("<i4"), norms, angles]
        columns = [pa.array([rows.column(3)[0].as_py()], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in raw]]
        return pa.RecordBatch.from_arrays(columns, ["cell", "ids", "labels", "vectors", "norms", "angles"])

    return materialize(arrow_map(ordered, pack, BLOCKS), "angle_blocks")


# -- the search ---------------------------------------------------------------------------


class Best:
    """The best ``most`` (score, least id first) rows of each of n keys."""

    def __init__(self, n: int, most: int) -> None:
        self.most = most
        self.keys, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, NONE)  # the least score that may still enter

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(keys):
            return
        keys, scores, ids = np.concatenate([self.keys, keys]), np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        rank = np.arange(len(keys)) - np.repeat(first, np.diff([*first.tolist(), len(keys)]))
        stay = rank < self.most
        self.keys, self.scores, self.ids = keys[stay], scores[stay], ids[stay]
        full = rank == self.most - 1
        self.floor[keys[full]] = scores[full]


def candidate_pairs(anchors: Block, block: Block, low: np.ndarray, high: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, integer score) of the pairs whose bounds overlap the anchor's range."""
    for at in range(0, len(anchors.ids), STEP_ANCHORS):
        own = np.arange(at, min(at + STEP_ANCHORS, len(anchors.ids)))
        own = own[high[own] >= low[own]]
        lower, upper = block.overlap(anchors.norms[own], anchors.angles[own])
        own = own[(upper >= low[own]) & (lower <= high[own])]
        if not len(own):
            continue
        lower, upper = bounds(anchors.norms[own], anchors.angles[own], block.norms, block.angles)
        open_ones = (upper >= low[own, None]) & (lower <= high[own, None])
        alike = anchors.labels[own, None] == block.labels[None, :]
        a, b = np.nonzero(open_ones & (alike if same else ~alike))
        if len(a):
            a = own[a]
            scores = np.empty(len(a), np.int64)
            for part in range(0, len(a), 1 << 16):
                piece = slice(part, part + (1 << 16))
                scores[piece] = np.einsum("ij,ij->i", anchors.vectors[a[piece]], block.vectors[b[piece]], dtype=np.int64)
            yield a, b, scores


def search_positives(anchors: Block, blocks: Iterator[Block], most: int) -> Best:
    """Best rows of the anchor's label; the anchor's own row is taken out once."""
    best, top = Best(len(anchors.ids), most + 1), np.full(len(anchors.ids), -NONE)
    for block in blocks:
        for a, b, scores in candidate_pairs(anchors, block, best.floor, top, True):
            keep = scores >= best.floor[a]
            best.add(a[keep], scores[keep], block.ids[b[keep]])
    return best


def search_negatives(anchors: Block, positives: np.ndarray, blocks: Iterator[Block], most: int, least_part: int, most_part: int) -> Best:
    """Best rows of other labels in the window of each positive.

    ``positives`` holds the scores, anchor x slot, ``NONE`` where there is none; keys are
    anchor * slots + slot.
    """
    n, slots = positives.shape
    there = positives != NONE
    low = -((-least_part * positives) // 100)  # rounded up
    high = (most_part * positives) // 100
    there &= low <= high
    low, high = np.where(there, low, -NONE), np.where(there, high, NONE)
    best = Best(n * slots, most)
    for block in blocks:
        floor = np.maximum(low, best.floor.reshape(n, slots))
        for a, b, scores in candidate_pairs(anchors, block, floor.min(axis=1), high.max(axis=1), False):
            for slot in range(slots):
                keep = (scores >= floor[a, slot]) & (scores <= high[a, slot])
                best.add(a[keep] * slots + slot, scores[keep], block.ids[b[keep]])
    return best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(*[c[row].as_py() for c in batch.columns])


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _emit(best: Best, slots: int) -> Iterator[pa.RecordBatch]:
    columns = [best.keys // slots, (best.keys % slots).astype(np.int32), best.ids, best.scores]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "id", "score"])


def anchor_rounds(blocks: DataFrame, every: int, size: int) -> Iterator[Block]:
    """Anchors (ids divisible by ``every``) in groups of about ``size``."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            chosen = np.flatnonzero((block.ids % every == 0) & (block.ids != NO_ID))
            if len(chosen):
                raw = [block.ids, block.labels, block.vectors, block.norms, block.angles]
                columns = [pa.array([len(chosen)], pa.int64()), *[pa.array([c[chosen].tobytes()], pa.binary()) for c in raw]]
                yield pa.RecordBatch.from_arrays(columns, ["n", "ids", "labels", "vectors", "norms", "angles"])

    picked = arrow_map(blocks.drop("cell"), pick, "n long, ids binary, labels binary, vectors binary, norms binary, angles binary")
    picked = materialize(picked, "anchors")
    total = picked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = -(-total // size)
    for turn in range(rounds):
        # About ``size`` anchors: blocks are dealt over the rounds by a hash of their ids.
        got = picked.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == turn).collect()
        if got:
            yield _joined(got)


def _joined(rows: list) -> Block:
    return Block(*[b"".join(bytes(r[c]) for r in rows) for c in ("ids", "labels", "vectors", "norms", "angles")])


def mine(
    rows: DataFrame,
    label: F.Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (LEAST, MOST),
    scale: int = SCALE,
    round_anchors: int = ROUND_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; each round is a table in the shared folder."""
    spark = rows.sparkSession
    own, dimension = integers(rows, F.col("label") if label is None else label, id_col, vector_col, scale)
    empty = spark.createDataFrame([], MINED)
    if not dimension:
        return empty
    blocks = store_blocks(own, dimension, references_of(own, dimension))
    path, rounds = scratch_path(spark, "negatives"), 0
    for anchors in anchor_rounds(blocks, every, round_anchors):
        _one_round(blocks, anchors, positives, negatives, window).write.parquet(f"{path}/{rounds}")
        rounds += 1
    return spark.read.schema(MINED).parquet(*[f"{path}/{i}" for i in range(rounds)]) if rounds else empty


def _one_round(blocks: DataFrame, anchors: Block, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """One group of anchors against all blocks."""
    spark = blocks.sparkSession
    n = len(anchors.ids)
    sent = spark.sparkContext.broadcast(anchors)  # bounded by the size of a round

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(search_positives(sent.value, _blocks(batches), positives), 1)

    # At most one row more than the positives of each anchor of the round.
    got = _ranked(arrow_map(blocks.drop("cell"), find, FOUND), positives + 1).collect()
    ids, scores = np.full((n, positives), NO_ID), np.full((n, positives), NONE)
    by: dict[int, list] = {}
    for row in sorted(got, key=lambda r: (r["anchor"], r["rank"])):
        by.setdefault(row["anchor"], []).append((row["id"], row["score"]))
    squares = np.einsum("ij,ij->i", anchors.vectors, anchors.vectors, dtype=np.int64)
    for anchor, best in by.items():
        own = (int(anchors.ids[anchor]), int(squares[anchor]))
        if own in best:
            best.remove(own)
        for slot, (row_id, score) in enumerate(best[:positives]):
            ids[anchor, slot], scores[anchor, slot] = row_id, score
    known = spark.sparkContext.broadcast((ids, scores))

    def mine_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search_negatives(sent.value, known.value[1], _blocks(batches), negatives, *window)
        yield from _emit(best, positives)

    ranked = _ranked(arrow_map(blocks.drop("cell"), mine_blocks, FOUND), negatives)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (positive_ids, positive_scores) = sent.value, known.value
        for batch in batches:
            a, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            named = lambda x: pa.array(x, mask=x == NO_ID)
            columns = [pa.array(own.ids[a]), named(positive_ids[a, slot]), batch.column(4), named(batch.column(2).to_numpy()), pa.array(positive_scores[a, slot]), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return arrow_map(ranked, name, MINED)
