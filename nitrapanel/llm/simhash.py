"""SimHash near-duplicates through vantage-point trees (operator 8).

Fingerprint: a bit is set if it is set in more than half of the hashes of the document's
word shingles (repeats included).  Documents whose fingerprints differ in at most
``MOST_BITS`` bits are linked, and links are closed into components.

Method: two fingerprints within four (up to seven) bits agree within one bit on at least
one of four blocks of 16 bits, so pairs are searched in each block's Hamming space with radius one,
where triangle bounds prune; the whole fingerprint is compared at the leaves.  Per block
a vantage-point tree cuts the space at distances from vantage points.  Its upper levels
are the shards: a fingerprint goes to the side of the ball it lies in, and one that lies
inside within the radius of the border goes to the outer side as well, so every pair
meets in some shard.  The lower levels are searched inside the shard's task by the same
rule.  Each leaf returns only a spanning forest of its links.

Equal fingerprints are collapsed first, so copies never meet each other.  A block has 65,536
values only, so with more rows its shards grow.  A linked pair has few differing bits on a
second block too (one at most, for four in all), so the members of a dense shard go on to
the shards of the trees over the other three blocks, as deep as the largest shard asks for,
wherever their counts say that less is moved then.  What stays dense (one ball of alike
fingerprints) is dealt into tiles of bounded size which meet pairwise, and a leaf that no
vantage point splits is searched breadth-first: what is linked already is not compared
again.  Forests are joined by rounds of large-star and small-star over
tables in the shared folder; no link, component or fingerprint reaches the driver apart
from a bounded sample that shapes the tree (its quality affects speed only).

Defined results: NULL text is the empty text; texts without words have fingerprint zero
and are linked like any others; rows with NULL ids link like any others and get the
component of their fingerprint, but name none, so a component of such rows alone has a
NULL id; repeated rows are returned each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from nitrapanel.llm.fingerprints import words_of
from nitrapanel.llm.frames import arrow_map, hash_sample
from nitrapanel.session import materialize

WORDS = 4
MOST_BITS = 4
BLOCKS = 4  # 16 bits each; four to seven differing bits leave one block with at most one
BLOCK_BITS = 16
SAMPLE = 20_000  # fingerprints that shape the trees
SHARD_ROWS = 4_000  # members a shard is meant to have
MOST_LEVELS = 12  # of shards, for the first block and again for the second; the rest of the tree is inside the tasks
LEAF = 96  # members that are compared all with all
TILE = 20_000  # members of a group: of a part of a dense shard, or of a tile


# -- fingerprints ------------------------------------------------------------------


def fingerprints(docs: DataFrame, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text", kept: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, fp`` and the ``kept`` columns: hashes of all shingles inside Spark, the majority of each bit in numpy."""
    folded = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    more = [c.alias(n) for n, c in (kept or {}).items()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(folded).alias("words"), *more)
    long = F.transform(
        F.sequence(F.lit(0), F.size("words") - width),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("words", i + k) for k in range(width)])),
    )
    short = F.array(F.xxhash64(F.array_join("words", " ")))
    hashes = F.when(F.size("words") >= width, long).when(F.size("words") > 0, short).otherwise(F.array().cast("array<bigint>"))
    source = rows.select("doc_id", hashes.alias("hashes"), *(kept or {}))
    fields = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *source.schema.fields[2:]])
    return arrow_map(source, _majorities, fields)


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        out = np.zeros(len(ends), dtype=np.uint64)
        start = 0
        for i, end in enumerate(ends.tolist()):
            out[i] = majority(values[start:end])
            start = end
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The bits that are set in more than half of the 64-bit hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step], dtype="<i8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * total > len(hashes)))


# -- vantage-point trees -------------------------------------------------------------


def block_of(fps: np.ndarray, block: int) -> np.ndarray:
    return ((fps >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)


class Node:
    """A ball around ``vantage``: up to ``limit`` inside, the rest outside.  A leaf has a number."""

    __slots__ = ("vantage", "limit", "inner", "outer", "leaf")

    def __init__(self, vantage: int = 0, limit: int = -1, inner: Node | None = None, outer: Node | None = None, leaf: int = -1) -> None:
        self.vantage, self.limit, self.inner, self.outer, self.leaf = vantage, limit, inner, outer, leaf


def best_ball(values: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """Vantage point and limit that cut the values most evenly with few on the border; None if nothing cuts them."""
    best, found = 1.0, None
    for vantage in rng.choice(values, min(6, len(values)), replace=False).tolist():
        near = np.bitwise_count(values ^ np.uint16(vantage))
        total = np.cumsum(np.bincount(near, minlength=BLOCK_BITS + 1)) / len(values)
        for limit in range(BLOCK_BITS):
            if 0 < total[limit] < 1:
                border = total[limit] - (total[limit - radius] if limit >= radius else 0)
                cost = total[limit] ** 2 + (1 - total[limit] + border) ** 2
                if cost < best:
                    best, found = cost, (vantage, limit)
    return found


def grow(values: np.ndarray, levels: int, radius: int, rng: np.random.Generator, leaves: list[int]) -> Node:
    ball = best_ball(values, radius, rng) if levels and len(values) > 1 else None
    if ball is None:
        leaves.append(len(leaves))
        return Node(leaf=leaves[-1])
    near = np.bitwise_count(values ^ np.uint16(ball[0]))
    inner = grow(values[near <= ball[1]], levels - 1, radius, rng, leaves)
    outer = grow(values[near > ball[1] - radius], levels - 1, radius, rng, leaves)
    return Node(*ball, inner, outer)


def routes(node: Node, radius: int) -> list[np.ndarray]:
    """For each leaf the block values that go there: those of its balls and of the borders it overlaps."""
    out: list[np.ndarray] = []

    def walk(at: Node, values: np.ndarray) -> None:
        if at.leaf >= 0:
            out.append(values)
            return
        near = np.bitwise_count(values ^ np.uint16(at.vantage))
        walk(at.inner, values[near <= at.limit])
        walk(at.outer, values[near > at.limit - radius])

    walk(node, np.arange(1 << BLOCK_BITS, dtype=np.uint16))
    return out


def routing(sample: np.ndarray, total: int, radius: int, seed: int = 5, shard_rows: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block (offsets, shards): the shards of block value *v* are ``shards[offsets[v]:offsets[v + 1]]``."""
    levels = int(min(MOST_LEVELS, max(0, np.ceil(np.log(max(total, 1) / (shard_rows or SHARD_ROWS)) / np.log(1 / 0.6)))))
    rng, out = np.random.default_rng(seed), []
    for block in range(BLOCKS):
        values = block_of(sample, block)
        leaves = routes(grow(values, levels, radius, rng, []), radius)
        owner = np.repeat(np.arange(len(leaves)), [len(v) for v in leaves])
        value = np.concatenate(leaves)
        order = np.argsort(value, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << BLOCK_BITS))])
        out.append((offsets.astype(np.int32), owner[order].astype(np.int32)))
    return out


def members(fps: np.ndarray, block: int, table: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shards): every shard of the block to which each fingerprint goes."""
    offsets, shards = table[block]
    values = block_of(fps, block).astype(np.int64)
    counts = offsets[values + 1] - offsets[values]
    rows = np.repeat(np.arange(len(fps)), counts)
    first = np.repeat(offsets[values] - (np.cumsum(counts) - counts), counts)
    return rows, shards[first + np.arange(len(rows))]


class Forest:
    """Union-find over positions; the root is the least position."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def links(fps: np.ndarray, block: int, forest: Forest, most_bits: int = MOST_BITS, seed: int = 3, radius: int | None = None) -> None:
    """Join all members within ``most_bits`` that agree within the radius on the block."""
    values, rng = block_of(fps, block), np.random.default_rng(seed)
    radius = most_bits // BLOCKS if radius is None else radius
    todo = [np.arange(len(fps))]
    while todo:
        rows = todo.pop()
        ball = best_ball(_some(values[rows], rng), radius, rng) if len(rows) > LEAF else None
        if ball is not None:
            near = np.bitwise_count(values[rows] ^ np.uint16(ball[0]))
            inner, outer = rows[near <= ball[1]], rows[near > ball[1] - radius]
            if len(inner) < len(rows) and len(outer) < len(rows):
                todo += [inner, outer]
                continue
        if len(rows) > 1024:
            _breadth_first(fps, rows, forest, most_bits)
        elif len(rows) > 1:
            own = fps[rows]
            close = np.bitwise_count(own[:, None] ^ own[None, :]) <= most_bits
            a, b = np.nonzero(np.triu(close, 1))
            for x, y in zip(rows[a].tolist(), rows[b].tolist()):
                forest.join(x, y)


def _some(values: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return values if len(values) <= 4096 else rng.choice(values, 4096, replace=False)


def _breadth_first(fps: np.ndarray, rows: np.ndarray, forest: Forest, most_bits: int) -> None:
    """Links of a dense leaf: members reached already are never compared with each other."""
    rest = rows
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                open_ones = np.flatnonzero(~reached)
                if not len(open_ones):
                    break
                part = front[at : at + 64]
                close = np.bitwise_count(fps[part][:, None] ^ fps[rest[open_ones]][None, :]) <= most_bits
                hit = close.any(axis=0)
                for x, y in zip(part[close[:, hit].argmax(axis=0)].tolist(), rest[open_ones[hit]].tolist()):
                    forest.join(x, y)
                reached[open_ones[hit]] = True
            front, rest = rest[reached], rest[~reached]


# -- the distributed search ------------------------------------------------------------


def forest_edges(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``a, b``: edges between names of distinct fingerprints whose closure is that of all links.

    ``prints`` has one row for each distinct fingerprint: ``fp`` and ``rep``, its name.
    """
    spark = prints.sparkSession
    total = prints.count()
    got = hash_sample(prints.select("fp"), "fp", SAMPLE).collect()  # bounded by SAMPLE
    sample = np.array([r["fp"] for r in got], dtype=np.int64).view(np.uint64)
    # Block values x shards: its size depends on the levels only.
    sent = spark.sparkContext.broadcast(routing(sample, total, most_bits // BLOCKS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for block in range(BLOCKS):
                rows, shard = members(fps, block, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block, np.int32)), pa.array(shard), *batch.take(pa.array(rows)).columns], ["block", "shard", "fp", "rep"])

    placed = arrow_map(prints.select("fp", "rep"), place, "block int, shard int, fp long, rep long")
    narrow = most_bits // (BLOCKS - 1)  # of four blocks the second best differs in no more bits

    def search(key: tuple, table: pa.Table) -> pa.Table:
        """Spanning forest of the links in one shard (or one pair of tiles)."""
        fps = table.column("fp").to_numpy().view(np.uint64)
        reps = table.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        fps, reps = fps[order], reps[order]
        forest = Forest(len(fps))
        block, second = key[0].as_py(), key[2].as_py()
        links(fps, block if second < 0 else second, forest, most_bits, radius=most_bits // BLOCKS if second < 0 else narrow)
        up = np.array([forest.find(i) for i in range(len(fps))], dtype=np.int64)
        child = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": pa.array(reps[child]), "b": pa.array(reps[up[child]])})

    dealt = deal(placed, sample, narrow)
    return dealt.groupBy("block", "shard", "second", "part", "meet").applyInArrow(search, "a long, b long").distinct()


def deal(placed: DataFrame, sample: np.ndarray, narrow: int) -> DataFrame:
    """``block, shard, second, part, meet, fp, rep``: groups of bounded size in which every linked pair meets.

    ``second`` is -1 in a shard that is not split by another block; ``part`` is the shard of
    the second block's tree; ``meet`` numbers the pairs of tiles.
    """
    home, finer_home = ["block", "shard"], ["block", "shard", "second", "part"]
    tiles = lambda n: F.ceil(F.col(n) / TILE)
    # Shards and parts with more than one tile: rows of counts, one for each.
    dense = materialize(placed.groupBy(*home).agg(F.count("*").alias("n")).where(F.col("n") > TILE), "dense")
    largest = dense.agg(F.max("n")).first()[0] or 0
    whole = placed.withColumns({"second": F.lit(-1), "part": F.lit(0)})
    if not largest:
        return whole.select(*finer_home, F.lit(0).cast("long").alias("meet"), "fp", "rep")
    # Three other blocks make three copies at least, so fewer tiles than that cannot gain.
    wide = dense.where(tiles("n") >= BLOCKS)
    sent = placed.sparkSession.sparkContext.broadcast(routing(sample, largest, narrow, seed=6, shard_rows=TILE))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            home_block = batch.column(0).to_numpy()
            for second in range(BLOCKS):
                rows, part = members(fps, second, sent.value)
                other = home_block[rows] != second
                rows, part = rows[other], part[other]
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(rows)).columns, pa.array(np.full(len(rows), second, np.int32)), pa.array(part)],
                    ["block", "shard", "fp", "rep", "second", "part"],
                )

    def parts_of(shards: DataFrame) -> DataFrame:
        own = placed.join(shards.select(*home), home, "left_semi").select(*home, "fp", "rep")
        return arrow_map(own, split, "block int, shard int, fp long, rep long, second int, part int")

    counts = materialize(parts_of(wide).groupBy(*finer_home).agg(F.count("*").alias("m")), "parts")
    moved = counts.groupBy(*home).agg(F.sum(F.col("m") * tiles("m")).alias("moved"))
    finer = materialize(wide.join(moved, home).where(F.col("moved") < F.col("n") * tiles("n")).select(*home), "finer")
    size = dense.join(finer, home, "left_anti").select(*home, F.lit(-1).alias("second"), F.lit(0).alias("part"), tiles("n").alias("tiles"))
    size = size.unionByName(counts.where(tiles("m") > 1).select(*finer_home, tiles("m").alias("tiles")))
    rows = whole.join(finer, home, "left_anti").unionByName(parts_of(finer))
    rows = rows.join(size, finer_home, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)).cast("int"))
    # Members are dealt into tiles by a hash, and every pair of tiles meets once.
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("long")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1), lambda o: F.least(o, tile) * F.col("tiles") + F.greatest(o, tile))
    return rows.withColumn("meet", F.explode(pairs)).select(*finer_home, "meet", "fp", "rep")


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the least id of its component for every id that has an edge.

    Large-star and small-star in turn; every round writes its edges to the shared folder,
    so a lost executor costs one round at most, and the loop ends when nothing changes.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    state = None
    while True:
        # Large star: every larger neighbour is linked to the least of the neighbourhood.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        large = materialize(large.where("a <> b"), "large")
        # Small star: an id and its smaller neighbours are linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        up = large.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
        edges = materialize(up.where("a <> b").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = tuple(now)


def near_duplicates(
    docs: DataFrame,
    width: int = WORDS,
    most_bits: int = MOST_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept: dict[str, Column] | None = None,
) -> DataFrame:
    """``doc_id, fp, root, component_id`` and the ``kept`` columns for every row; texts are read once.

    ``root`` is the least fingerprint of the component, the same for all its rows and for
    no others; ``component_id`` is its least id, NULL if it has none.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col, kept), "prints")
    # Fingerprints are linked whatever their ids; ids only name what has been linked.
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = components(forest_edges(reps.select("fp", F.col("fp").alias("rep")), most_bits))
    rooted = reps.join(roots, reps["fp"] == roots["id"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "root", "component_id", *(kept or {}))


def one_of_each(docs: DataFrame, width: int = WORDS, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the least id stays.

    A row without an id comes after those with one; of several rows with the least id the
    one of the least text hash stays, and of rows of equal id and text one.
    """
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = near_duplicates(docs, width, most_bits, id_col, text_col, {"text_key": key})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    stays = found.groupBy("root").agg(first.alias("s")).select("s._id", "s._key").distinct()
    rows = docs.withColumn("_text_key", key).withColumn("_row_id", F.col(id_col).cast("long"))
    rows = rows.join(stays, rows["_row_id"].eqNullSafe(stays["_id"]) & (rows["_text_key"] == stays["_key"]), "left_semi")
    return rows.dropDuplicates(["_row_id", "_text_key"]).select(*docs.columns)
