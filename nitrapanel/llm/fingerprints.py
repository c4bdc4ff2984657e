"""Bottom-k sketches of word shingles (operator 5), DataFrame functions only.

Method: a document's sketch is the ``k`` smallest distinct hashes of its shingles, as an
ascending array.  Sketches of parts merge into the sketch of the whole (union, then the
``k`` smallest), and estimate resemblance, containment and the number of distinct
shingles.  Below ``k`` shingles all three are exact.

Defined results: NULL is the empty text; a text of fewer words than a shingle has its
whole word sequence as its one shingle; a text without words has the empty sketch, which
resembles another empty one fully and anything else not at all; equal texts have equal
sketches; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nitrapanel.llm.rules import BLANKS

K = 128  # hashes a sketch keeps: a standard error of about 0.04 on a resemblance of 0.5
WORDS = 5  # words of a shingle
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def shingle_hashes(words: str, width: int = WORDS) -> Column:
    """Hashes of all shingles of the array column ``words``, one after the other."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
    )
    short = F.array(F.xxhash64(F.array_join(words, " ")))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= width, hashes).when(F.size(words) > 0, short).otherwise(none)


def add_sketch(rows: DataFrame, text: Column, name: str, k: int = K, width: int = WORDS) -> DataFrame:
    """``rows`` with the sketch of ``text`` as column ``name``."""
    held = f"_{name}_words"
    out = rows.withColumn(held, words_of(text))
    return out.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingle_hashes(held, width))), 1, k)).drop(held)


def merged(a: str, b: str, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Share of the joint sketch that both have: the estimated Jaccard index."""
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(merged(a, b, k)), F.lit(1)))


def distinct_shingles(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, from the k-th hash beyond."""
    share = (F.get(a, F.lit(k - 1)).cast("double") - float(LOWEST)) / (float(HIGHEST) - float(LOWEST))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has as well.

    The k-th hash of either side bounds the range in which both sketches are complete.
    """
    last = F.least(
        F.when(F.size(a) >= k, F.get(a, F.lit(k - 1))).otherwise(F.lit(HIGHEST)),
        F.when(F.size(b) >= k, F.get(b, F.lit(k - 1))).otherwise(F.lit(HIGHEST)),
    )
    own = F.filter(F.col(a), lambda x: x <= last)
    common = F.size(F.array_intersect(own, F.col(b)))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(common / F.greatest(F.size(own), F.lit(1)))


def merge_sketches(rows: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """Sketch of each group from its members' sketches.

    Hashes are made distinct and ranked by a hash aggregation and a bounded window, so a
    group with a third of all rows is spread over its hashes before it meets.
    """
    split = 64
    each = rows.select(*by, F.explode(sketch).alias("h")).distinct()
    part = each.withColumn("_part", F.pmod("h", F.lit(split)))
    first = part.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("h"))).where(F.col("_at") <= k)
    return first.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(sketch))


def as_text(sketch: str) -> Column:
    """The sketch as base64 of its hashes, eight bytes each, ascending."""
    raw = F.array_join(F.transform(F.col(sketch), lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.base64(F.unhex(raw))


def _longs(values: list[int]) -> Column:
    """One literal, however many values it has."""
    return F.lit(np.array(values, dtype=np.int64))


def _place(key: Column, starts: list[int]) -> Column:
    """Place of the last start that is not above the key: first among every g-th start, then among the g from there.

    With g near the root of their number a row is compared with few of the starts.
    """
    g = max(1, math.isqrt(len(starts)))
    coarse = F.size(F.filter(_longs(starts[::g]), lambda s: s <= key)) - 1
    fine = F.filter(F.slice(_longs(starts), coarse * g + 1, F.lit(g)), lambda s: s <= key)
    return coarse * g + F.size(fine) - 1


def with_next(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``, the text of the next id (after the last: of the first).

    Ids are cut at quantiles into ``parts`` ranges; every text goes to its range once, and
    the first rows of a range go to the range before as well, so no row has to look
    beyond its own range.  NULL ids come first; repeated ids follow each other by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    # A bounded number of range starts, all of them ids of the table.
    shares = [i / parts for i in range(parts)]
    edge = rows.select(key.alias("key")).agg(F.min("key"), F.percentile_approx("key", shares, 100 * parts)).first()
    starts = sorted({edge[0], *(edge[1] or [])}) if edge[0] is not None else [0]
    part = _place(key, starts)
    rows = rows.withColumn("key", key).withColumn("part", part)
    key, part = F.col("key"), F.col("part")
    first = F.element_at(_longs(starts), part + 1) == key
    before = F.when(part == 0, F.lit(len(starts) - 1)).otherwise(part - 1)
    own = F.struct(part.alias("part"), F.lit(0).alias("later"))
    copy = F.struct(before.alias("part"), F.lit(1).alias("later"))
    placed = rows.withColumn("_to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("_to.part").orderBy("_to.later", "key", "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where(F.col("_to.later") == 0).select("doc_id", "text", "next_text")
