"""Language identification (operator 2).

Method: letter n-grams inside words, with the word's borders, are hashed into buckets;
each bucket has an embedding, a text is the average of its buckets' embeddings, and a
linear softmax over that average gives the languages.  Embeddings and softmax are
trained together by stochastic gradient descent in numpy.  A temperature fitted on rows
kept from training calibrates the probabilities, and predictions below a confidence
chosen on those rows are marked as rejected.

The fit sees at most ``TRAIN_ROWS`` labelled rows (a documented bound), chosen by a hash
of the id; their n-grams are counted by Spark tasks, so the driver gets bounded counts,
never texts.  At prediction the average and the softmax are linear, so they collapse to
one row of class scores for each bucket, which tasks look up and add over whole texts.

Defined results: a text that is NULL or has no letter is ``und`` with score 0; without
labelled rows every text is; with one language in the labels every text with a letter is
of that language with score 1; repeated rows are predicted alike; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrapanel.llm.frames import arrow_map, hash_sample, record_batch, small_batches
from nitrapanel.llm.signs import LETTER, slices, sums, tables
from nitrapanel.llm.tokens import _arrow

TRAIN_ROWS = 4_000
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15  # for each order
DIM = 16
EPOCHS = 6
RATE = 0.5
HELD_BACK = 5  # every fifth training row calibrates
ACCEPTED_ERROR = 0.01
UNKNOWN = "und"

COUNTS = "label string, buckets binary, counts binary"
PREDICTION = "lang_pred string, score double, rejected boolean"


def bucket_runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, which of them count, piece starts, piece lengths, text numbers) of each n-gram order.

    A run covers the code points of some texts; letters are lower-cased, everything else
    is a border.  An n-gram counts if it has no border inside and is not all borders.
    """
    classes, lower = tables()
    ahead = max(ORDERS) - 1
    for signs, starts, lengths, numbers in slices(texts, ahead):
        letters = np.where(classes[signs] & LETTER, lower[signs], 0).astype(np.uint64)
        inside = letters != 0
        n = len(letters) - ahead
        if n <= 0:
            continue
        mixed = letters[:n].copy()
        whole = np.ones(n, bool)  # all but the first and the last are letters
        for k in range(1, max(ORDERS)):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + letters[k : n + k]
            if k > 1:
                whole &= inside[k - 1 : n + k - 1]
            if k + 1 in ORDERS:
                good = whole & (inside[:n] | inside[k : n + k]) if k == 1 else whole
                hashed = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15)
                yield hashed.astype(np.int64) + ORDERS.index(k + 1) * BUCKETS, good, starts, lengths, numbers


def has_letter(texts: list[str]) -> list[bool]:
    return [any(map(str.isalpha, t)) for t in texts]


class Model(NamedTuple):
    labels: list[str]
    table: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float


def counted(rows: DataFrame, text_col: str, label_col: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Label, distinct buckets and their counts of each of a bounded number of rows."""
    schema = _arrow(rows.sparkSession, COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts in small_batches(batches, "label", "text"):
            found: list[dict[int, int]] = [{} for _ in texts]
            for buckets, good, starts, lengths, numbers in bucket_runs(texts):
                for start, length, number in zip(starts.tolist(), lengths.tolist(), numbers.tolist()):
                    part = buckets[start : start + length][good[start : start + length]]
                    own = found[number]
                    for b, c in zip(*(a.tolist() for a in np.unique(part, return_counts=True))):
                        own[b] = own.get(b, 0) + c
            raw = [(np.fromiter(f.keys(), "<i4", len(f)).tobytes(), np.fromiter(f.values(), "<i4", len(f)).tobytes()) for f in found]
            yield record_batch(schema, {"label": labels, "buckets": [r[0] for r in raw], "counts": [r[1] for r in raw]})

    some = rows.select(F.col(label_col).alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = arrow_map(some, run, COUNTS).collect()
    return [(r["label"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4").astype(np.float64)) for r in got]


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 11) -> Model:
    """Gradient descent over the examples, then calibration on those that were kept back."""
    examples = [e for e in examples if len(e[1])]
    labels = sorted({e[0] for e in examples})
    table = np.zeros((len(ORDERS) * BUCKETS, max(1, len(labels))), np.float32)
    bias = np.zeros(max(1, len(labels)))
    if len(labels) < 2:
        return Model(labels, table, bias, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    kept = [examples[i] for i in order[::HELD_BACK]]
    used = [examples[i] for i in np.delete(order, np.arange(0, len(order), HELD_BACK))]
    used = used or kept
    embed = rng.normal(0, 0.1, (len(table), DIM))
    weight = np.zeros((DIM, len(labels)))
    weight[:] = rng.normal(0, 0.1, weight.shape)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(used)):
            label, buckets, counts = used[i]
            share = counts / counts.sum()
            mean = share @ embed[buckets]
            wrong = _softmax(mean @ weight + bias)
            wrong[labels.index(label)] -= 1
            back = weight @ wrong
            weight -= rate * np.outer(mean, wrong)
            bias -= 0.1 * rate * wrong
            # A bucket's gradient is as small as its share; scaling by the number of buckets evens that out.
            embed[buckets] -= rate * len(buckets) * 0.05 * np.outer(share, back)
    table = (embed @ weight).astype(np.float32)
    scores = np.array([(c / c.sum()) @ table[b] + bias for _, b, c in kept])
    truth = np.array([labels.index(e[0]) for e in kept])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = _softmax(scores / temperature)
    best, right = sure.max(axis=1), sure.argmax(axis=1) == truth
    threshold = float(np.quantile(best, 0.001)) * 0.9
    for limit in np.sort(best):
        if (~right[best >= limit]).mean() <= ACCEPTED_ERROR:
            threshold = max(threshold, float(limit)) if limit > best.min() else threshold
            break
    return Model(labels, table, bias, temperature, threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int = TRAIN_ROWS) -> Model:
    """Model from at most ``most`` rows with a label."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    picked = hash_sample(rows.select(F.col(id_col).alias("_picked")), "_picked", most)
    texts = rows.join(F.broadcast(picked), F.col(id_col) == F.col("_picked"), "left_semi")
    # A repeated id gives one example, so the bound holds for rows as well.
    texts = texts.groupBy(id_col).agg(F.max(F.struct(F.col(label_col).alias("label"), F.col(text_col).alias("text"))).alias("x"))
    examples = counted(texts.select("x.*"), "text", "label")
    return train(sorted(examples, key=lambda e: (e[0], e[1].tobytes(), e[2].tobytes())))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    plain = [t or "" for t in texts]
    n, classes = len(plain), len(model.labels)
    if not classes:
        return [UNKNOWN] * n, [0.0] * n, [True] * n
    total, count = np.zeros((n, classes)), np.zeros(n)
    for buckets, good, starts, lengths, numbers in bucket_runs(plain):
        size = len(buckets)
        ends = np.minimum(starts + lengths, size)
        begins = np.minimum(starts, size)
        values = model.table[buckets]
        values[~good] = 0
        np.add.at(total, numbers, sums(values, begins, ends - begins))
        np.add.at(count, numbers, sums(good, begins, ends - begins))
    sure = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    best, letters = sure.argmax(axis=1), has_letter(plain)
    names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
    scores = [float(sure[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters))]
    return names, scores, [not ok or s < model.threshold for s, ok in zip(scores, letters)]


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``rejected``."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    source = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("text"))
    fields = source.drop("text").schema
    for name in PREDICTION.split(", "):
        fields = fields.add(*name.split())
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the table's size is fixed by the buckets
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [f"k_{i}" for i in range(len(names))]
        for *kept, texts in small_batches(batches, *columns, "text"):
            got = score_texts(sent.value, texts)
            yield record_batch(schema, dict(zip(schema.names, [*kept, *got])))

    return arrow_map(source, run, fields).withColumnsRenamed({f"k_{i}": c for i, c in enumerate(names)})
