"""Document quality from line labels of a conditional random field (operator 7).

Method: every line of a text is a node of a linear chain with the states bad and good.
A node's score adds up weights of its own binned measures and of those of the lines
before and after it; edges have transition weights.  Forward-backward gives each line's
probability of being good, and the probabilities, weighted by the lines' lengths, give
the document's quality.  A two-parameter logistic maps that to the score.

Labels are given for documents; those of the lines are latent.  The field starts from
lines that bear their document's label, without transitions, and is then fitted by
expectation and gradient steps: the lines' posterior is that of the field, shifted as
little as the document's label asks for (a good document has at least ``GOOD_SHARE`` of
its length good, a bad one at most ``BAD_SHARE``), and the weights and transitions move
towards the expectations under it.  So a bad document may have good lines and the other
way round, and the field learns to switch.

The fit sees at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of the id, and of
a document with more than ``TRAIN_LINES`` lines ``RUNS`` evenly spaced runs of lines laid
end to end (documented bounds); Spark tasks measure their lines in the whole text, the
driver gets the measures of these lines only.

Defined results: NULL is the empty text, a single empty line; texts are scored whole;
repeated rows are scored alike; without labelled rows of both kinds the score is the
share of good labels (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrapanel.llm.frames import arrow_map, hash_sample, record_batch, small_batches
from nitrapanel.llm.signs import BLANK, DIGIT, LETTER, SYMBOL, UPPER, slices, sums, tables
from nitrapanel.llm.tokens import _arrow

TRAIN_ROWS = 4_000
BINS = 8  # of each measure
TRAIN_LINES, RUNS = 256, 8
START_ROUNDS, ROUNDS = 60, 150  # with lines bearing their document's label; with latent ones
GOOD_SHARE, BAD_SHARE = 0.9, 0.5
RATE = 0.1
RIDGE = 1e-3
EXAMPLES = "label int, measures binary"
SCORES = [("score", "double"), ("predicted", "integer"), ("n_lines", "long"), ("bad_lines", "long")]


def line_measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(measures of all lines of all texts, number of lines of each text).  The last column is the length."""
    classes, _ = tables()
    split = [t.split("\n") for t in texts]
    lines = [x for own in split for x in own]
    n = len(lines)
    count = np.zeros((n, 6))
    for signs, starts, lengths, numbers in slices(lines):
        kind = classes[signs]
        solid = kind != BLANK
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        begin[starts[starts < len(begin)]] = solid[starts[starts < len(begin)]]
        for k, flag in enumerate(((kind & LETTER) > 0, (kind & UPPER) > 0, kind == DIGIT, kind == SYMBOL, solid, begin)):
            np.add.at(count[:, k], numbers, sums(flag, starts, lengths))
    letters, upper, digits, symbols, solids, words = count.T
    fresh, seen_before, repeated = np.ones(n), np.zeros(n), np.zeros(n)
    at = 0
    for own in split:
        seen: set[str] = set()
        met: set[str] = set()
        for line in own:
            parts = line.split()
            if parts:
                distinct = set(parts)
                fresh[at] = len(distinct) / len(parts)
                seen_before[at] = len(distinct & seen) / len(distinct)
                repeated[at] = line in met
                seen |= distinct
                met.add(line)
            at += 1
    some = np.maximum(solids, 1)
    measures = np.stack(
        [
            np.log2(1 + words),
            symbols / some,
            upper / np.maximum(letters, 1),
            digits / some,
            solids / np.maximum(words, 1),
            (solids - letters - digits - symbols) / some,
            fresh,
            seen_before,
            repeated,
            np.array([len(x) for x in lines], dtype=np.float64),
        ],
        axis=1,
    )
    return measures, np.array([len(own) for own in split])


def some_lines(n: int) -> np.ndarray:
    """Lines of a text of n lines that a fit sees: all, or evenly spaced runs."""
    if n <= TRAIN_LINES:
        return np.arange(n)
    run = TRAIN_LINES // RUNS
    starts = np.linspace(0, n - run, RUNS).astype(np.int64)
    return np.unique(starts[:, None] + np.arange(run))


class Model(NamedTuple):
    edges: np.ndarray  # bin borders of each measure
    weights: np.ndarray  # (before, own, after) x measure x bin: score of good over bad
    border: np.ndarray  # added where there is no line before or after
    bias: float
    moves: np.ndarray  # transition scores, from state to state
    scale: float  # of the final logistic
    shift: float
    share: float | None  # what is predicted when nothing could be learnt


def binned(measures: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, measures[:, k], side="right") for k, e in enumerate(edges)], axis=1)


def node_scores(bins: np.ndarray, sizes: np.ndarray, weights: np.ndarray, border: np.ndarray, bias: float) -> np.ndarray:
    """Score of good over bad of every line, from its own and its neighbours' bins."""
    each = np.arange(bins.shape[1])
    before, own, after = (w[each, bins].sum(axis=1) for w in weights)
    first = np.cumsum(sizes) - sizes
    last = first + sizes - 1
    out = own + bias
    left, right = np.roll(before, 1), np.roll(after, -1)
    left[first], right[last] = border
    return out + left + right


def groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of texts with about as many lines, so that padding stays below the double."""
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for value in np.unique(level):
        yield np.flatnonzero(level == value)


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: probability of good of each line, and expected moves of each text (2 x 2)."""
    good, pairs = np.empty(len(scores)), np.zeros((len(sizes), 2, 2))
    first = np.cumsum(sizes) - sizes
    step = np.exp(moves - moves.max())
    for rows in groups(sizes):
        n, longest = sizes[rows], int(sizes[rows].max())
        at = first[rows][:, None] + np.minimum(np.arange(longest), (n - 1)[:, None])
        s = np.clip(scores[at], -60, 60)
        node = np.stack([np.exp(-np.maximum(s, 0)), np.exp(np.minimum(s, 0))], axis=2)
        forward, backward = np.empty_like(node), np.empty_like(node)
        forward[:, 0] = node[:, 0] / node[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            f = (forward[:, t - 1] @ step) * node[:, t]
            forward[:, t] = f / f.sum(axis=1, keepdims=True)
        backward[:, longest - 1] = 0.5
        for t in range(longest - 2, -1, -1):
            b = (backward[:, t + 1] * node[:, t + 1]) @ step.T
            b /= b.sum(axis=1, keepdims=True)
            backward[:, t] = np.where((t < n - 1)[:, None], b, 0.5)
        both = forward * backward
        live = np.arange(longest) < n[:, None]
        good[at[live]] = (both[:, :, 1] / both.sum(axis=2))[live]
        if longest > 1:
            joint = forward[:, :-1, :, None] * step * (node[:, 1:] * backward[:, 1:])[:, :, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            pairs[rows] = (joint * live[:, 1:, None, None]).sum(axis=1)
    return good, pairs


def document_quality(good: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean probability of the lines, weighted by length (every line counts a little)."""
    weight = lengths + 1e-3
    first = np.cumsum(sizes) - sizes
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def shifts(good: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Least shift of each document's line scores that brings its good share where the label wants it.

    The shift is found on the lines' marginals one by one; zero where the share is there already.
    """
    first, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    weight = lengths + 1e-3
    weight = weight / np.add.reduceat(weight, first)[doc]
    score, want = _logit(good), np.where(labels == 1, GOOD_SHARE, BAD_SHARE)
    share = np.add.reduceat(good * weight, first)
    off = np.where(labels == 1, share < want, share > want)
    low, high = np.where(labels == 1, 0.0, -40.0), np.where(labels == 1, 40.0, 0.0)
    for _ in range(30):
        middle = (low + high) / 2
        now = np.add.reduceat(weight / (1 + np.exp(-(score + middle[doc]))), first)
        low, high = np.where(now < want, middle, low), np.where(now < want, high, middle)
    return np.where(off, (low + high) / 2, 0.0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(labels: np.ndarray, sizes: np.ndarray, measures: np.ndarray) -> Model:
    """Gradient ascent (Adam) on the mean likelihood of the line labels, then the final logistic."""
    k = measures.shape[1]
    edges = np.stack([np.quantile(measures[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) if len(measures) else np.zeros(BINS - 1) for j in range(k)])
    # Measures that are mostly zero: the borders spread over what is not.
    for j in range(k if len(measures) else 0):
        if edges[j, BINS // 2] <= measures[:, j].min():
            rest = measures[measures[:, j] > measures[:, j].min(), j]
            if len(rest):
                edges[j] = np.concatenate([[rest.min()], np.quantile(rest, np.linspace(0, 1, BINS - 1)[1:])])
    zero = Model(edges, np.zeros((3, k, BINS)), np.zeros(2), 0.0, np.zeros((2, 2)), 1.0, 0.0, None)
    if len(set(labels.tolist())) < 2:
        return zero._replace(share=float(labels.mean()) if len(labels) else 0.5)
    bins = binned(measures, edges)
    n, docs = len(bins), len(sizes)
    doc = np.repeat(np.arange(docs), sizes)
    truth = labels[doc].astype(float)
    each = (1.0 / (docs * np.sqrt(sizes)))[doc]  # long texts count more, but not by their length
    first = np.cumsum(sizes) - sizes
    inner_left, inner_right = np.ones(n, bool), np.ones(n, bool)
    inner_left[first], inner_right[first + sizes - 1] = False, False
    flat = lambda rows: (bins[rows] + np.arange(k) * BINS).ravel()
    own, left, right = flat(slice(None)), flat(np.flatnonzero(inner_left) - 1), flat(np.flatnonzero(inner_right) + 1)
    values = np.zeros(3 * k * BINS + 2 + 1 + 4)
    mean, square = np.zeros_like(values), np.zeros_like(values)
    parts = lambda v: (v[: 3 * k * BINS].reshape(3, k, BINS), v[-7:-5], v[-5], v[-4:].reshape(2, 2))
    for turn in range(1, START_ROUNDS + ROUNDS + 1):
        weights, border, bias, moves = parts(values)
        scores = node_scores(bins, sizes, weights, border, bias)
        good, pairs = marginals(scores, sizes, moves)
        wanted, wanted_pairs = truth, pairs
        if turn > START_ROUNDS:
            shift = shifts(good, sizes, measures[:, -1], labels)
            wanted, wanted_pairs = marginals(scores + shift[doc], sizes, moves)
        miss = (wanted - good) * each
        grad = np.zeros_like(values)
        gw, gb, _, gm = parts(grad)
        for slot, index, rows in ((1, own, slice(None)), (0, left, inner_left), (2, right, inner_right)):
            gw[slot] = np.bincount(index, np.repeat(miss[rows], k), minlength=k * BINS).reshape(k, BINS)
        gb[:] = miss[~inner_left].sum(), miss[~inner_right].sum()
        grad[-5] = miss.sum()
        gm[:] = ((wanted_pairs - pairs) / (docs * np.sqrt(sizes))[:, None, None]).sum(axis=0)
        grad -= RIDGE * values
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        values = values + RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    weights, border, bias, moves = parts(values)
    good, _ = marginals(node_scores(bins, sizes, weights, border, bias), sizes, moves)
    x = _logit(document_quality(good, sizes, measures[:, -1]))
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of the final logistic, lightly damped
        p = 1 / (1 + np.exp(-(scale * x + shift)))
        w = p * (1 - p)
        g = np.array([((labels - p) * x).sum() - 0.1 * (scale - 1), (labels - p).sum() - 0.1 * shift])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        scale, shift = scale + np.clip(d[0], -1, 1), shift + np.clip(d[1], -1, 1)
    return Model(edges, weights, border, float(bias), moves, float(scale), float(shift), None)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list, list, list, list]:
    """(score, predicted, number of lines, lines more likely bad) of each text."""
    measures, sizes = line_measures([t or "" for t in texts])
    if model.share is not None:
        return [model.share] * len(sizes), [int(model.share >= 0.5)] * len(sizes), sizes.tolist(), [0] * len(sizes)
    scores = node_scores(binned(measures, model.edges), sizes, model.weights, model.border, model.bias)
    good, _ = marginals(scores, sizes, model.moves)
    x = model.scale * _logit(document_quality(good, sizes, measures[:, -1])) + model.shift
    score = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    bad = np.add.reduceat((good < 0.5).astype(np.int64), np.cumsum(sizes) - sizes)
    return score.tolist(), (score >= 0.5).astype(int).tolist(), sizes.tolist(), bad.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> Model:
    """Model from at most ``most`` labelled documents; labels other than 0 and 1 are ignored."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)")
    picked = hash_sample(known.groupBy("_id").agg(F.max("label").alias("label")), "_id", most)
    # ``picked`` has at most ``most`` rows.
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "_id")
    # A repeated id gives one example, so the bound holds for rows as well.
    rows = rows.groupBy("_id", "label").agg(F.max("text").alias("text"))
    schema = _arrow(docs.sparkSession, EXAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in small_batches(batches, "label", "text"):
            measures, sizes = line_measures(texts)
            parts = np.split(measures.astype("<f4"), np.cumsum(sizes)[:-1])
            yield record_batch(schema, {"label": own, "measures": [p[some_lines(len(p))].tobytes() for p in parts]})

    got = sorted((r["label"], bytes(r["measures"])) for r in arrow_map(rows.select("label", "text"), run, EXAMPLES).collect())
    all_measures = np.frombuffer(b"".join(m for _, m in got), "<f4").reshape(-1, 10).astype(np.float64)
    sizes = np.array([len(m) // 40 for _, m in got], dtype=np.int64)
    return train(np.array([label for label, _ in got], dtype=np.int64), sizes, all_measures)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``score``, ``predicted``, ``n_lines`` and ``bad_lines``."""
    added = [c for c, _ in SCORES]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("text"))
    fields = source.drop("text").schema
    for name, kind in SCORES:
        fields = fields.add(name, kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [f"k_{i}" for i in range(len(names))]
        for *kept, texts in small_batches(batches, *columns, "text"):
            yield record_batch(schema, dict(zip(schema.names, [*kept, *score_texts(model, texts)])))

    return arrow_map(source, run, fields).withColumnsRenamed({f"k_{i}": c for i, c in enumerate(names)})
