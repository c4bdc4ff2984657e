"""Mixing documents to target domain weights (operator 6).

Method: a classifier trained on a table of labelled documents gives every document a
posterior over domains (soft membership).  Rates, one for each document and none
negative, are fitted by accelerated projected-gradient least squares so that the
expected token totals of the domains, the sum of rate x tokens x posterior, match the
targets, in tokens of the given tokenizer; a small ridge keeps rates near one.  Residuals are weighed by the inverse of
the domains' Gram matrix, so a rare domain counts as much as a large one, and the ridge is
lowered by the largest cut that a target asks for.  Steps end when every target is met
within its tolerance or when the misses no longer fall; the plan says which
(``converged``) and gives the totals that were reached.

Each gradient step needs the domains' totals under the present rates: one aggregation
over the stored posteriors that returns one number for each domain.  A document's rate
follows from its posterior and the earlier residuals alone, so tasks compute it from the
residuals since rates were last stored, which is every ``KEEP`` steps.

The fit of the classifier sees at most ``TRAIN_ROWS`` labelled rows (a documented bound).

Defined results: NULL is the empty text, with no tokens and rate one; without labels of
two domains every document has the posterior of the label shares; repeated rows are
weighted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrapanel.llm.coder import TextCoder, chunks_of, coder, parts_of
from nitrapanel.llm.frames import arrow_map, hash_sample, record_batch
from nitrapanel.llm.signs import SYMBOLS
from nitrapanel.llm.tokens import _arrow
from nitrapanel.session import materialize

TRAIN_ROWS = 4_000
VOCABULARY = 2_000  # words whose presence tells most about a domain
RIDGE = 1e-4
CLOSE = 1e-4  # largest share of all tokens by which a domain may miss its target
MISS = 1e-3  # and largest part of the target itself
KEEP = 10
PATIENCE, FALL = 20, 0.75  # steps end if the last so many have not brought the largest miss down to this part
SIGNS = ".,!?;:\"'()[]{}*$%&#|<>-_=+/\\@~`^0123456789"  # not part of a word at its ends
SYMBOL_BYTES = np.isin(np.arange(256), [ord(s) for s in SYMBOLS])


class Measured(NamedTuple):
    """What the classifier sees of some texts."""

    shapes: np.ndarray  # texts x SHAPES
    text: np.ndarray  # with ``word``: each distinct word of each text
    word: np.ndarray  # place in ``words``
    words: list[str]
    tokens: np.ndarray  # of each text


SHAPES = 6


def distinct(rows: np.ndarray, values: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of row and value once."""
    kinds = max(1, kinds)
    small = not len(rows) or (int(rows[-1]) + 1) * kinds < 1 << 31  # rows ascend
    both = np.sort((rows * kinds + values).astype(np.int32 if small else np.int64))
    both = both[np.diff(both, prepend=-1) != 0]
    return both // kinds, both % kinds


def sign_counts(column: pa.Array) -> np.ndarray:
    """Symbols in each text; they are single bytes in UTF-8."""
    n, (_, offsets, data) = len(column), column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(n, np.int64)
    total = np.concatenate([[0], np.cumsum(SYMBOL_BYTES[np.frombuffer(data, np.uint8)[at[0] : at[-1]]], dtype=np.int64)])
    return np.diff(total[at - at[0]])


def measure(column: pa.Array, tool: TextCoder | None) -> Measured:
    """Measures of whole texts: Arrow splits them, everything else is counted over distinct chunks and lines."""
    n = len(column)
    column = pc.fill_null(column, "")
    split = chunks_of(column)
    coded = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy())
    index, chunks = coded.indices.to_numpy(), coded.dictionary
    plain = pc.utf8_trim(chunks, SIGNS)
    low = pc.utf8_lower(plain).dictionary_encode()
    filled = pc.greater(pc.utf8_length(plain), 0).to_numpy(zero_copy_only=False)
    upper = pc.utf8_is_upper(plain).to_numpy(zero_copy_only=False)
    total = np.bincount(text, filled[index], n)
    some = filled[index]
    at, word = distinct(text[some], low.indices.to_numpy()[index[some]].astype(np.int64), len(low.dictionary))
    points = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    signs = sign_counts(column)
    lines = pc.split_pattern(column, "\n")
    coded_lines = lines.flatten().dictionary_encode()
    n_lines = pc.list_value_length(lines).to_numpy()
    own, _ = distinct(np.repeat(np.arange(n), n_lines), coded_lines.indices.to_numpy().astype(np.int64), len(coded_lines.dictionary))
    long = np.maximum(1, points)
    shapes = np.stack(
        [
            np.ones(n),
            np.minimum(1.0, signs / long * 10),
            np.bincount(text, upper[index], n) / np.maximum(1, total),
            1 - np.bincount(at, minlength=n) / np.maximum(1, total),
            1 - np.bincount(own, minlength=n) / np.maximum(1, n_lines),
            np.minimum(2.0, np.log10(long) / 3),
        ],
        axis=1,
    )
    tokens = total if tool is None else np.bincount(text, tool.chunk_sizes(chunks)[index], n)
    return Measured(shapes, at, word, low.dictionary.to_pylist(), tokens.astype(np.int64))


class Classifier(NamedTuple):
    domains: list[str]
    words: dict[str, int]
    weights: np.ndarray  # (shape and words) x domain

    def posteriors(self, seen: Measured) -> np.ndarray:
        place = np.array([self.words.get(w, -1) for w in seen.words], np.int64)
        known = place[seen.word] >= 0 if len(seen.word) else np.zeros(0, bool)
        at, weights = seen.text[known], self.weights[SHAPES + place[seen.word[known]]]
        sums = [np.bincount(at, weights[:, k], len(seen.shapes)) for k in range(self.weights.shape[1])]
        return _softmax(seen.shapes @ self.weights[:SHAPES] + np.stack(sums, axis=1))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labels: list[str], words: list[list[str]], shapes: np.ndarray, rounds: int = 300) -> Classifier:
    """Fit a softmax over the shapes and the words' presence by gradient ascent (Adam) with a ridge."""
    domains = sorted(set(labels))
    n = max(1, len(labels))
    if len(domains) < 2:
        return Classifier(domains or ["all"], {}, np.zeros((SHAPES, max(1, len(domains)))))
    truth = np.array([domains.index(x) for x in labels])
    chosen = {w: i for i, w in enumerate(sorted({w for own in words for w in own}))}
    x = np.zeros((n, SHAPES + len(chosen)))
    x[:, :SHAPES] = shapes
    for i, own in enumerate(words):
        x[i, [SHAPES + chosen[w] for w in own if w in chosen]] = 1
    y = np.eye(len(domains))[truth]
    w = np.zeros((x.shape[1], len(domains)))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, rounds + 1):
        grad = x.T @ (y - _softmax(x @ w)) / n - 1e-4 * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w += 0.05 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-6)
    return Classifier(domains, chosen, w)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "domain", most: int = TRAIN_ROWS) -> Classifier:
    """Classifier from at most ``most`` rows that have a domain."""
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where("_id IS NOT NULL AND label IS NOT NULL")
    picked = hash_sample(rows.select("_id").distinct(), "_id", most)
    kinds = "label string, words array<string>, shape array<double>"
    schema = _arrow(labelled.sparkSession, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for part in parts_of(batch.column(1)):
                seen = measure(part, None)
                words: list[list[str]] = [[] for _ in range(len(part))]
                for t, w in zip(seen.text.tolist(), seen.word.tolist()):
                    words[t].append(seen.words[w])
                own, labels = labels[: len(part)], labels[len(part) :]
                yield record_batch(schema, {"label": own, "words": [sorted(w) for w in words], "shape": list(seen.shapes)})

    # A repeated id gives one example, so the bound holds for rows as well.
    some = rows.join(F.broadcast(picked), "_id", "left_semi").groupBy("_id").agg(F.max(F.struct("label", "text")).alias("x"))
    some = some.select("x.label", "x.text")
    measured = materialize(arrow_map(some, run, kinds), "labelled")
    # Only the most telling words reach the driver: at most VOCABULARY.
    sizes = {r["label"]: r["count"] for r in measured.groupBy("label").count().collect()}
    common = _telling(measured, sizes)
    told = measured.withColumn("row", F.xxhash64("label", "words", "shape"))
    kept = told.select("row", F.explode("words").alias("w")).join(common, "w", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set("w")).alias("words"))
    got = told.select("row", "label", "shape").join(kept, "row", "left").select("label", "shape", F.coalesce("words", F.array().cast("array<string>")).alias("words")).collect()
    got = sorted(got, key=lambda r: (r["label"], r["words"], r["shape"]))
    shapes = np.array([r["shape"] for r in got]) if got else np.zeros((0, SHAPES))
    return train([r["label"] for r in got], [r["words"] for r in got], shapes)


def _telling(measured: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The words (``w``) whose domains are farthest from the domains' shares, in standard deviations."""
    seen, n = F.col("seen"), max(1, sum(sizes.values()))
    each = measured.select("label", F.explode("words").alias("w")).groupBy("w")
    named = {f"d{i}": label for i, label in enumerate(sorted(sizes))}
    counts = each.agg(F.count("*").alias("seen"), *[F.count_if(F.col("label") == v).alias(k) for k, v in named.items()])
    odd = [
        F.abs(F.col(k) - seen * (sizes[v] / n)) / F.sqrt(seen * (sizes[v] / n * (1 - sizes[v] / n)) + 1) for k, v in named.items()
    ]
    far = F.array_max(F.array(*odd)) if odd else F.lit(0.0)
    return counts.where("seen >= 3").orderBy(far.desc(), "w").limit(VOCABULARY).select("w")


def memberships(docs: DataFrame, model: Classifier, tokenizer: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens, posterior``, written to the shared folder: texts are read once.

    Tokens are those of the tokenizer's file, or words without one.
    """
    kinds = "doc_id long, tokens long, posterior array<double>"
    schema = _arrow(docs.sparkSession, kinds)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(tokenizer) if tokenizer else None
        for batch in batches:
            at = 0
            for part in parts_of(batch.column(1)):
                seen = measure(part, tool)
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                yield record_batch(schema, {"doc_id": ids, "tokens": seen.tokens, "posterior": list(sent.value.posteriors(seen))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(arrow_map(rows, run, kinds), "posteriors")


class Plan(NamedTuple):
    """What determines all rates: the residuals of the steps and how to follow them."""

    domains: list[str]
    residuals: list[np.ndarray]
    step: float
    ridge: float
    totals: np.ndarray  # shares of the domains' expected tokens under the last rates
    targets: np.ndarray
    converged: bool  # whether every target is met within its tolerance


def momentum(steps: int) -> float:
    """The accelerated method's number after so many steps."""
    t = 1.0
    for _ in range(steps):
        t = (1 + np.sqrt(1 + 4 * t * t)) / 2
    return t


def follow(
    posteriors: np.ndarray,
    residuals: list[np.ndarray],
    step: float,
    ridge: float,
    start: tuple[np.ndarray, np.ndarray, int] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(rates after the steps, points where the next gradient is taken) of rows with these posteriors.

    ``start`` has both after the steps before, and their number.
    """
    rates = ahead = np.ones(len(posteriors))
    t = 1.0
    if start is not None:
        rates, ahead, t = start[0], start[1], momentum(start[2])
    for residual in residuals:
        new = np.maximum(0.0, ahead - step * (posteriors @ residual + ridge * (ahead - 1.0)))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, rates, t = new + (t - 1) / after * (new - rates), new, after
    return rates, ahead


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _start(batch: pa.RecordBatch, steps: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    return (batch.column(2).to_numpy(), batch.column(3).to_numpy(), steps) if batch.num_columns > 2 else None


def _summed(members: DataFrame, width: int, values: Callable, steps: int = 0) -> np.ndarray:
    """Sum over all rows of a vector for each row; ``values`` maps (tokens, posteriors, where they stand) to their sum."""
    kinds = "part array<double>"
    schema = _arrow(members.sparkSession, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            total = total + values(tokens, _matrix(batch.column(1), width), _start(batch, steps))
        if not np.isscalar(total):
            yield record_batch(schema, {"part": [total]})

    stand = [c for c in ("rate", "ahead") if c in members.columns]
    parts = arrow_map(members.select("tokens", "posterior", *stand), run, kinds).select(F.posexplode("part").alias("at", "x"))
    got = {r["at"]: r["x"] for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect()}
    return np.array([got[i] for i in sorted(got)])


def shares(members: DataFrame, domains: list[str]) -> dict[str, float]:
    """Present shares of the domains' expected tokens; zero without tokens."""
    sums = _summed(members, len(domains), lambda t, p, _: t @ p)
    return dict(zip(domains, (sums / sums.sum()).tolist() if len(sums) and sums.sum() else [0.0] * len(domains)))


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], steps: int | None = None, ridge: float = RIDGE) -> Plan:
    """Residuals of the projected-gradient steps; each step aggregates one number for each domain.

    Without ``steps`` the number of steps is bounded only by the misses, which have to fall.
    """
    k = len(domains)
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    want = want / want.sum() if want.sum() else np.full(k, 1 / k)
    first = _summed(members, k, lambda t, p, _: np.concatenate([[t.sum()], ((p * t[:, None]).T @ p).ravel()]))
    if not len(first) or not first[0]:
        return Plan(domains, [], 1.0, ridge, np.zeros(k), want, False)
    total = first[0]
    gram = first[1:].reshape(k, k) / total
    share = gram.sum(axis=1)  # posteriors sum to one
    asked = (want > 0) & (share > 0)
    ridge = ridge * float(np.min(np.minimum(1.0, want[asked] / share[asked]), initial=1.0))
    # In the metric of the inverse Gram matrix the steepest direction has curvature one.
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    step = 1.0 / (1.0 + ridge)
    allowed = np.where(want > 0, np.minimum(CLOSE, MISS * want), CLOSE)
    residuals: list[np.ndarray] = []
    reached, misses = [], []
    # Every ``KEEP`` steps the rows are stored with where they stand, so a step's work does not grow.
    state, stored = members.select("tokens", "posterior"), 0
    while True:
        if len(residuals) - stored >= KEEP:
            state, stored = materialize(_moved(state, k, residuals[stored:], step, ridge, stored), "rates"), len(residuals)
        past = residuals[stored:]

        def both(t: np.ndarray, p: np.ndarray, start: tuple | None, past: list = past) -> np.ndarray:
            rates, ahead = follow(p, past, step, ridge, start)
            return np.concatenate([(t * rates) @ p, (t * ahead) @ p])

        sums = _summed(state, k, both, stored) / total
        reached.append(sums[:k])
        misses.append(float((np.abs(sums[:k] - want) / allowed).max()))
        n = len(misses) - 1
        stalled = n >= PATIENCE and min(misses[-PATIENCE:]) > FALL * min(misses[:-PATIENCE])
        if misses[-1] <= 1 or stalled or n == steps:
            break
        residuals.append(inverse @ (sums[k:] - want))
    best = int(np.argmin(misses))
    return Plan(domains, residuals[:best], step, ridge, reached[best], want, misses[best] <= 1)


def _moved(state: DataFrame, width: int, residuals: list[np.ndarray], step: float, ridge: float, steps: int) -> DataFrame:
    """Rows with ``rate`` and ``ahead`` after further steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = follow(_matrix(batch.column(1), width), residuals, step, ridge, _start(batch, steps))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, at)], ["tokens", "posterior", "rate", "ahead"])

    return arrow_map(state, run, "tokens long, posterior array<double>, rate double, ahead double")


def with_rates(members: DataFrame, plan: Plan, seed: int = 17) -> DataFrame:
    """``doc_id, tokens, posterior, rate, copies``.

    ``copies`` is the rate rounded up or down by a draw from the id, so that it is right
    on average; a rate of one or more keeps the document for certain.
    """
    kinds = "doc_id long, tokens long, posterior array<double>, rate double"
    schema = _arrow(members.sparkSession, kinds)
    residuals, step, ridge, k = plan.residuals, plan.step, plan.ridge, len(plan.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, _ = follow(_matrix(batch.column(2), k), residuals, step, ridge)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], schema=schema)

    rows = arrow_map(members.select("doc_id", "tokens", "posterior"), run, kinds)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("copies", F.floor(F.round("rate", 9) + draw).cast("int"))


def apply_rates(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` as often as its document has copies; the columns of ``docs``."""
    # Repeated ids hold equal draws; the highest rate decides for all of them.
    copies = rated.groupBy(F.col("doc_id").alias("_rated_id")).agg(F.max("copies").alias("_copies"))
    rows = docs.join(copies, F.col(id_col).cast("long").eqNullSafe(F.col("_rated_id"))).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])
