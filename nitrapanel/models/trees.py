"""Gradient-boosted trees for many models at a time.

Any number of models (horizons, folds, kinds, seeds) is fitted by the same few jobs.
Features are cut into bins at the quantiles of each group's training rows; a tree grows
level by level from histograms of gradients, with second-order gains and an L2 term on
the leaves.  Rows and columns are sampled for each tree from hashes of the row's key, so
neither the partitioning nor a retry changes a model.

Where every group has ``LOCAL_ROWS`` training rows at most (counted first), a task gets
the rows of one group and grows whole models.  Larger groups stay spread over the tasks:
each level of each tree is one job for all models together, in which tasks add up their
histograms, the histograms of a model meet, and only its splits reach the driver; every
``KEEP`` trees the rows are stored again with their sums so far.  Both ways share the
functions below and grow the same trees (tested).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from nitrapanel.session import materialize, ship_package

# Tree settings.
DEPTH, RATE, ROW_PART, COLUMN_PART, LEAF_L2, LEAST_GAIN = 5, 0.05, 0.8, 0.8, 1.0, 1e-6
BINS = 64
NODES = 2 ** (DEPTH + 1) - 1
LOCAL_ROWS = 50_000
KEEP = 10  # trees after which the sums of spread rows are stored

CELLS = "group int, key long, labels array<double>, weights array<double>, bins binary"


class Spec(NamedTuple):
    """What one model learns: rows of its group that have a weight."""

    name: str
    group: int
    label: int  # place in the row's labels
    weight: int  # place in the row's weights
    logistic: bool
    least_child: float  # sum of second derivatives that a child must have
    seed: int
    trees: int


class Ensemble(NamedTuple):
    """A fitted model; nodes of a tree are numbered from the root, the children of i are 2i + 1 and 2i + 2."""

    name: str
    logistic: bool
    base: float
    feature: np.ndarray  # trees x nodes, -1 at a leaf
    cut: np.ndarray  # a row goes left if its value is at most the cut
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees for each row of feature values."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                own = feature[node]
                with np.errstate(invalid="ignore"):
                    right = ~(x[rows, np.maximum(own, 0)] <= cut[node])  # a missing value goes right
                node = np.where(own >= 0, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Value, or the probability of label 1."""
        raw = self.raw(x)
        return 1 / (1 + np.exp(-raw)) if self.logistic else raw


# -- one tree, one level ---------------------------------------------------------------


def sampled(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Rows that a tree sees: a hash of key, seed and tree below ``ROW_PART``."""
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (1 + seed * 1_000_003 + tree)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)) * 2.0**-53 < ROW_PART


def columns_of(seed: int, tree: int, n: int) -> np.ndarray:
    """Mask of the columns that a tree may split on."""
    mask = np.zeros(n, bool)
    mask[np.random.default_rng([seed, tree]).permutation(n)[: max(1, round(COLUMN_PART * n))]] = True
    return mask


def gradients(spec: Spec, margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if spec.logistic:
        p = 1 / (1 + np.exp(-margin))
        return weight * (p - label), weight * p * (1 - p)
    return weight * (margin - label), weight


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of both derivatives for each node, feature and bin."""
    n, features = bins.shape
    at = ((node[:, None] * features + np.arange(features)) * BINS + bins).ravel()
    size = nodes * features * BINS
    sums = [np.bincount(at, np.repeat(x, features), minlength=size) for x in (g, h)]
    return np.stack(sums, axis=-1).reshape(nodes, features, BINS, 2)


def choose(hist: np.ndarray, columns: np.ndarray, least_child: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, bin, sums of the left child and of the node) of each node's best split."""
    left = hist.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    left = left[:, :, :-1, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + LEAF_L2)
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < least_child) | (right[..., 1] < least_child)] = -np.inf
    gain[:, ~columns] = -np.inf
    nodes = len(hist)
    best = gain.reshape(nodes, -1).argmax(axis=1)
    feature, cut = np.divmod(best, BINS - 1)
    at = np.arange(nodes)
    good = gain[at, feature, cut] > LEAST_GAIN
    return np.where(good, feature, -1), cut, np.concatenate([left[at, feature, cut], total[:, 0, 0]], axis=1)


class Tree:
    """A tree that grows by levels, over bins."""

    def __init__(self) -> None:
        self.feature, self.bin, self.value = np.full(NODES, -1), np.zeros(NODES, np.int64), np.zeros(NODES)

    def split(self, level: int, feature: np.ndarray, cut: np.ndarray, sums: np.ndarray) -> None:
        """Take over the best splits of the level's nodes; children get the value they have as leaves."""
        at = np.arange(2**level) + 2**level - 1
        self.feature[at], self.bin[at] = feature, cut
        leaf = lambda s: -RATE * s[:, 0] / (s[:, 1] + LEAF_L2)
        if level == 0:
            self.value[0] = leaf(sums[:, 2:])[0]
        there = feature >= 0
        self.value[2 * at[there] + 1] = leaf(sums[there, :2])
        self.value[2 * at[there] + 2] = leaf(sums[there, 2:] - sums[there, :2])

    def step(self, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Nodes of the next level for rows in these nodes; rows in a leaf stay."""
        own = self.feature[node]
        right = bins[np.arange(len(node)), np.maximum(own, 0)] > self.bin[node]
        return np.where(own >= 0, 2 * node + 1 + right, node)

    def walk(self, bins: np.ndarray, levels: int = DEPTH) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            node = self.step(node, bins)
        return node


def level_histogram(spec: Spec, tree: int, level: int, node: np.ndarray, keys: np.ndarray, bins: np.ndarray, margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Histogram of the level's nodes over the sampled rows that have come so far."""
    g, h = gradients(spec, margin, label, weight)
    first = 2**level - 1
    seen = (weight > 0) & (node >= first) & sampled(keys, spec.seed, tree)
    return histogram(bins[seen], node[seen] - first, g[seen], h[seen], 2**level)


def grow(spec: Spec, base: float, keys: np.ndarray, bins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[Tree]:
    """All trees of a model whose rows are here."""
    margin, out = np.full(len(keys), base), []
    for t in range(spec.trees):
        tree, node, columns = Tree(), np.zeros(len(keys), np.int64), columns_of(spec.seed, t, bins.shape[1])
        for level in range(DEPTH):
            tree.split(level, *choose(level_histogram(spec, t, level, node, keys, bins, margin, label, weight), columns, spec.least_child))
            node = tree.step(node, bins)
        margin = margin + tree.value[node]
        out.append(tree)
    return out


# -- rows ---------------------------------------------------------------------------------


class Cells:
    """Rows of one group as arrays, in the order of their keys."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, sort: bool = False) -> None:
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks().to_batches()[0]
        n = batch.num_rows
        self.groups = batch.column(0).to_numpy()
        self.keys = batch.column(1).to_numpy()
        wide = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.labels, self.weights = wide(batch.column(2)), wide(batch.column(3))
        self.bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(n, -1)
        if sort:
            order = np.lexsort((*self.labels.T, self.keys))
            for name in ("groups", "keys", "labels", "weights", "bins"):
                setattr(self, name, getattr(self, name)[order])


class Prepared(NamedTuple):
    cells: DataFrame  # stored
    cuts: dict[int, np.ndarray]  # group -> features x (BINS - 1)
    bases: dict[tuple[int, int, int], float]  # group, label, weight -> weighted mean
    largest: int  # training rows of the largest group


def prepare(rows: DataFrame, labels: list[str], weights: list[str], key: str = "key") -> Prepared:
    """Cells of ``group, key, features`` and the named columns; only rows with some weight are kept.

    Quantiles and means come from the training rows of each group: no other row has a say.
    """
    spark = rows.sparkSession
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = rows.where(sum((zero(w) for w in weights), F.lit(0.0)) > 0).select(
        F.col("group").cast("int").alias("group"),
        F.col(key).cast("long").alias("key"),
        F.array(*map(zero, labels)).alias("labels"),
        F.array(*map(zero, weights)).alias("weights"),
        "features",
    )
    rows = materialize(rows, "tree_rows")
    shares = [i / BINS for i in range(1, BINS)]
    # One row for each group, feature by feature: the aggregation never holds a row twice.
    each = rows.select("group", F.posexplode("features").alias("feature", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    quantiles = each.groupBy("group", "feature").agg(F.percentile_approx("x", shares, 2000).alias("cuts")).collect()
    means = [
        (F.sum(F.col("weights")[w] * F.col("labels")[y]) / F.sum(F.col("weights")[w])).alias(f"m_{y}_{w}")
        for y in range(len(labels)) for w in range(len(weights))
    ]
    facts = rows.groupBy("group").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("f"), *means).collect()
    cuts = {r["group"]: np.full((r["f"], BINS - 1), np.inf) for r in facts}
    for r in quantiles:
        cuts[r["group"]][r["feature"]] = r["cuts"]
    bases = {(r["group"], y, w): r[f"m_{y}_{w}"] for r in facts for y in range(len(labels)) for w in range(len(weights))}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy()
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.zeros(x.shape, np.uint8)
            for group in np.unique(groups).tolist():
                own = groups == group
                for f, borders in enumerate(cuts[group]):
                    bins[own, f] = np.searchsorted(borders, x[own, f], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([b.tobytes() for b in bins], pa.binary())], ["group", "key", "labels", "weights", "bins"])

    ship_package(spark)
    cells = materialize(rows.mapInArrow(cut, CELLS), "tree_cells")
    return Prepared(cells, cuts, bases, max((r["n"] for r in facts), default=0))


def _base(prepared: Prepared, spec: Spec) -> float:
    mean = prepared.bases.get((spec.group, spec.label, spec.weight))
    if mean is None:
        raise ValueError(f"no training rows for {spec.name}")
    if not spec.logistic:
        return mean
    p = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit(rows: DataFrame, specs: list[Spec], labels: list[str], weights: list[str], local_rows: int = LOCAL_ROWS) -> dict[str, Ensemble]:
    """All models of ``specs`` by name; ``rows`` has ``group, key, features``, the labels and the weights."""
    prepared = prepare(rows, labels, weights)
    bases = {s.name: _base(prepared, s) for s in specs}
    grown = (_fit_local if prepared.largest <= local_rows else _fit_spread)(prepared, specs, bases)
    out = {}
    for s in specs:
        feature, bins, value = (np.array([getattr(t, a) for t in grown[s.name]]) for a in ("feature", "bin", "value"))
        cut = prepared.cuts[s.group][np.maximum(feature, 0), bins]
        out[s.name] = Ensemble(s.name, s.logistic, bases[s.name], feature, np.where(feature >= 0, cut, 0.0), value)
    return out


def _fit_local(prepared: Prepared, specs: list[Spec], bases: dict[str, float]) -> dict[str, list[Tree]]:
    """One task for each group and chunk of its models; rows of a group are bounded."""
    spark = prepared.cells.sparkSession
    by_group: dict[int, list[Spec]] = {}
    for s in specs:
        by_group.setdefault(s.group, []).append(s)
    wide = max(1, spark.sparkContext.defaultParallelism // len(by_group))
    chunks = {(g, c): own[c::wide] for g, own in by_group.items() for c in range(min(wide, len(own)))}
    places = F.create_map(*[F.lit(x) for g, own in by_group.items() for x in (g, min(wide, len(own)))])
    dealt = prepared.cells.where(F.col("group").isin(list(by_group))).withColumn("chunk", F.explode(F.sequence(F.lit(0), places[F.col("group")] - 1)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cells, out = Cells(table.select(["group", "key", "labels", "weights", "bins"]), sort=True), []
        for s in chunks[key[0].as_py(), key[1].as_py()]:
            for i, tree in enumerate(grow(s, bases[s.name], cells.keys, cells.bins, cells.labels[:, s.label], cells.weights[:, s.weight])):
                out.append((s.name, i, tree.feature.tolist(), tree.bin.tolist(), tree.value.tolist()))
        return pa.table(dict(zip(["name", "tree", "feature", "bin", "value"], map(list, zip(*out)))))

    kind = "name string, tree long, feature array<long>, bin array<long>, value array<double>"
    got = dealt.groupBy("group", "chunk").applyInArrow(run, kind).collect()  # as many rows as there are trees
    grown: dict[str, list[Tree]] = {s.name: [Tree() for _ in range(s.trees)] for s in specs}
    for r in got:
        tree = grown[r["name"]][r["tree"]]
        tree.feature, tree.bin, tree.value = np.array(r["feature"]), np.array(r["bin"]), np.array(r["value"])
    return grown


def _fit_spread(prepared: Prepared, specs: list[Spec], bases: dict[str, float]) -> dict[str, list[Tree]]:
    """One job for each level of each tree, for all models together."""
    by_group: dict[int, list[int]] = {}
    for i, s in enumerate(specs):
        by_group.setdefault(s.group, []).append(i)
    start = {g: np.array([bases[specs[i].name] for i in own]) for g, own in by_group.items()}
    state, stored = prepared.cells.where(F.col("group").isin(list(by_group))), 0
    grown: list[list[Tree]] = [[] for _ in specs]

    def margins(cells: Cells, own: np.ndarray, raw: list, models: list[int], done: list[list[Tree]]) -> np.ndarray:
        """Sums of the rows' models: the stored ones and those of the trees since."""
        if raw[0] is None:
            out = np.tile(start[int(cells.groups[own[0]])], (len(own), 1))
        else:
            out = np.frombuffer(b"".join(raw[i] for i in own.tolist())).reshape(len(own), -1).copy()
        for place, i in enumerate(models):
            for tree in done[i]:
                out[:, place] += tree.value[tree.walk(cells.bins[own])]
        return out

    def parts(batch: pa.RecordBatch, done: list[list[Tree]]) -> Iterator[tuple]:
        cells = Cells(batch)
        raw = batch.column(5).to_pylist() if batch.num_columns > 5 else [None] * batch.num_rows
        for group, models in by_group.items():
            own = np.flatnonzero(cells.groups == group)
            if len(own):
                yield cells, own, models, margins(cells, own, raw, models, done)

    def adder(done: list[list[Tree]], now: dict[int, Tree], t: int, level: int) -> Callable:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for cells, own, models, margin in parts(batch, done):
                    bins, keys = cells.bins[own], cells.keys[own]
                    for place, i in enumerate(models):
                        if i in now:
                            s = specs[i]
                            hist = level_histogram(s, t, level, now[i].walk(bins, level), keys, bins, margin[:, place], cells.labels[own, s.label], cells.weights[own, s.weight])
                            sums[i] = sums[i] + hist if i in sums else hist
            for i, hist in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([hist.tobytes()], pa.binary())], ["model", "hist"])

        return add

    def splitter(t: int, level: int) -> Callable:
        def split(key: tuple, table: pa.Table) -> pa.Table:
            s, total = specs[key[0].as_py()], 0.0
            for raw in table.column("hist"):
                total = total + np.frombuffer(raw.as_buffer()).reshape(2**level, -1, BINS, 2)
            feature, cut, sums = choose(total, columns_of(s.seed, t, total.shape[1]), s.least_child)
            return pa.table({"model": [key[0].as_py()], "feature": [feature.tolist()], "bin": [cut.tolist()], "sums": [sums.ravel().tolist()]})

        return split

    def keeper(done: list[list[Tree]]) -> Callable:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list = [b""] * batch.num_rows
                for _, own, _, margin in parts(batch, done):
                    for i, row in zip(own.tolist(), margin):
                        out[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], ["group", "key", "labels", "weights", "bins", "margins"])

        return keep

    for t in range(max(s.trees for s in specs)):
        live = [i for i, s in enumerate(specs) if t < s.trees]
        now = {i: Tree() for i in live}
        for level in range(DEPTH):
            hists = state.mapInArrow(adder([g[stored:] for g in grown], now, t, level), "model long, hist binary")
            split = hists.groupBy("model").applyInArrow(splitter(t, level), "model long, feature array<long>, bin array<long>, sums array<double>")
            for r in split.collect():  # one row for each model
                now[r["model"]].split(level, np.array(r["feature"]), np.array(r["bin"]), np.array(r["sums"]).reshape(2**level, 4))
        for i in live:
            grown[i].append(now[i])
        if (t + 1) % KEEP == 0:
            kept = state.mapInArrow(keeper([g[stored:] for g in grown]), CELLS + ", margins binary")
            state, stored = materialize(kept, "tree_sums"), t + 1
    return {s.name: grown[i] for i, s in enumerate(specs)}


def score(rows: DataFrame, models: dict[int, list[Ensemble]], name: str = "scores") -> DataFrame:
    """``rows`` with an array of the predictions of the group's models, in their order.

    Reads ``group`` and ``features``; the models are sent to the workers, their size does not
    grow with the rows.
    """
    spark = rows.sparkSession
    fields = rows.drop(name).schema.add(name, ArrayType(DoubleType()))
    rows = rows.drop(name)
    at, values = rows.columns.index("group"), rows.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(at).to_numpy()
            x = batch.column(values).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out: list = [None] * batch.num_rows
            for group in np.unique(groups).tolist():
                own = np.flatnonzero(groups == group)
                if models.get(group):
                    for i, row in zip(own.tolist(), np.stack([m.predict(x[own]) for m in models[group]], axis=1).tolist()):
                        out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, name])

    ship_package(spark)
    return rows.mapInArrow(run, fields)
