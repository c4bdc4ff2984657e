"""Boosted trees against plain loops, and both ways to fit them against each other."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitrapanel.models import trees
from nitrapanel.models.trees import Spec

ROWS = "group int, key long, features array<double>, y double, up double, w double"


def table(seed, n, groups=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).round(2)
    x[rng.random((n, 6)) < 0.03] = np.nan
    y = np.nan_to_num(x[:, 0]) * 3 + np.where(np.nan_to_num(x[:, 1]) > 0.3, 5.0, 0.0) + rng.normal(size=n) * 0.2
    rows = [(int(i % groups), int(i), row.tolist(), float(v), float(v > 2), float(w)) for i, (row, v, w) in enumerate(zip(x, y, rng.uniform(1, 1.5, n)))]
    # Rows without weight belong to no training set.
    return rows + [(0, 10_000 + i, [9.0] * 6, 1e6, 1.0, None) for i in range(5)]


def specs(trees_each=3):
    return [Spec(f"{kind}{g}/{seed}", g, k, 0, bool(k), 2.0 - k, seed, trees_each) for g in (0, 1) for k, kind in enumerate(("t", "dir")) for seed in (1, 2)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(1, 400), ROWS).repartition(5)


def plain_split(bins, g, h, columns, least):
    """Best split of the rows by trying every cut of every column."""
    score = lambda a, b: a * a / (b + trees.LEAF_L2)
    best, found = trees.LEAST_GAIN, None
    for f in np.flatnonzero(columns):
        for cut in range(trees.BINS - 1):
            left = bins[:, f] <= cut
            hl, hr = h[left].sum(), h[~left].sum()
            if hl >= least and hr >= least:
                gain = score(g[left].sum(), hl) + score(g[~left].sum(), hr) - score(g.sum(), h.sum())
                if gain > best + 1e-9:
                    best, found = gain, (f, cut)
    return found


def test_the_first_split_is_the_best_one():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 20, (150, 4)).astype(np.uint8)
    g, h = rng.normal(size=150), rng.uniform(0.5, 1.5, 150)
    columns = np.array([True, False, True, True])
    feature, cut, sums = trees.choose(trees.histogram(bins, np.zeros(150, np.int64), g, h, 1), columns, 2.0)
    assert (feature[0], cut[0]) == plain_split(bins, g, h, columns, 2.0)
    left = bins[:, feature[0]] <= cut[0]
    assert sums[0] == pytest.approx([g[left].sum(), h[left].sum(), g.sum(), h.sum()])


def test_trees_are_those_of_a_plain_loop():
    """Every node of every tree, recomputed from the rows that reach it."""
    rng = np.random.default_rng(4)
    n = 200
    bins = rng.integers(0, 12, (n, 5)).astype(np.uint8)
    label, weight, keys = rng.normal(size=n) + bins[:, 2], rng.uniform(1, 1.5, n), np.arange(n)
    spec = Spec("t", 0, 0, 0, False, 2.0, 7, 4)
    margin = np.full(n, 3.0)
    for t, tree in enumerate(trees.grow(spec, 3.0, keys, bins, label, weight)):
        seen, columns = trees.sampled(keys, spec.seed, t), trees.columns_of(spec.seed, t, 5)
        assert 0.6 < seen.mean() < 0.95 and columns.sum() == 4
        g, at = weight * (margin - label), {0: np.arange(n)}
        for node in range(trees.NODES):
            own = at.get(node)
            if own is None:
                continue
            some = own[seen[own]]
            assert tree.value[node] == pytest.approx(-trees.RATE * g[some].sum() / (weight[some].sum() + trees.LEAF_L2))
            found = plain_split(bins[some], g[some], weight[some], columns, 2.0) if node < trees.NODES // 2 else None
            assert (tree.feature[node] >= 0) == (found is not None)
            if found:
                left = bins[own, tree.feature[node]] <= tree.bin[node]
                at[2 * node + 1], at[2 * node + 2] = own[left], own[~left]
        margin = margin + tree.value[tree.walk(bins)]


def test_rows_spread_over_tasks_grow_the_same_trees(rows, monkeypatch):
    monkeypatch.setattr(trees, "KEEP", 2)
    local = trees.fit(rows, specs(5), ["y", "up"], ["w"])
    spread = trees.fit(rows, specs(5), ["y", "up"], ["w"], local_rows=0)
    assert set(local) == set(spread) == {s.name for s in specs()}
    for name, own in local.items():
        other = spread[name]
        assert (own.feature == other.feature).all() and (own.cut == other.cut).all()
        assert np.allclose(own.value, other.value) and own.base == pytest.approx(other.base)
    assert not np.array_equal(local["t0/1"].feature, local["t0/2"].feature)


def test_partitioning_and_other_models_do_not_matter(rows):
    alone = [s for s in specs() if s.name == "dir1/2"]
    one = trees.fit(rows.repartition(2), alone, ["y", "up"], ["w"])["dir1/2"]
    other = trees.fit(rows.repartition(7), specs(), ["y", "up"], ["w"])["dir1/2"]
    assert (one.feature == other.feature).all() and np.allclose(one.value, other.value)


def test_fit_and_scores(spark, rows):
    made = trees.fit(rows, specs(80), ["y", "up"], ["w"])
    scored = trees.score(rows.where("w IS NOT NULL"), {g: [made[f"t{g}/1"], made[f"dir{g}/1"]] for g in (0, 1)}).toPandas()
    pred, prob = np.array(scored.scores.tolist()).T
    assert np.sqrt(np.mean((pred - scored.y) ** 2)) < 0.35 * scored.y.std()
    assert ((prob > 0.5) == (scored.up == 1)).mean() > 0.95 and (prob > 0).all() and (prob < 1).all()
    assert abs(made["t0/1"].base - np.average(scored.y[scored.group == 0], weights=scored.w[scored.group == 0])) < 1e-9
    assert trees.score(rows.limit(0), {0: [made["t0/1"]]}).count() == 0


def test_flat_labels_and_missing_training_rows(spark, rows):
    flat = trees.fit(rows.withColumn("y", F.lit(4.0)), [s for s in specs() if s.name == "t0/1"], ["y"], ["w"])["t0/1"]
    assert flat.base == 4.0 and (flat.feature == -1).all() and np.allclose(flat.value, 0)
    with pytest.raises(ValueError):
        trees.fit(rows.where("group = 0"), specs(), ["y", "up"], ["w"])
