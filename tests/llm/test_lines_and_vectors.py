"""Line dedup, whitening and hard negatives against brute force, with odd inputs."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest
from conftest import ROOT

from nitrapanel.llm import hardneg, linededup, whitening

DOCS = "doc_id long, text string, kept_text string, lines long"
VECS = "vec_id long, embedding array<float>, label int, x long, v string, n long"


# -- line dedup ------------------------------------------------------------------------


def plain_lines(rows, least):
    """(doc_id, kept text, lines, dropped) of every row, sorted."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, lines in split for k in {key(x) for x in lines})
    gone = {k for k, c in n.items() if c >= least and k}
    out = [(i, "\n".join(x for x in lines if key(x) not in gone), len(lines), sum(key(x) in gone for x in lines)) for i, lines in split]
    return sorted(out, key=repr)


def got_lines(df):
    return sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


def line_rows(seed, n):
    """A line in all texts, some in many, odd white space, letters whose case must stay, a very long text."""
    rng = np.random.default_rng(seed)
    common = ["Terms of USE", "\tterms of use \x0b", "All rights reserved", "ÄRGER", "ärger", " x", " ", "a\r", " "]
    rows = []
    for i in range(n):
        lines = [common[k] for k in rng.integers(0, len(common), 4)] + [f"own {rng.integers(0, 9 * n)}" for _ in range(5)]
        rows.append((i, "\n".join(lines[j] for j in rng.permutation(len(lines)))))
    rows += [(None, "All rights reserved\nx"), (3, rows[3][1]), (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "terms of use"), (n + 4, "TERMS OF USE\n" * 30_000)]
    return rows


@pytest.mark.parametrize("sent", [linededup.BROADCAST_BYTES, -1], ids=["index broadcast", "index sharded"])
def test_lines_equal_brute_force(spark, sent, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 7)
    rows = line_rows(1, 120)
    docs = spark.createDataFrame([(i, t, "other", 5) for i, t in rows], DOCS).repartition(5)
    out = linededup.drop_lines(docs, least=4, broadcast_bytes=sent)
    assert out.columns == ["doc_id", "text", "lines", "kept_text", "n_lines", "n_dropped"]
    assert got_lines(out) == plain_lines(rows, 4)


@pytest.mark.parametrize("sent", [linededup.BROADCAST_BYTES, -1])
def test_lines_of_an_empty_table(spark, sent):
    docs = spark.createDataFrame([], DOCS)
    assert linededup.drop_lines(docs, broadcast_bytes=sent).collect() == []


def test_no_line_is_frequent(spark):
    docs = spark.createDataFrame([(1, "a\nb", "", 0), (2, "a\nc", "", 0)], DOCS)
    assert got_lines(linededup.drop_lines(docs, least=3)) == [(1, "a\nb", 2, 0), (2, "a\nc", 2, 0)]


def test_perfect_hash_has_a_slot_for_each_hash_and_knows_strangers():
    rng = np.random.default_rng(2)
    halves = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    halves[:50, 0] = halves[0, 0]  # equal first halves are told apart by the second
    counts = rng.integers(1, 1 << 20, len(halves))
    shard = linededup.shard_of(halves, 3)
    index = linededup.Index([linededup.build(halves[shard == i], counts[shard == i]) for i in range(3)])
    assert len(index.prints) == len(index.counts) == len(halves)
    assert (index.count(halves) == counts).all()
    assert not index.count(rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)).any()
    assert len(index.bits) * 8 < 9 * len(halves)


def test_registered_lines(spark):
    from nitrapanel.llm.queries import op11_line_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain_lines(rows, 10)]
    got = [tuple(r) for r in op11_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got) == sorted(want)


# -- whitening -----------------------------------------------------------------------------


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", 2) for i, v, label in rows], VECS)


def plain_whitening(vectors, components):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = (n * fit - sums) / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    m = min(components, int((values > 1e-10 * values[0]).sum()))
    white = ((n * x - sums) / n) @ axes[:, :m] / np.sqrt(values[:m])
    return n, ((n * x - sums) ** 2).sum(axis=1), white, values[:m] / values.sum()


def check_whitening(spark, rows, components=16, near=1e-8):
    good = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, white, explained = plain_whitening([v for _, v in good], components)
    got = whitening.whiten(vector_table(spark, rows), components).orderBy("vec_id", "component", "whitened").collect()
    m = white.shape[1]
    assert len(got) == len(good) * m and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 10 * near
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted(zip([i for i, _ in good], deviation.tolist()))
    order = np.argsort([i for i, _ in good], kind="stable")
    for k in range(m):
        own = np.array([r["whitened"] for r in got if r["component"] == k + 1])
        # Equal ids stand in any order.
        ids = [r["vec_id"] for r in got if r["component"] == k + 1]
        want = white[order, k]
        sign = np.sign(own @ want) if len(set(ids)) == len(ids) else None
        if sign is not None:
            assert np.abs(own * sign - want).max() < near
        assert abs(got[k]["explained"] - explained[k]) < near * explained[k] if got[k]["component"] == k + 1 else True


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    spread = rng.standard_normal((600, 72)) * (1 + np.exp(-np.arange(72) / 20))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(spread)]
    # Repeated vectors count once, odd rows take no part.
    rows += [(1000 + i, rows[5][1], None) for i in range(40)]
    rows += [(2000, None, 1), (2001, [float("nan")] * 72, 1), (2002, [float("inf")] + [0.0] * 71, 1), (2003, [None] + [0.0] * 71, 1), (2004, [], 1)]
    check_whitening(spark, rows)


def test_sums_of_many_tasks_meet_before_the_driver(spark):
    from nitrapanel.llm.vectors import in_many_tasks, summed

    rows = spark.range(1000).repartition(90)
    total = lambda b: np.array([b.num_rows, b.column(0).to_numpy().sum()])
    assert in_many_tasks(rows) and not in_many_tasks(spark.range(10).coalesce(2))
    for many in (True, False):
        assert summed(rows, total, np.zeros(2, np.int64), many).tolist() == [1000, 499_500]


def test_whitening_of_few_dimensions_and_flat_ones(spark):
    rng = np.random.default_rng(6)
    low = rng.standard_normal((50, 2)) @ rng.standard_normal((2, 5)) * 10
    # Two large directions, three from rounding down (a ten-millionth of the variance), one flat.
    check_whitening(spark, [(i, [*v.tolist(), 1.0], 0) for i, v in enumerate(low)], near=1e-5)


def test_whitening_without_variance_and_of_mixed_lengths(spark):
    assert whitening.whiten(vector_table(spark, [])).collect() == []
    assert whitening.whiten(vector_table(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    assert whitening.whiten(vector_table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect() == []
    got = whitening.whiten(vector_table(spark, [(1, [1.0, 2.0], 1), (None, [2.0, 2.0], 1), (3, [1.0], 1)])).collect()
    assert [(r["vec_id"], abs(round(r["whitened"], 9)), r["explained"], r["deviation"]) for r in sorted(got, key=lambda r: str(r["vec_id"]))] == [
        (1, 1.0, 1.0, 64**2), (None, 1.0, 1.0, 64**2),
    ]


def test_deviation_is_exact_or_null():
    n, x = 1 << 40, np.array([[1 << 20], [2], [0]], dtype=np.int64)
    sums = np.array([n], dtype=np.int64)
    assert whitening.deviations(x, n, sums) == [None, None, None]
    assert whitening.deviations(x, 1 << 30, np.array([(1 << 31) + 5])) == [None, 25, ((1 << 31) + 5) ** 2]


# -- hard negatives ----------------------------------------------------------------------------


def plain_negatives(rows, every=100, positives=5, negatives=10):
    ids = [i if i is not None else hardneg.NO_ID for i, *_ in rows]
    x = np.floor(256 * np.array([v for _, v, _ in rows], dtype=np.float32).astype(float)).astype(np.int64)
    labels = [label for *_, label in rows]
    out = []
    for a in range(len(rows)):
        if ids[a] % every or ids[a] == hardneg.NO_ID:
            continue
        scores = (x @ x[a]).tolist()
        best = sorted((r for r in range(len(rows)) if r != a and labels[r] == labels[a]), key=lambda r: (-scores[r], ids[r]))[:positives]
        for p in best:
            fit = [r for r in range(len(rows)) if labels[r] != labels[a] and 30 * scores[p] <= 100 * scores[r] <= 90 * scores[p]]
            for k, r in enumerate(sorted(fit, key=lambda r: (-scores[r], ids[r]))[:negatives]):
                out.append((rows[a][0], rows[p][0], k + 1, rows[r][0], scores[p], scores[r]))
    return sorted(out, key=repr)


def got_negatives(spark, rows, **more):
    return sorted((tuple(r) for r in hardneg.mine(vector_table(spark, rows), **more).collect()), key=repr)


def clustered(seed, n, d, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, d))
    label = rng.integers(0, labels, n)
    x = (centres[label] + rng.standard_normal((n, d)) * 0.7) * rng.uniform(0.1, 2, (n, 1))
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    monkeypatch.setattr(hardneg, "STEP_ANCHORS", 7)
    rows = clustered(7, 500, 6)
    # A vector that is very common, ties, a zero vector, opposite ones, NULL ids, repeated rows and a repeated anchor.
    rows += [(1000 + i, rows[10][1], 0) for i in range(60)] + [(2000, [0.0] * 6, 1), (2100, [-c for c in rows[0][1]], 2)]
    rows += [(None, rows[20][1], 1), (None, rows[20][1], 3), rows[40], rows[40], rows[33]]
    want = plain_negatives(rows, every=20)
    odd = [(3000, None, 1), (3020, [float("nan")] * 6, 1), (3040, [None] * 6, 2), (3060, [1.0] * 6, None), (3080, [], 1), (3100, [1.0], 1)]
    assert got_negatives(spark, rows + odd, every=20) == want
    # The size of a round does not matter.
    assert got_negatives(spark, rows, every=20, round_anchors=5) == want


def test_few_rows(spark):
    assert got_negatives(spark, []) == []
    assert got_negatives(spark, [(0, [1.0, 0.0], 1)]) == []
    assert got_negatives(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2), (3, [0.95, 0.0], 2)]) == [(0, 1, 1, 2, 65536, 32768)]


def test_bounds_hold_and_blocks_are_skipped():
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((300, 5)) * 200).astype(np.int32)
    x[:5], x[5:10] = 0, x[10:15] * 3
    references = rng.standard_normal((6, 5))
    references /= np.linalg.norm(references, axis=1, keepdims=True)
    norms, angles = hardneg.angles_to(x.astype(float), references)
    lower, upper = hardneg.bounds(norms, angles, norms, angles)
    true = x.astype(np.int64) @ x.astype(np.int64).T
    assert (lower <= true).all() and (true <= upper).all()
    raw = [np.arange(300, dtype="<i8"), np.zeros(300, "<i8"), x.astype("<i4"), norms, angles]
    order = np.argsort(angles[:, 0])[:40]
    block = hardneg.Block(*[c[order].tobytes() for c in raw])
    low, high = block.overlap(norms, angles)
    assert (low[:, None] <= true[:, order]).all() and (true[:, order] <= high[:, None]).all()
    # With a reference inside a narrow cone the bounds are narrow, and a block of it is passed over as one.
    cone = np.eye(5)[0] + rng.standard_normal((400, 5)) * 0.03
    references[0] = np.eye(5)[0]
    norms, angles = hardneg.angles_to(cone * 500, references)
    lower, upper = hardneg.bounds(norms[:20], angles[:20], norms, angles)
    assert ((upper - lower) < 0.1 * (norms[:20, None] * norms)).mean() > 0.9
    raw = [np.arange(400, dtype="<i8"), np.zeros(400, "<i8"), (cone * 500).astype("<i4"), norms, angles]
    block, away = hardneg.Block(*[c.tobytes() for c in raw]), hardneg.angles_to(np.eye(5)[1:3] * 500, references)
    assert (block.overlap(*away)[1] < 0.2 * 500 * norms.max()).all()


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_hard_negatives"])
def test_queries_match_sql(spark, name):
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from check_queries import compare, connect, normal

    from nitrapanel.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    df = queries()[name](spark, sf)
    cur = connect(sf).execute(oracle_sql()[name])
    want = normal([d[0] for d in cur.description], cur.fetchall())
    assert compare(normal(df.columns, [tuple(r) for r in df.collect()]), want) is None


def test_registered_whitening(spark):
    from nitrapanel.llm.queries import op12_whitening

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = plain_whitening([r["embedding"] for r in rows], 16)
    got = op12_whitening(spark, sf).orderBy("vec_id", "component").collect()
    own = np.array([r["whitened"] for r in got]).reshape(len(rows), -1)
    sign = np.sign((own * white).sum(axis=0))
    assert np.abs(own * sign - white).max() < 1e-8
    assert [r["deviation"] for r in got[:: white.shape[1]]] == deviation.tolist()
    assert np.allclose([r["explained"] for r in got[: white.shape[1]]], explained, rtol=1e-9)
