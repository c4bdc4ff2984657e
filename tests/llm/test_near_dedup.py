"""SimHash components with missing ids, and the rows that the pipeline's near-duplicate stage keeps."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from nitrapanel.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fingerprint(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", folded)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, most=4):
    """Least position of each component by comparing all with all."""
    fps = np.array(fps, dtype=np.uint64)
    forest = simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most):
            forest.join(i, i + 1 + int(j))
    return [forest.find(i) for i in range(len(fps))]


def edited(seed, families, each, most):
    """Families of texts in which some words of an ancestor or of a sibling are replaced."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(families):
        own = [[f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 300))]]
        for _ in range(each - 1):
            words = list(own[rng.integers(0, len(own))])
            for at in rng.integers(0, len(words), max(1, int(len(words) * rng.uniform(0, most)))):
                words[at] = f"w{rng.integers(0, 5000)}"
            own.append(words)
        out += [" ".join(w) for w in own]
    return [out[i] for i in rng.permutation(len(out))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def kept(spark, rows):
    out = cp.near_dedup(spark, table(spark, rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_one_of_each_component_stays(spark):
    texts = edited(3, 50, 6, 0.02)
    root = roots([fingerprint(t) for t in texts])
    assert 50 < len(set(root)) < len(texts) - 40
    assert kept(spark, enumerate(texts)) == sorted(((i, texts[i]) for i in set(root)), key=repr)


def prints(spark, monkeypatch, rows):
    """Lets the operator find these fingerprints."""
    own = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: own)
    return {tuple(r) for r in simhash.near_duplicates(own).select("doc_id", "fp", "component_id").collect()}


def test_rows_without_id_are_bridges(spark, monkeypatch):
    got = prints(spark, monkeypatch, [(1, 0), (None, 15), (3, 255), (None, -1), (None, -1), (9, 1 << 40)])
    assert got == {(1, 0, 1), (None, 15, 1), (3, 255, 1), (None, -1, None), (9, 1 << 40, 1)}


def test_missing_ids_and_negative_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    fps = np.concatenate([fps, fps[:100] ^ (np.int64(7) << rng.integers(0, 60, 100)), fps[:50]])
    ids = [None if rng.random() < 0.3 else int(i) for i in rng.integers(0, 400, len(fps))]
    root = roots(fps.view(np.uint64))
    name = {k: min((ids[i] for i in range(len(fps)) if root[i] == k and ids[i] is not None), default=None) for k in set(root)}
    assert prints(spark, monkeypatch, list(zip(ids, fps.tolist()))) == {(i, f, name[k]) for i, f, k in zip(ids, fps.tolist(), root)}


@pytest.mark.parametrize("rows, stay", [
    ([(None, "one"), (None, "one"), (4, "one")], [(4, "one")]),
    ([(None, "one"), (None, "one")], [(None, "one")]),
    ([(0, None), (1, ""), (2, " \n")], [(0, None)]),
])
def test_odd_rows(spark, rows, stay):
    assert kept(spark, rows) == stay


def test_empty_and_very_long_texts(spark):
    assert cp.near_dedup(spark, table(spark, [(1, "x")]).limit(0), "").count() == 0
    texts = ["one", "ONE", "one two", "word " * 60_000, "word " * 50_000, "a" * 300_000]
    assert [i for i, _ in kept(spark, enumerate(texts))] == sorted(set(roots([fingerprint(t) for t in texts])))


def test_rows_that_share_an_id(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    # Two texts of id 7: both stay.  Id 8: a copy of an earlier text goes, the text that is its own stays.
    rows = [(1, first), (7, second), (7, third), (7, third), (8, first), (8, "only here")]
    assert kept(spark, rows) == sorted([(1, first), (7, second), (7, third), (8, "only here")])
