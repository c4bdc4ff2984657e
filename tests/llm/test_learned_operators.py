"""Language, line field, mixing, SimHash and the pipeline: held-out accuracy and brute force."""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nitrapanel.llm import langid, linecrf, mixing, queries, simhash
from nitrapanel.llm.coder import tokenizer_path
from nitrapanel.llm.frames import fold

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
EDGE = [None, "", " \n", "12 34 !!", "x", "the\n\n\nof", "word " * 60_000, "a" * 300_000]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", 7) for i, t in enumerate(EDGE)] + [(None, "the", None, 7), (4, "x", "en", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


# -- language ------------------------------------------------------------------------


@needs_tables
def test_language_held_out(spark, documents):
    rows = queries.op2_language(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and np.mean([r["rejected"] for r in rows]) < 0.05


@needs_tables
def test_language_of_odd_texts(documents, edge):
    model = langid.fit(documents.where(fold("doc_id", 4) != 2), most=400)
    got = langid.predict(edge, model).collect()
    assert len(got) == len(EDGE) + 2
    for r in got:
        silent = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == silent and (not silent or (r["score"] == 0 and r["rejected"]))
    assert langid.score_texts(model, ["Привет как дела", "the of and that with"])[2] == [True, False]
    assert langid.predict(edge.limit(0), model).count() == 0


def test_language_without_labels(spark, edge):
    none = langid.fit(edge.where("lang = 'zz'"))
    assert {r["lang_pred"] for r in langid.predict(edge, none).collect()} == {"und"}
    one = langid.fit(edge)
    assert langid.score_texts(one, ["abc", "1"]) == (["en", "und"], [1.0, 0.0], [False, True])


def test_long_texts_are_seen_whole():
    """Counts of a text in many slices equal those of plain n-grams."""
    text = "Ab céd1 " * 70_000 + "zq"
    assert len(text) > 2 * 262_144
    total = 0
    for _, good, starts, lengths, _ in langid.bucket_runs([text, "zq"]):
        total += sum(int(good[s : s + n].sum()) for s, n in zip(starts.tolist(), lengths.tolist()))

    def count(t):
        marks = [c if c.isalpha() else " " for c in t] + [" "] * 3
        n = 0
        for i in range(len(t)):
            for k in langid.ORDERS:
                g = marks[i : i + k]
                n += " " not in g[1:-1] and g != [" "] * k and (k > 2 or g != [" ", " "])
        return n

    assert total == count(text) + count("zq")


# -- quality ---------------------------------------------------------------------------


@needs_tables
def test_quality_held_out(spark, labels):
    rows = queries.op7_line_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert len(bad) > 10 and (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 2, 5, 7, 3])
    scores, moves = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
    good, pairs = linecrf.marginals(scores, sizes, moves)
    at = 0
    for k, n in enumerate(sizes):
        own = scores[at : at + n]
        weight, hit, move = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weight += w
            hit += w * np.array(y)
            for a, b in zip(y, y[1:]):
                move[a, b] += w
        assert np.allclose(good[at : at + n], hit / weight) and np.allclose(pairs[k], move / weight)
        at += n


def test_shifts_bring_the_share_where_the_label_wants_it():
    rng = np.random.default_rng(9)
    sizes, labels = rng.integers(1, 9, 60), rng.integers(0, 2, 60)
    good, lengths = rng.uniform(0.02, 0.98, sizes.sum()), rng.integers(0, 50, sizes.sum()).astype(float)
    shift = linecrf.shifts(good, sizes, lengths, labels)
    before = linecrf.document_quality(good, sizes, lengths)
    odds = np.log(good / (1 - good)) + np.repeat(shift, sizes)
    after = linecrf.document_quality(1 / (1 + np.exp(-odds)), sizes, lengths)
    for label, b, a, d in zip(labels, before, after, shift):
        want = linecrf.GOOD_SHARE if label else linecrf.BAD_SHARE
        if (b >= want) if label else (b <= want):
            assert d == 0
        else:
            assert a == pytest.approx(want, abs=1e-4) and (d > 0) == bool(label)


def test_some_lines_are_evenly_spaced_and_bounded():
    assert linecrf.some_lines(7).tolist() == list(range(7))
    got = linecrf.some_lines(100_000)
    assert len(got) == linecrf.TRAIN_LINES and got[0] == 0 and got[-1] == 99_999 and len(set(got.tolist())) == len(got)


@needs_tables
def test_lines_of_glued_documents_get_their_own_label(documents, labels):
    """Of a text glued from a good and a bad document each side is labelled for itself."""
    model = linecrf.fit(documents, labels.where(fold("doc_id", 3) != 1))
    held = documents.join(labels.where(fold("doc_id", 3) == 1), "doc_id").where("quality IS NOT NULL AND text IS NOT NULL").collect()
    sides = [[r["text"] for r in sorted(held, key=lambda r: r["doc_id"]) if r["quality"] == q and r["text"].count("\n") >= 3] for q in (0, 1)]
    right = []
    for bad, good in zip(*sides):
        for first, second, label in ((good, bad, 1), (bad, good, 0)):
            measures, sizes = linecrf.line_measures([f"{first}\n{second}"])
            bins = linecrf.binned(measures, model.edges)
            p, _ = linecrf.marginals(linecrf.node_scores(bins, sizes, model.weights, model.border, model.bias), sizes, model.moves)
            own = np.arange(len(p)) < first.count("\n") + 1
            right.append(((p > 0.5) == (own == bool(label))).mean())
    assert len(right) >= 10 and np.mean(right) > 0.8
    assert model.moves[0, 1] + model.moves[1, 0] < model.moves[0, 0] + model.moves[1, 1]


@needs_tables
def test_quality_of_odd_texts(documents, labels, edge):
    model = linecrf.fit(documents, labels, most=300)
    got = linecrf.score(edge, model).collect()
    assert len(got) == len(EDGE) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["n_lines"] for r in got if r["text"] == "the\n\n\nof"] == [4]
    assert linecrf.score(edge.limit(0), model).count() == 0
    flat = linecrf.fit(documents, labels.where("quality = 1"), most=50)
    assert set(linecrf.score_texts(flat, EDGE)[0]) == {1.0}
    assert set(linecrf.score_texts(linecrf.fit(documents, labels.limit(0)), EDGE)[0]) == {0.5}


# -- mixing ------------------------------------------------------------------------------


@needs_tables
def test_mixing_meets_its_targets(spark, labels):
    rows = queries.op6_mixing(spark, SF).collect()
    tokens, rates = np.array([r["tokens"] for r in rows]), np.array([r["rate"] for r in rows])
    posterior = np.array([r["posterior"] for r in rows])
    assert (rates >= 0).all() and np.allclose(posterior.sum(axis=1), 1)
    # In the tokenizer's tokens, within the stated tolerance.
    tool = Tokenizer.from_file(tokenizer_path(queries.TOKENIZER))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["tokens"] == len(tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in rows)
    want = np.array([0.96, 0.03, 0.01])
    assert (np.abs((tokens * rates) @ posterior / tokens.sum() - want) <= np.minimum(mixing.CLOSE, mixing.MISS * want) + 1e-9).all()
    truth = {r["doc_id"]: r["domain"] for r in queries.domains(labels).collect()}
    known = [(truth[r["doc_id"]], r["domain"]) for r in rows if r["doc_id"] in truth]
    assert np.mean([a == b for a, b in known]) > 0.95
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)


def test_rates_reach_the_constrained_optimum(spark):
    rng = np.random.default_rng(4)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 90, 300)
    members = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p))], "doc_id long, tokens long, posterior array<double>")
    plan = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.1, "b": 0.2, "c": 0.7}, steps=60)
    got = mixing.with_rates(members, plan).orderBy("doc_id").collect()
    rates = np.array([r["rate"] for r in got])
    assert (rates >= 0).all() and np.allclose((t * rates) @ p / t.sum(), [0.1, 0.2, 0.7], atol=2e-3)
    assert np.allclose(plan.totals, (t * rates) @ p / t.sum())


@pytest.mark.parametrize("share", [1e-2, 1e-3, 1e-4])
def test_a_rare_domain_meets_its_target(spark, share):
    rng = np.random.default_rng(12)
    rare = max(2, int(20_000 * share))
    p = np.full((20_000, 2), [0.9999, 0.0001])
    p[:rare] = [0.02, 0.98]
    p[rare : 2 * rare] = rng.dirichlet([0.5, 0.5], rare)
    members = spark.createDataFrame([(i, 50, x.tolist()) for i, x in enumerate(p)], "doc_id long, tokens long, posterior array<double>")
    for want in (0.01, 0.3):
        plan = mixing.fit_rates(members, ["common", "rare"], {"common": 1 - want, "rare": want})
        rates = np.array([r["rate"] for r in mixing.with_rates(members, plan).orderBy("doc_id").collect()])
        assert plan.converged and np.allclose(plan.totals, rates @ p / len(p))
        assert plan.totals == pytest.approx([1 - want, want], rel=2e-3)


def test_targets_out_of_reach_are_reported(spark):
    members = spark.createDataFrame([(i, 10, [0.6, 0.4]) for i in range(50)], "doc_id long, tokens long, posterior array<double>")
    plan = mixing.fit_rates(members, ["a", "b"], {"a": 0.1, "b": 0.9})
    assert not plan.converged and abs(plan.totals[0] - 0.1) > 0.01


def test_mixing_of_odd_texts(spark, edge):
    model = mixing.fit(edge.withColumn("domain", F.lit(None).cast("string")))
    members = mixing.memberships(edge, model, None)
    plan = mixing.fit_rates(members, model.domains, {})
    assert sorted(r["rate"] for r in mixing.with_rates(members, plan).collect()) == pytest.approx([1.0] * (len(EDGE) + 2), abs=1e-3)
    same = mixing.apply_rates(edge, mixing.with_rates(members, plan._replace(residuals=[])))
    assert same.columns == edge.columns and same.count() == edge.count()
    none = mixing.memberships(edge.limit(0), model, None)
    assert mixing.with_rates(none, mixing.fit_rates(none, model.domains, {})).count() == 0


# -- near duplicates -------------------------------------------------------------------------


def fingerprint(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", folded)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(fps, most):
    """Least index of each component by comparing all with all."""
    forest = simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most):
            forest.join(i, i + 1 + int(j))
    return [forest.find(i) for i in range(len(fps))]


@needs_tables
def test_near_duplicates_equal_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, SF).collect()}
    rows = sorted((r["doc_id"], fingerprint(r["text"])) for r in documents.select("doc_id", "text").collect())
    assert {i: f"{f:016x}" for i, f in rows} == {i: r["fingerprint"] for i, r in got.items()}
    root = closed(np.array([f for _, f in rows], dtype=np.uint64), 4)
    assert {i: rows[k][0] for (i, _), k in zip(rows, root)} == {i: r["component_id"] for i, r in got.items()}


def balls(rng, n, centres, flips):
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        own = np.full(n // 4, c)
        for _ in range(flips):
            own ^= np.uint64(1) << rng.integers(0, 64, len(own), dtype=np.uint64)
        fps = np.concatenate([fps, own])
    return np.unique(fps)


@pytest.mark.parametrize("most", [4, 7])
def test_links_in_a_shard_are_complete(most):
    fps = balls(np.random.default_rng(6), 1500, 5, 4)
    for block in range(simhash.BLOCKS):
        forest = simhash.Forest(len(fps))
        simhash.links(fps, block, forest, most)
        if block == 0:
            every = forest
        else:
            for i in range(len(fps)):
                every.join(i, forest.find(i))
    assert [every.find(i) for i in range(len(fps))] == closed(fps, most)


def test_routing_lets_every_pair_meet():
    rng = np.random.default_rng(7)
    table = simhash.routing(rng.integers(0, 1 << 63, 3000, dtype=np.uint64), 200_000, 1)
    for offsets, shards in table:
        for value in rng.integers(0, 1 << 16, 300):
            for other in (value, *(value ^ (1 << b) for b in range(16))):
                assert set(shards[offsets[value] : offsets[value + 1]]) & set(shards[offsets[other] : offsets[other + 1]])


def test_dense_shards_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 300)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 200)
    fps = balls(np.random.default_rng(8), 1200, 3, 5)
    prints = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    roots = {r["id"]: r["root"] for r in simhash.components(simhash.forest_edges(prints)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == closed(fps, 4)


@pytest.mark.parametrize("most", [4, 7])
def test_two_blocks_let_every_linked_pair_meet(most):
    """Some two blocks differ in most // 4 and most // 3 bits at most, however the bits lie."""
    rng = np.random.default_rng(9)
    for _ in range(2000):
        bits = rng.choice(64, rng.integers(0, most + 1), replace=False)
        by_block = sorted(np.bincount(bits // simhash.BLOCK_BITS, minlength=simhash.BLOCKS).tolist())
        assert by_block[0] <= most // simhash.BLOCKS and by_block[1] <= most // (simhash.BLOCKS - 1)


@pytest.mark.parametrize("most", [4, 7])
def test_dense_shards_go_on_to_a_second_block(spark, monkeypatch, most):
    """No tree over the first block: its one shard is split by the others where that moves less."""
    monkeypatch.setattr(simhash, "TILE", 60)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 1 << 30)
    fps = balls(np.random.default_rng(10), 2400, 2, 5)
    prints = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    seen, deal = [], simhash.deal

    def spy(*args):
        out = deal(*args)
        seen.append({bool(r["split"]): r["n"] for r in out.groupBy((out["second"] >= 0).alias("split")).count().withColumnRenamed("count", "n").collect()})
        return out

    monkeypatch.setattr(simhash, "deal", spy)
    roots = {r["id"]: r["root"] for r in simhash.components(simhash.forest_edges(prints, most)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == closed(fps, most)
    tiled = len(fps) * simhash.BLOCKS * -(-len(fps) // simhash.TILE)
    if most == 4:
        assert set(seen[0]) == {True}
    assert sum(seen[0].values()) <= tiled


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 200)], "a long, b long")
    got = {r["id"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in [*range(1, 61), 200]} | {101: 100}


def test_near_duplicates_of_odd_texts(spark, edge):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) + 2
    zero = [r for r in got if r["fp"] == 0]
    assert {r["component_id"] for r in zero} == {0} and {r["doc_id"] for r in zero} >= {0, 1, 2}
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


# -- the pipeline -----------------------------------------------------------------------------


@needs_tables
def test_pipeline_stage_by_stage(spark, documents, labels):
    import corpus_pipeline as cp

    from nitrapanel.session import materialize

    known = {r["doc_id"]: r for r in labels.collect()}
    docs, seen = documents, {}
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == documents.columns
        docs = out
    ids = {n: [r["doc_id"] for r in out.select("doc_id").collect()] for n, (_, out) in seen.items()}
    clean = {i for i, r in known.items() if r["quality"] == 1}
    assert len(clean & set(ids["quality"])) >= 0.98 * len(clean)
    assert len([i for i in ids["quality"] if i in known and known[i]["quality"] == 0]) <= 0.2 * (len(known) - len(clean))
    # One text of each exact copy stays.
    texts = [r["text"] for r in seen["near_dedup"][1].collect()]
    assert len(texts) == len(set(texts)) == len(set(ids["near_dedup"]))
    # Secrets go, nothing else changes.
    from nitrapanel.llm import secrets

    assert sorted(ids["secrets"]) == sorted(ids["near_dedup"])
    assert secrets.scan(seen["secrets"][1]).where(F.exists("secret_spans", lambda s: s["kind"] < 3)).count() == 0
    assert set(ids["mixing"]) <= set(ids["secrets"])
    calm = {i for i in clean & set(ids["secrets"]) if known[i]["toxic"] == 0}
    assert len(calm & set(ids["mixing"])) >= 0.98 * len(calm)
    packed = seen["packing"][1]
    assert packed.agg(F.sum("length")).first()[0] == sum(
        r["n"] for r in packed.where("start = 0").groupBy("doc_id", "doc_tokens").count().select((F.col("doc_tokens") * F.col("count")).alias("n")).collect()
    )


@pytest.mark.parametrize("toxic", [0, 2, 100])
def test_mixing_never_raises_toxic_text(spark, monkeypatch, toxic):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 9) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    members = docs.select(
        "doc_id", F.lit(50).cast("long").alias("tokens"),
        F.when(F.col("doc_id") < toxic, F.array(F.lit(0.01), F.lit(0.99))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("posterior"),
    )
    model = mixing.Classifier(["clean", "toxic"], {}, np.zeros((mixing.SHAPES, 2)))
    monkeypatch.setattr(mixing, "fit", lambda labelled: model)
    monkeypatch.setattr(mixing, "memberships", lambda docs, model, tokenizer: members)
    monkeypatch.setattr(cp, "_labels", lambda spark, sf_dir: docs.select("doc_id", F.lit(0).alias("toxic")))
    copies = {r["doc_id"]: r["count"] for r in cp.mix(spark, docs, "").groupBy("doc_id").count().collect()}
    assert all(i in copies for i in range(toxic, 2000))
    assert sum(copies.get(i, 0) for i in range(toxic)) <= (toxic if toxic < 10 else 40)
