from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from conftest import months, panel_rows, rows_of, PANEL
from pyspark.sql import functions as F

from nitrapanel.constants import HOLDOUT_START, HORIZONS, SHOCK_TARGET_START
from nitrapanel.models import baseline, boosted, metrics, splits
from nitrapanel.operators.features import build_features, latest_complete

HOLDOUT = dt.date.fromisoformat(HOLDOUT_START)


@pytest.fixture(scope="module")
def roles(spark):
    ms = [("a", m, h) for m in months("2000-01", 318) for h in HORIZONS]
    df = spark.createDataFrame(ms, "series string, month date, horizon int")
    df = df.withColumn("target_month", F.add_months("month", F.col("horizon")))
    return splits.chrono_split(df).toPandas()


@pytest.mark.parametrize("h", HORIZONS)
def test_split_is_chronological_and_purged(roles, h):
    mine = roles[roles.horizon == h]
    train, test = mine[mine.role == "train"], mine[mine.role == "test"]
    assert len(train) and len(test)
    assert train.month.max() < test.month.min()
    assert train.target_month.max() < HOLDOUT
    assert (mine.role == "purged").sum() == h


def test_shock_window_lies_in_the_holdout():
    assert HOLDOUT_START <= SHOCK_TARGET_START


@pytest.mark.parametrize("n", [7, 12, 37, 100])
def test_folds_match_the_expanding_split(spark, n):
    df = spark.createDataFrame([("a", 1, m) for m in months("2000-01", n)], "series string, horizon int, month date")
    got = splits.walk_forward(df, ["series", "horizon"]).toPandas()
    size = n // 6
    for fold, start in enumerate(range(n - 5 * size, n, size)):
        mine = got[got.fold == fold]
        assert sorted(mine[mine.fold_role == "train"].pos) == list(range(max(start - 1, 0)))
        assert sorted(mine[mine.fold_role == "valid"].pos) == list(range(start, start + size))


def test_pooled_folds_are_cut_by_calendar(spark):
    """A young series never puts rows behind another one's validation months."""
    old, young = months("2000-01", 60), months("2003-06", 19)
    df = spark.createDataFrame([("o", 1, m) for m in old] + [("y", 1, m) for m in young], "series string, horizon int, month date")
    got = splits.walk_forward(df, ["horizon"]).toPandas()
    assert set(got.series) == {"o", "y"}
    for _, mine in got.groupby("fold"):
        valid = mine[mine.fold_role == "valid"]
        assert mine[mine.fold_role == "train"].month.max() < valid.month.min() and len(set(valid.month)) == 10


def test_recency_weight_spans_one_to_one_and_a_half(spark):
    ms = months("2000-01", 5)
    df = spark.createDataFrame([("a", m) for m in ms] + [("b", ms[0])], "series string, month date")
    got = rows_of(splits.recency_weight(df, ["series"]), "series", "month")
    want = [1 + 0.5 * (m - ms[0]).days / (ms[-1] - ms[0]).days for m in ms]
    assert [r["weight"] for r in got] == pytest.approx(want + [1.0])


def test_weighted_line_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(400, 30, 50), rng.uniform(1, 1.5, 50)
    y = 20 + 0.9 * x + rng.normal(0, 5, 50)
    df = spark.createDataFrame([("a", 1, *map(float, r)) for r in zip(x, y, w)], "series string, horizon int, urea double, target double, weight double")
    got = baseline.weighted_line(df).first()
    slope, intercept = np.polyfit(x, y, 1, w=np.sqrt(w))
    assert got.slope == pytest.approx(slope) and got.y_mean - got.slope * got.x_mean == pytest.approx(intercept)


def test_window_metrics_bucket_by_target_month(spark):
    rows = [
        ("a", 1, dt.date(2025, 12, 1), 100.0, 110.0, 105.0, 1, 1),
        ("a", 1, dt.date(2026, 1, 1), 100.0, 90.0, 105.0, 0, 1),
        ("b", 1, dt.date(2025, 1, 1), 100.0, 100.0, 99.0, 0, 0),
    ]
    df = spark.createDataFrame(
        rows, "series string, horizon int, target_month date, urea double, target double, pred double, label int, label_pred int"
    )
    got = {(r["series"], r["bucket"]): r for r in rows_of(metrics.evaluate(df))}
    assert set(got) == {("a", "full"), ("a", "preshock"), ("a", "shock"), ("b", "full"), ("b", "preshock")}
    assert got["a", "preshock"]["rmse"] == 5.0 and got["a", "shock"]["mae"] == 15.0
    assert got["a", "full"]["dir_acc"] == 0.5 and got["a", "full"]["residual_std"] == 10.0
    assert got["b", "full"]["dir_acc"] == 0.5 and got["b", "full"]["clf_acc"] == 1.0


@pytest.fixture(scope="module")
def features(spark):
    rows = [r for i, s in enumerate(("a", "b")) for r in panel_rows(s, 90, i, "2016-01")]
    return build_features(spark.createDataFrame(rows, PANEL)).cache()


@pytest.fixture(scope="module")
def trained(features):
    return boosted.train(features, "2021-06-01", "2023-01-01", iterations=4)


def test_boosted_training(trained, features):
    report = {(r["series"], r["horizon"], r["bucket"]) for r in rows_of(trained.metrics)}
    assert ("a", 3, "preshock") in report and ("b", 1, "full") in report
    cv = rows_of(trained.cv)
    assert len(cv) == 6 and all(r["cv_residual_std"] > 0 for r in cv)
    want = rows_of(boosted.predict(trained.models, latest_complete(features)), "series")
    assert all(0 <= r["prob_up_t3"] <= 1 and 200 < r["t1"] < 800 for r in want)


def test_saved_models_come_back_with_their_contract(spark, trained, features, tmp_path, monkeypatch):
    root, now = str(tmp_path / "m"), latest_complete(features)
    facts = boosted.window_facts(features, "2021-06-01", "2023-01-01")
    boosted.save(trained.models, root, facts, trained.metrics)
    saved = boosted.load_saved(spark, root)
    assert rows_of(boosted.predict(saved.models, now), "series") == rows_of(boosted.predict(trained.models, now), "series")
    assert saved.facts == facts and facts["training_window_end"] == "2021-05" and facts["holdout_start"] == "2021-06"
    key = ("series", "horizon", "bucket")
    assert rows_of(saved.metrics, *key) == rows_of(trained.metrics, *key)
    bare = str(tmp_path / "n")
    boosted.save(trained.models.without_classifiers(), bare)
    assert "prob_up_t1" not in boosted.predict(boosted.load(spark, bare), now).columns
    # Another name, or another order, is another contract.
    renamed = ["gas_spot", *boosted.INPUTS[1:]]
    for inputs in (renamed, boosted.INPUTS[::-1]):
        monkeypatch.setattr(boosted, "INPUTS", inputs)
        with pytest.raises(boosted.ContractBroken):
            boosted.load(spark, root)
    monkeypatch.undo()
    # Trees that the contract does not name.
    boosted.save(trained.models, bare)
    spark.read.parquet(f"{root}/trees").where("name <> 't2'").write.mode("overwrite").parquet(f"{bare}/trees")
    with pytest.raises(boosted.ContractBroken):
        boosted.load(spark, bare)


def test_a_series_without_training_rows_takes_pooled_figures(trained, features):
    now = latest_complete(features).where("series = 'a'")
    young = rows_of(boosted.predict(trained.models, now.withColumn("series", F.lit("unknown"))))
    assert len(young) == 1 and 200 < young[0]["t1"] < 800


def jobs_of(spark, run):
    """Number of Spark jobs that ``run`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{np.random.randint(1 << 30)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_horizons_and_seeds(spark, features, monkeypatch):
    rows = boosted.training_rows(features, "2021-06-01")
    many = jobs_of(spark, lambda: boosted.holdout_scores(rows, [1, 2, 3], 2))
    monkeypatch.setattr(boosted, "HORIZONS", (1,))
    assert jobs_of(spark, lambda: boosted.holdout_scores(rows.where("horizon = 1"), [1], 2)) == many


def test_labels_follow_the_price_move(features):
    rows = rows_of(splits.by_horizon(features, ["urea"]).where("target is not null"))
    assert all(r["label"] == int(r["target"] > r["urea"]) for r in rows)
