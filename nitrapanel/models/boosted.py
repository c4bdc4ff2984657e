"""Boosted-tree price and direction models, pooled over all series.

One regressor and one classifier per horizon.  All models of a job (horizons, kinds,
folds, seeds) are fitted together by ``trees.fit``.  Metrics come from the chronological
holdout and are measured before the final refit on all trainable rows.

The series of a row enters through the level and the spread of its price over the
training rows (``SERIES_FEATURES``), so series of a like price stand together; a series
without training rows takes the pooled figures.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.constants import FEATURE_COLS, HOLDOUT_START, HORIZONS, KEY, MONTH, SEED, SHOCK_TARGET_START
from nitrapanel.functions.clean import months_after
from nitrapanel.models import trees
from nitrapanel.models.baseline import labelled
from nitrapanel.models.metrics import cv_residuals, evaluate, seed_spread
from nitrapanel.models.splits import FOLDS, recency_weight, walk_forward
from nitrapanel.models.trees import Ensemble, Spec
from nitrapanel.operators.bundle import training_window
from nitrapanel.operators.features import complete_rows
from nitrapanel.session import materialize

ITERATIONS = 100
# Sum of second derivatives a child must have.
REGRESSOR_CHILD, CLASSIFIER_CHILD = 2.0, 1.0
SERIES_FEATURES = ["series_level", "series_spread"]
INPUTS = [*FEATURE_COLS, *SERIES_FEATURES]
LABELS = ["target", "label"]

# Recency weights over the training rows, and over all rows for the final refit.
TRAIN_WEIGHT, FULL_WEIGHT = "weight_train", "weight_all"


class Models(NamedTuple):
    """Ensembles by name (t1.., dir_t1..) and the series figures they were trained with."""

    ensembles: dict[str, Ensemble]
    series: DataFrame  # series (NULL: pooled), series_level, series_spread

    def without_classifiers(self) -> Models:
        return Models({n: m for n, m in self.ensembles.items() if not m.logistic}, self.series)


class Trained(NamedTuple):
    models: Models
    metrics: DataFrame
    cv: DataFrame


class ContractBroken(ValueError):
    """Stored models do not fit this code: other features, another order, other horizons."""


# -- rows ------------------------------------------------------------------------------


def training_rows(features: DataFrame, holdout_start: str = HOLDOUT_START) -> DataFrame:
    """Labelled rows of all horizons with role and both weights.

    Stored once: every fit is then a filtered scan without a shuffle.
    """
    rows = labelled(features, holdout_start)
    keys = [KEY, "horizon"]
    rows = recency_weight(rows, keys, F.col("role") == "train", TRAIN_WEIGHT)
    return materialize(recency_weight(rows, keys, name=FULL_WEIGHT), "training_rows")


def series_figures(rows: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """Level and spread of the price over the rows with a weight, per ``by`` and series and, with series NULL, pooled."""
    known = rows.where(F.col(weight) > 0)
    figures = [F.avg("urea").alias(SERIES_FEATURES[0]), F.coalesce(F.stddev_pop("urea"), F.lit(0.0)).alias(SERIES_FEATURES[1])]
    own = known.groupBy(*by, KEY).agg(*figures)
    pooled = known.groupBy(*by).agg(*figures).withColumn(KEY, F.lit(None).cast(rows.schema[KEY].dataType))
    return own.unionByName(pooled)


def with_series(rows: DataFrame, figures: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``features``, the vector of ``INPUTS``, and ``key``, a hash of series and month."""
    level, spread = SERIES_FEATURES
    own = figures.where(F.col(KEY).isNotNull())
    # One row for each group at most.
    pooled = figures.where(F.col(KEY).isNull()).select(*by, F.col(level).alias("_level"), F.col(spread).alias("_spread"))
    out = rows.join(own, [*by, KEY], "left")
    if by:
        out = out.join(F.broadcast(pooled), by, "left")
    else:
        only = pooled.first()  # one row
        out = out.withColumns({name: F.lit(only[name] if only else None).cast("double") for name in ("_level", "_spread")})
    out = out.withColumn(level, F.coalesce(level, "_level")).withColumn(spread, F.coalesce(spread, "_spread"))
    vector = F.array(*[F.col(c).cast("double") for c in INPUTS])
    return out.withColumn("features", vector).withColumn("key", F.xxhash64(KEY, MONTH)).drop("_level", "_spread", level, spread)


def regressor(name: str, group: int, seed: int, iterations: int, weight: int = 0) -> Spec:
    return Spec(name, group, 0, weight, False, REGRESSOR_CHILD, seed, iterations)


def classifier(name: str, group: int, seed: int, iterations: int, weight: int = 0) -> Spec:
    return Spec(name, group, 1, weight, True, CLASSIFIER_CHILD, seed, iterations)


def both(group: int, seed: int, iterations: int, suffix: str = "") -> list[Spec]:
    return [regressor(f"t{group}{suffix}", group, seed, iterations), classifier(f"dir_t{group}{suffix}", group, seed, iterations)]


# -- fits ------------------------------------------------------------------------------


def holdout_scores(rows: DataFrame, seeds: list[int], iterations: int = ITERATIONS) -> DataFrame:
    """Per horizon and seed, both models fitted on the training rows and scored on the holdout.

    Rows series/month/horizon/target_month/urea/target/label with ``seed``, ``pred``,
    ``prob_up`` and ``label_pred``; stored.
    """
    grouped = rows.withColumn("group", F.col("horizon").cast("int"))
    made = with_series(grouped, series_figures(grouped, TRAIN_WEIGHT, ["group"]), ["group"])
    specs = [s for h in HORIZONS for seed in seeds for s in both(h, seed, iterations, f"/{seed}")]
    fitted = trees.fit(made, specs, LABELS, [TRAIN_WEIGHT])
    by_group = {h: [fitted[f"{kind}t{h}/{seed}"] for kind in ("", "dir_") for seed in seeds] for h in HORIZONS}
    test = made.where("role = 'test'").select(KEY, MONTH, "horizon", "target_month", "urea", "target", "label", "group", "features")
    n = len(seeds)
    each = trees.score(test, by_group).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    prob = F.col("scores")[F.col("at") + n]
    out = each.select(
        KEY, MONTH, "horizon", "target_month", "urea", "target", "label",
        F.array(*map(F.lit, seeds))[F.col("at")].alias("seed"),
        F.col("scores")[F.col("at")].alias("pred"),
        prob.alias("prob_up"),
        (prob > 0.5).cast("int").alias("label_pred"),
    )
    return materialize(out, "scores")


def cross_validate(
    rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, iterations: int = ITERATIONS, seed: int = SEED
) -> DataFrame:
    """Validation predictions of the walk-forward folds inside the training rows."""
    pool = rows.where(F.col("horizon").isin(*horizons) & (F.col("role") == "train"))
    folds = walk_forward(pool, ["horizon"]).withColumn("group", (F.col("horizon") * FOLDS + F.col("fold")).cast("int"))
    fold_weight = F.when(F.col("fold_role") == "train", F.col(TRAIN_WEIGHT))
    folds = materialize(folds.withColumn("fold_weight", fold_weight), "folds")
    made = with_series(folds, series_figures(folds, "fold_weight", ["group"]), ["group"])
    # A short history may leave the first folds without training rows: they are passed over.
    groups = [r["group"] for r in folds.where("fold_weight > 0").select("group").distinct().collect()]  # folds x horizons at most
    fitted = trees.fit(made, [regressor(str(g), g, seed, iterations) for g in groups], LABELS, ["fold_weight"]) if groups else {}
    valid = made.where(F.col("fold_role").eqNullSafe("valid") & F.col("group").isin(groups))
    scored = trees.score(valid.select(KEY, MONTH, "horizon", "fold", "target", "group", "features"), {g: [fitted[str(g)]] for g in groups})
    return materialize(scored.select(KEY, MONTH, "horizon", "fold", "target", F.col("scores")[0].alias("pred")), "cv_scores")


def refit(rows: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> Models:
    """Models of all horizons on every trainable row."""
    # One set of series figures for all horizons: that of the shortest, which has most rows.
    figures = materialize(series_figures(rows.where(F.col("horizon") == HORIZONS[0]), FULL_WEIGHT, []), "series_figures")
    made = with_series(rows.withColumn("group", F.col("horizon").cast("int")), figures, [])
    return Models(trees.fit(made, [s for h in HORIZONS for s in both(h, seed, iterations)], LABELS, [FULL_WEIGHT]), figures)


def train(
    features: DataFrame,
    holdout_start: str = HOLDOUT_START,
    shock_start: str = SHOCK_TARGET_START,
    iterations: int = ITERATIONS,
    seed: int = SEED,
) -> Trained:
    """Evaluate on the holdout, cross-validate, then refit on everything."""
    rows = training_rows(features, holdout_start)
    scores = holdout_scores(rows, [seed], iterations)
    folds = cross_validate(rows, HORIZONS, iterations, seed)
    return Trained(refit(rows, iterations, seed), evaluate(scores, shock_start), cv_residuals(folds))


def predict(models: Models, latest: DataFrame) -> DataFrame:
    """t1..t3 and, where a classifier exists, prob_up_t1..t3 for each feature row."""
    names = {f"t{h}": f"t{h}" for h in HORIZONS} | {f"dir_t{h}": f"prob_up_t{h}" for h in HORIZONS if f"dir_t{h}" in models.ensembles}
    rows = with_series(latest, models.series, []).withColumn("group", F.lit(0))
    out = trees.score(rows, {0: [models.ensembles[n] for n in names]})
    made = [F.col("scores")[i].alias(c) for i, c in enumerate(names.values())]
    return out.select(KEY, MONTH, F.col("urea").alias("current"), "ng_spot", "ng_mom_1m", *made)


def forecast_long(point: DataFrame) -> DataFrame:
    """Wide point forecasts to one row per series and horizon, as the simulation reads them."""
    options = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"t{h}").alias("pred")) for h in HORIZONS])
    return point.select(KEY, MONTH, "current", "ng_spot", "ng_mom_1m", F.explode(options).alias("o")).select(
        KEY,
        MONTH,
        F.col("o.horizon").alias("horizon"),
        months_after(F.col(MONTH), F.col("o.horizon")).alias("target_month"),
        "current",
        "ng_spot",
        "ng_mom_1m",
        F.col("o.pred").alias("pred"),
    )


def sweep_metrics(
    features: DataFrame,
    n_seeds: int = 20,
    holdout_start: str = HOLDOUT_START,
    shock_start: str = SHOCK_TARGET_START,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """Pre-shock holdout metrics per seed and horizon of refits that differ in their seed alone."""
    scores = holdout_scores(training_rows(features, holdout_start), list(range(n_seeds)), iterations)
    return evaluate(scores, shock_start, keys=["seed"]).where(F.col("bucket") == "preshock")


def seed_sweep(
    features: DataFrame,
    n_seeds: int = 20,
    holdout_start: str = HOLDOUT_START,
    shock_start: str = SHOCK_TARGET_START,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """Spread of the pre-shock holdout metrics over refits with different seeds."""
    return seed_spread(sweep_metrics(features, n_seeds, holdout_start, shock_start, iterations), keys=[])


# -- stored models -----------------------------------------------------------------------

TREE_ROWS = "name string, logistic boolean, base double, tree int, feature array<long>, cut array<double>, value array<double>"


def contract_of(models: Models) -> dict:
    """What code that uses the models has to agree on."""
    return {
        "inputs": INPUTS,
        "horizons": list(HORIZONS),
        "regressors": sorted(n for n, m in models.ensembles.items() if not m.logistic),
        "classifiers": sorted(n for n, m in models.ensembles.items() if m.logistic),
    }


def window_facts(features: DataFrame, holdout_start: str = HOLDOUT_START, shock_start: str = SHOCK_TARGET_START) -> dict:
    """First and last trainable month of all series and the nominal boundaries of the evaluation."""
    pooled = complete_rows(features, True).withColumn(KEY, F.lit("all"))
    row = training_window(pooled, holdout_start, shock_start).drop(KEY).first()
    return row.asDict() if row else {}


def save(models: Models, root: str, facts: dict | None = None, metrics: DataFrame | None = None) -> None:
    """Store trees, series figures and, last, the contract with ``facts`` (windows and the like).

    ``metrics`` are those measured before the refit.  Without its contract a folder is not
    a saved model, so a torn save is never loaded.
    """
    spark = models.series.sparkSession
    rows = [
        (m.name, m.logistic, float(m.base), i, f.tolist(), c.tolist(), v.tolist())
        for m in models.ensembles.values() for i, (f, c, v) in enumerate(zip(m.feature, m.cut, m.value))
    ]
    spark.createDataFrame(rows, TREE_ROWS).coalesce(1).write.mode("overwrite").parquet(f"{root}/trees")
    models.series.coalesce(1).write.mode("overwrite").parquet(f"{root}/series")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{root}/metrics")
    text = json.dumps({**contract_of(models), "metrics": metrics is not None, "facts": facts or {}}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/contract")


class Saved(NamedTuple):
    models: Models
    facts: dict
    metrics: DataFrame | None


def load_saved(spark: SparkSession, root: str) -> Saved:
    """Saved models with their facts and metrics; refused if the contract differs from this code's.

    A horizon may lack its classifier, never its regressor.
    """
    told = json.loads(spark.read.text(f"{root}/contract").first()["value"])
    for name, own in (("inputs", INPUTS), ("horizons", list(HORIZONS)), ("regressors", sorted(f"t{h}" for h in HORIZONS))):
        if told[name] != own:
            odd = [x for x in [*told[name], *own] if x not in told[name] or x not in own]
            raise ContractBroken(f"{name} differ: {odd or 'another order'}")
    by_name: dict[str, list] = {}
    for r in spark.read.schema(TREE_ROWS).parquet(f"{root}/trees").orderBy("name", "tree").collect():  # one row for each tree
        by_name.setdefault(r["name"], []).append(r)
    wanted = {*told["regressors"], *told["classifiers"]}
    if set(by_name) != wanted:
        raise ContractBroken(f"trees of {sorted(wanted ^ set(by_name))} are missing or not in the contract")
    ensembles = {
        n: Ensemble(n, own[0]["logistic"], own[0]["base"], *(np.array([r[c] for r in own]) for c in ("feature", "cut", "value")))
        for n, own in by_name.items()
    }
    metrics = spark.read.parquet(f"{root}/metrics") if told["metrics"] else None
    return Saved(Models(ensembles, spark.read.parquet(f"{root}/series")), told["facts"], metrics)


def load(spark: SparkSession, root: str) -> Models:
    return load_saved(spark, root).models
