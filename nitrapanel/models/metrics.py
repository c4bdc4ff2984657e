"""Holdout metrics and residual statistics, one grouped aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, SHOCK_TARGET_START
from nitrapanel.functions.stats import direction_accuracy, hit_rate, mae, rmse



def window_labels(shock_start: str = SHOCK_TARGET_START) -> Column:
    """Every test row counts in ``full`` and, by TARGET month, in one other window."""
    own = F.when(F.col("target_month") >= F.lit(shock_start).cast("date"), "shock").otherwise("preshock")
    return F.array(F.lit("full"), own)


def evaluate(
    predictions: DataFrame, shock_start: str = SHOCK_TARGET_START, keys: list[str] | None = None
) -> DataFrame:
    """Metrics per key, horizon and window over rows target/pred/urea/label/label_pred.

    A window without rows gives no row.
    """
    keys = [KEY] if keys is None else keys
    y, p = F.col("target"), F.col("pred")
    return (
        predictions.withColumn("bucket", F.explode(window_labels(shock_start)))
        .groupBy(*keys, "horizon", "bucket")
        .agg(
            F.count("*").alias("n"),
            rmse(y, p).alias("rmse"),
            mae(y, p).alias("mae"),
            direction_accuracy(y, p, F.col("urea")).alias("dir_acc"),
            hit_rate(F.col("label"), F.col("label_pred")).alias("clf_acc"),
            F.avg(y - p).alias("residual_mean"),
            F.stddev_pop(y - p).alias("residual_std"),
        )
    )


def residual_stats(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Residual mean and spread that feed the simulation: pre-shock holdout only."""
    keys = [KEY] if keys is None else keys
    return metrics.where(F.col("bucket") == "preshock").select(
        *keys, "horizon", "n", "residual_mean", "residual_std"
    )


def cv_residuals(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and population spread of all validation residuals over the folds."""
    keys = [KEY] if keys is None else keys
    r = F.col("target") - F.col("pred")
    return predictions.groupBy(*keys, "horizon").agg(
        F.avg(r).alias("cv_residual_mean"), F.stddev_pop(r).alias("cv_residual_std"), F.count("*").alias("n")
    )


def seed_spread(per_seed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Spread of each metric over seeds, from rows seed/horizon/rmse/dir_acc/clf_acc."""
    keys = [KEY] if keys is None else keys
    aggs = []
    for m in ("rmse", "dir_acc", "clf_acc"):
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    return per_seed.groupBy(*keys, "horizon").agg(F.count("*").alias("n_seeds"), *aggs)
