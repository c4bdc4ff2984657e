"""Baseline predictors in plain aggregates; they keep every step around a model exactly checkable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nitrapanel.constants import HOLDOUT_START, KEY, MONTH
from nitrapanel.functions.clean import ratio
from nitrapanel.models.splits import by_horizon, chrono_split, direction, recency_weight
from nitrapanel.operators.features import complete_rows, latest_complete

LINE_KEYS = [KEY, "horizon"]


def labelled(features: DataFrame, holdout_start: str = HOLDOUT_START) -> DataFrame:
    """Trainable rows per horizon with their split role."""
    return chrono_split(by_horizon(complete_rows(features, True)), holdout_start)


def weighted_line(rows: DataFrame, x: str = "urea", y: str = "target") -> DataFrame:
    """Weighted least-squares line of y on x per series and horizon.

    Sums are taken around the weighted means, which keeps them well conditioned. The
    means come from a window on the same keys, so the rows are shuffled once.
    """
    w, k = F.col("weight"), Window.partitionBy(*LINE_KEYS)
    total = F.sum(w).over(k)
    centred = rows.select(
        *LINE_KEYS,
        "weight",
        x,
        y,
        ratio(F.sum(w * F.col(x)).over(k), total).alias("x_mean"),
        ratio(F.sum(w * F.col(y)).over(k), total).alias("y_mean"),
    )
    dx, dy = F.col(x) - F.col("x_mean"), F.col(y) - F.col("y_mean")
    sums = centred.groupBy(*LINE_KEYS).agg(
        F.max("x_mean").alias("x_mean"),
        F.max("y_mean").alias("y_mean"),
        F.sum(w * dx * dy).alias("sxy"),
        F.sum(w * dx * dx).alias("sxx"),
    )
    slope = F.coalesce(ratio(F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return sums.select(*LINE_KEYS, "x_mean", "y_mean", slope.alias("slope"))


def apply_line(rows: DataFrame, line: DataFrame, x: str = "urea") -> DataFrame:
    """Every row with ``pred``; a series without a line keeps its last value."""
    pred = F.coalesce(F.col("y_mean") + F.col("slope") * (F.col(x) - F.col("x_mean")), F.col(x))
    scored = rows.join(line, LINE_KEYS, "left").withColumn("pred", pred).drop("x_mean", "y_mean", "slope")
    return scored.withColumn("label_pred", direction(F.col("pred"), F.col("urea")))


def last_value(rows: DataFrame) -> DataFrame:
    """The current price as the forecast of every horizon."""
    return rows.withColumn("pred", F.col("urea")).withColumn("label_pred", F.lit(0))


def holdout_predictions(rows: DataFrame) -> DataFrame:
    """Line fitted on the training rows, scored on the holdout rows."""
    train = recency_weight(rows.where(F.col("role") == "train"), LINE_KEYS)
    return apply_line(rows.where(F.col("role") == "test"), weighted_line(train))


def latest_forecast(features: DataFrame) -> DataFrame:
    """Forecast per series and horizon from the as-of row, line refit on all rows."""
    fit = recency_weight(by_horizon(complete_rows(features, True), ["urea"]), LINE_KEYS)
    now = by_horizon(latest_complete(features), ["urea", "ng_spot", "ng_mom_1m"])
    return apply_line(now, weighted_line(fit)).select(
        KEY, MONTH, "horizon", "target_month", F.col("urea").alias("current"), "ng_spot", "ng_mom_1m", "pred"
    )
