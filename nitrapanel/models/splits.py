"""Labels, chronological split, walk-forward folds and recency weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nitrapanel.constants import FEATURE_COLS, HOLDOUT_START, HORIZONS, KEY, MONTH
from nitrapanel.functions.clean import months_after, ratio

FOLDS, GAP = 5, 1


def direction(target: Column, now: Column) -> Column:
    """1 when the target lies above the current price."""
    return (target > now).cast("int")


def by_horizon(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per series, month and horizon with its target and target month."""
    keep = FEATURE_COLS if keep is None else keep
    targets = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"target_urea_t{h}").alias("target"))
            for h in HORIZONS
        ]
    )
    h, target = F.col("t.horizon"), F.col("t.target")
    return features.withColumn("t", F.explode(targets)).select(
        KEY,
        MONTH,
        *keep,
        h.alias("horizon"),
        months_after(F.col(MONTH), h).alias("target_month"),
        target.alias("target"),
        direction(target, F.col("urea")).alias("label"),
    )


def split_role(horizon: Column | int, holdout_start: str = HOLDOUT_START) -> Column:
    """train: target before the holdout; test: month in it; purged: in neither."""
    start = F.lit(holdout_start).cast("date")
    return (
        F.when(months_after(F.col(MONTH), horizon) < start, "train")
        .when(F.col(MONTH) >= start, "test")
        .otherwise("purged")
    )


def chrono_split(rows: DataFrame, holdout_start: str = HOLDOUT_START) -> DataFrame:
    return rows.withColumn("role", split_role(F.col("horizon"), holdout_start))


def recency_weight(rows: DataFrame, keys: list[str], within: Column | None = None, name: str = "weight") -> DataFrame:
    """Weight from 1.0 (oldest month of the key) to 1.5 (newest).

    With ``within`` only those rows span the range; the others have no weight.
    """
    k = Window.partitionBy(*keys)
    counted = F.col(MONTH) if within is None else F.when(within, F.col(MONTH))
    first, last = F.min(counted).over(k), F.max(counted).over(k)
    age = ratio(F.datediff(counted, first).cast("double"), F.datediff(last, first).cast("double"))
    weight = F.when(counted.isNotNull(), F.lit(1.0) + F.lit(0.5) * F.coalesce(age, F.lit(0.0)))
    return rows.withColumn(name, weight)


def walk_forward(rows: DataFrame, keys: list[str], n_splits: int = FOLDS, gap: int = GAP) -> DataFrame:
    """Rows repeated per fold with role train or valid.

    Validation blocks are the last ``n_splits`` blocks of n // (n_splits + 1) months;
    training is everything more than ``gap`` months before the block. Months are those
    of all rows of a key together, so with a key that pools several series no training
    row of one series lies after a validation row of another.
    """
    k = Window.partitionBy(*keys)
    months = rows.select(*keys, MONTH).distinct()
    months = months.select(
        *keys, MONTH, (F.row_number().over(k.orderBy(MONTH)) - 1).alias("pos"), F.count("*").over(k).alias("n")
    )
    numbered = rows.join(months, [*keys, MONTH])
    block = F.floor(F.col("n") / (n_splits + 1))
    start = F.col("n") - (n_splits - F.col("fold")) * block
    role = F.when(F.col("pos") < start - gap, "train").when(
        (F.col("pos") >= start) & (F.col("pos") < start + block), "valid"
    )
    return (
        numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .withColumn("fold_role", role)
        .where(F.col("fold_role").isNotNull())
    )
