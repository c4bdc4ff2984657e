"""The older one-pass ingestion, kept because it treats gaps differently.

It carries prices forward, keeps only backbone months plus later live months, and
ends where the shortest measure ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, MONTH
from nitrapanel.functions.clean import month_start
from nitrapanel.functions.windows import by_series, fill_forward, fill_forward_limit
from nitrapanel.operators.spine import reindex_months
from nitrapanel.operators.staging import build_panel, monthly_last, monthly_mean, period_mean

SHEET_FILL_LIMIT = 2


def filled_backbone(backbone: DataFrame) -> DataFrame:
    """Monthly backbone with every missing price carried forward."""
    w = by_series("period")
    return backbone.select(
        KEY,
        month_start(F.col("period")).alias(MONTH),
        fill_forward(F.col("value"), w).alias("value"),
    )


def storage_months(backbone: DataFrame) -> DataFrame:
    """Storage backbone as one gap-free run of months, empty months included."""
    value, period = F.col("value"), F.col("period")
    monthly = backbone.groupBy(KEY, month_start(period).alias(MONTH)).agg(
        F.max_by(value, F.when(value.isNotNull(), period)).alias("value")
    )
    return reindex_months(monthly, end_rule="rows")


def filled_sheet(sheet: DataFrame, cols: list[str]) -> DataFrame:
    """Price sheet with at most two consecutive missing months carried forward."""
    w = by_series(MONTH)
    return sheet.select(
        KEY, MONTH, *[fill_forward_limit(F.col(c), w, SHEET_FILL_LIMIT).alias(c) for c in cols]
    )


def overlay_live(backbone: DataFrame, live: DataFrame) -> DataFrame:
    """Live values overwrite backbone months and extend past its end.

    Live months before the backbone starts, or in a hole of it, are dropped.
    """
    last = backbone.groupBy(KEY).agg(F.max(MONTH).alias("last_month"))
    merged = (
        backbone.alias("b")
        .join(live.alias("l"), [KEY, MONTH], "left")
        .select(KEY, MONTH, F.coalesce("l.value", "b.value").alias("value"))
    )
    beyond = live.join(last, KEY).where(F.col(MONTH) > F.col("last_month")).select(KEY, MONTH, "value")
    return merged.unionByName(beyond)


def ingest_legacy(
    daily: DataFrame,
    backbone: DataFrame,
    weekly_bcf: DataFrame,
    storage_backbone: DataFrame,
    sheet_monthly: DataFrame,
    start: str | None = "2018-01-01",
    end: str | None = None,
    shared: bool = False,
) -> DataFrame:
    """Panel of the older path; ``sheet_monthly`` has series, month, urea, dap."""
    ng = overlay_live(filled_backbone(backbone), monthly_mean(daily))
    weekly = period_mean(weekly_bcf).withColumn("value", F.col("value") * F.lit(1000.0))
    storage = overlay_live(storage_months(storage_backbone), monthly_last(weekly))
    sheet = filled_sheet(sheet_monthly, ["urea", "dap"])
    panel = build_panel(
        ng,
        sheet.select(KEY, MONTH, F.col("urea").alias("value")),
        sheet.select(KEY, MONTH, F.col("dap").alias("value")),
        storage,
    )
    return reindex_months(panel, start=start, end=end, end_rule="shortest", shared=shared)
