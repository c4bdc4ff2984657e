"""Native-grain feeds to one monthly series per key, then to the panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, MEASURES, MONTH
from nitrapanel.functions.clean import month_start

LIVE, BACKBONE = 1, 2


def observed(feed: DataFrame, *cols: str) -> DataFrame:
    """Rows where every named column holds a value."""
    return feed.dropna(how="any", subset=list(cols))


def monthly_mean(feed: DataFrame, value: str = "value", period: str = "period") -> DataFrame:
    """Mean per series and month; partial averages are merged before the shuffle."""
    return (
        observed(feed, period, value)
        .groupBy(KEY, month_start(F.col(period)).alias(MONTH))
        .agg(F.avg(value).alias("value"))
    )


def period_mean(feed: DataFrame, value: str = "value", period: str = "period") -> DataFrame:
    """One row per series and period: duplicates are averaged."""
    return observed(feed, period, value).groupBy(KEY, period).agg(F.avg(value).alias(value))


def monthly_last(feed: DataFrame, value: str = "value", period: str = "period") -> DataFrame:
    """Last observation of each month; of several on one date the highest.

    Two hash aggregations: a single one would have to order by (date, value), which
    sorts the whole feed first.
    """
    per_period = (
        observed(feed, period, value)
        .groupBy(KEY, F.col(period).alias("period"))
        .agg(F.max(value).alias("value"))
    )
    return per_period.groupBy(KEY, month_start(F.col("period")).alias(MONTH)).agg(
        F.max_by("value", "period").alias("value")
    )


def tagged(monthly: DataFrame, priority: int) -> DataFrame:
    return monthly.select(KEY, MONTH, "value", F.lit(priority).alias("source_priority"))


def first_by_priority(candidates: DataFrame) -> DataFrame:
    """The value with the lowest priority number per series and month."""
    return candidates.groupBy(KEY, MONTH).agg(
        F.min_by("value", F.struct("source_priority", "value")).alias("value")
    )


def stage_priority(live: DataFrame, backbone: DataFrame) -> DataFrame:
    """Live months win, the backbone fills every month live does not have."""
    return first_by_priority(tagged(live, LIVE).unionByName(tagged(backbone, BACKBONE)))


def stage_spot(daily: DataFrame, backbone: DataFrame) -> DataFrame:
    """Daily live price averaged per month over a monthly backbone."""
    local = observed(backbone, "period", "value").select(
        KEY, month_start(F.col("period")).alias(MONTH), "value"
    )
    return stage_priority(monthly_mean(daily), local)


def stage_storage(weekly_bcf: DataFrame, backbone_mmcf: DataFrame) -> DataFrame:
    """Last weekly level of the month, BCF to MMcf, over a monthly backbone."""
    live = monthly_last(weekly_bcf).withColumn("value", F.col("value") * F.lit(1000.0))
    local = observed(backbone_mmcf, "period", "value").select(
        KEY, month_start(F.col("period")).alias(MONTH), "value"
    )
    return stage_priority(live, local)


def stage_single(sheet: DataFrame, value: str) -> DataFrame:
    """One priced column of a sheet as a monthly series."""
    return monthly_mean(sheet, value=value)


def build_panel(ng_spot: DataFrame, urea: DataFrame, dap: DataFrame, storage_mmcf: DataFrame) -> DataFrame:
    """One row per series and month with a column per measure.

    Union and pivot in a single aggregation: same rows as joining the four inputs
    to the distinct set of their months, with one shuffle instead of five.
    """
    staged = dict(zip(MEASURES, (ng_spot, urea, dap, storage_mmcf)))
    long = reduce(
        DataFrame.unionByName,
        [df.select(KEY, MONTH, F.lit(name).alias("measure"), "value") for name, df in staged.items()],
    )
    return long.groupBy(KEY, MONTH).agg(*[_only(name) for name in MEASURES])


def _only(name: str) -> Column:
    return F.max(F.when(F.col("measure") == name, F.col("value"))).alias(name)


def month_set(*staged: DataFrame) -> DataFrame:
    """Distinct (series, month) over all inputs."""
    return reduce(DataFrame.unionByName, [df.select(KEY, MONTH) for df in staged]).distinct()
