"""Fertilizer exposure per state with its map encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.constants import N_LBS_PER_ACRE, STATE_ACREAGE
from nitrapanel.functions.clean import clip, ratio
from nitrapanel.operators.farm import urea_mt

MAX_HEIGHT = 500_000.0
MIN_HEIGHT = 1000.0
CROPS = {"corn_acres": "Corn", "wheat_acres": "Wheat", "soy_acres": "Soybeans"}


def us_states(spark: SparkSession) -> DataFrame:
    """The fixed acreage table, in acres."""
    raw = spark.createDataFrame(STATE_ACREAGE, "state string, lat double, lng double, corn long, wheat long, soy long")
    return raw.select(
        "state", "lat", "lng", *[(F.col(c) * 1000).cast("double").alias(f"{c}_acres") for c in ("corn", "wheat", "soy")]
    )


def state_costs(acreage: DataFrame, price: Column, price_t2: Column) -> DataFrame:
    """Urea need and its cost today and at the 60-day forecast, in million dollars."""
    lbs = sum((F.col(c) * F.lit(float(N_LBS_PER_ACRE[crop])) for c, crop in CROPS.items()), F.lit(0.0))
    safe = F.when(F.coalesce(price, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(price)
    million = F.lit(1e6)
    return (
        acreage.withColumn("urea_mt", urea_mt(lbs))
        .withColumn("current_cost_m", F.col("urea_mt") * safe / million)
        .withColumn("forecast_cost_m", F.col("urea_mt") * F.coalesce(price_t2, safe) / million)
        .withColumn("impact_m", F.col("forecast_cost_m") - F.col("current_cost_m"))
        .withColumn("price_chg_pct", ratio(F.coalesce(price_t2, safe) - safe, safe) * 100)
    )


def share_of_max(df: DataFrame, value: Column, group: list[str] | None = None) -> DataFrame:
    """``value`` as a share of its group's maximum.

    The maximum is aggregated first and joined back, so a large group is not sorted
    or gathered to find it.
    """
    if not group:
        top = df.agg(F.max(value).alias("top")).scalar()
        return df.withColumn("share", ratio(value, top))
    tops = df.groupBy(*group).agg(F.max(value).alias("top"))
    return df.join(tops, group).withColumn("share", ratio(value, F.col("top"))).drop("top")


def map_encoding(df: DataFrame, floor: float = 0.0) -> DataFrame:
    """Column height and colour from ``share`` (0..1)."""
    share = F.col("share")
    return df.select(
        *[c for c in df.columns if c != "share"],
        F.greatest(share * F.lit(MAX_HEIGHT), F.lit(floor)).alias("elevation"),
        (share * 255).cast("int").alias("color_r"),
        clip(F.lit(255.0) - share * 200, 0, 255).cast("int").alias("color_g"),
        F.lit(30).alias("color_b"),
        F.lit(210).alias("color_a"),
    )


def state_exposure(
    acreage: DataFrame, price: Column, price_t2: Column, by: str = "urea_mt", group: list[str] | None = None
) -> DataFrame:
    """Exposure rows with map encoding by need (``urea_mt``) or by ``impact_m``."""
    if by not in ("urea_mt", "impact_m"):
        raise ValueError(f"unknown measure {by!r}; use 'urea_mt' or 'impact_m'")
    costs = state_costs(acreage, price, price_t2)
    value, floor = (F.col(by), 0.0) if by == "urea_mt" else (F.abs(by), MIN_HEIGHT)
    return map_encoding(share_of_max(costs, value, group), floor)


def fmt_acres(acres: Column) -> Column:
    return F.when(acres >= 1e6, F.format_string("%.1fM ac", acres / 1e6)).otherwise(
        F.format_string("%.0fK ac", acres / 1e3)
    )


def ranking_table(exposure: DataFrame) -> DataFrame:
    """Display texts of the ranking; order by ``urea_mt`` descending at the sink."""
    sign = F.when(F.col("price_chg_pct") >= 0, "▲").otherwise("▼")
    return exposure.select(
        "state",
        *[fmt_acres(F.col(c)).alias(c.split("_")[0]) for c in CROPS],
        F.concat(F.format_number(F.col("urea_mt") / 1000, 0), F.lit("K mt")).alias("urea_needed"),
        F.format_string("$%.1fM", "current_cost_m").alias("current_cost"),
        F.format_string("$%.1fM", "forecast_cost_m").alias("forecast_cost"),
        F.format_string("%s$%.1fM", sign, F.abs("impact_m")).alias("impact"),
        "urea_mt",
    )
