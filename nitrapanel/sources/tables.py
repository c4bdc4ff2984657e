"""Commodity feeds bound to the order tables (orders, lineitem, customer, ...).

The order priority is the series key. Prices are scaled to the usual ranges of the
commodities, so that the fixed clip ranges and thresholds are meaningful.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, MONTH
from nitrapanel.functions.clean import month_start, ratio
from nitrapanel.session import materialize

# Scale of each feed. No round numbers: scaled prices then have no short decimal
# expansion and never sit on a rounding boundary.
SPOT_SCALE = 80_021.0
BACKBONE_SCALE = 16_001.0
UREA_SCALE = 120.011
DAP_SCALE = 90.017
STORAGE_MMCF_PER_UNIT = 250.0

# Evaluation boundaries inside the order history.
HOLDOUT_START = "2000-01-01"
SHOCK_START = "2001-05-01"
HISTORY_START = "1998-01-01"

SEGMENT_CROP = {
    "MACHINERY": "Corn",
    "BUILDING": "Wheat",
    "AUTOMOBILE": "Cotton",
    "FURNITURE": "Soybeans",
    "HOUSEHOLD": "Barley",
}
REGION_SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Digits of the largest bigint event id.
ID_DIGITS = 19
CROP_BY_CODE = ["Corn", "Wheat", "Cotton", "Sorghum", "Soybeans", "Rice"]


class Feeds(NamedTuple):
    """Feeds at native grain, as the staging operators expect them."""

    daily: DataFrame  # series, period, value
    backbone: DataFrame  # series, period (month), value
    weekly_bcf: DataFrame  # series, period (week start), value
    storage_backbone: DataFrame  # series, period (month), value
    sheet: DataFrame  # series, period, urea, dap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str) -> Column:
    return F.col(c).cast("date")


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily live price: mean scaled order value per series and date."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias(KEY), day("o_orderdate").alias("period")).agg(
        (F.avg("o_totalprice") / SPOT_SCALE).alias("value")
    )


def shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the series of their order."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_linestatus", day("l_shipdate").alias("period")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias(KEY))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        KEY, "period", "l_quantity", "l_extendedprice", "l_linestatus"
    )


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the monthly and weekly feeds need, summed per series and ship date."""
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    f, o = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    return shipped_lines(spark, sf_dir).groupBy(KEY, "period").agg(
        F.sum(qty).alias("qty"),
        F.sum(price).alias("price_sum"),
        F.count(price).alias("price_n"),
        F.sum(F.when(f, price)).alias("f_sum"),
        F.count(F.when(f, price)).alias("f_n"),
        F.sum(F.when(o, price)).alias("o_sum"),
        F.count(F.when(o, price)).alias("o_n"),
    )


def backbone_of(days: DataFrame) -> DataFrame:
    """Monthly price backbone: mean line price per ship month."""
    return days.groupBy(KEY, month_start(F.col("period")).alias("period")).agg(
        (F.sum("price_sum") / F.sum("price_n") / BACKBONE_SCALE).alias("value")
    )


def weekly_of(days: DataFrame) -> DataFrame:
    """Weekly storage level in BCF: quantity shipped per week."""
    return days.groupBy(KEY, F.date_trunc("week", "period").cast("date").alias("period")).agg(
        F.sum("qty").alias("value")
    )


def storage_backbone_of(days: DataFrame) -> DataFrame:
    """Monthly storage backbone in MMcf."""
    return days.groupBy(KEY, month_start(F.col("period")).alias("period")).agg(
        (F.sum("qty") * STORAGE_MMCF_PER_UNIT).alias("value")
    )


def sheet_of(days: DataFrame) -> DataFrame:
    """Price sheet per date: urea from filled lines, DAP from open lines."""
    return days.select(
        KEY,
        "period",
        (ratio(F.col("f_sum"), F.col("f_n")) / UREA_SCALE).alias("urea"),
        (ratio(F.col("o_sum"), F.col("o_n")) / DAP_SCALE).alias("dap"),
    )


def quoted_sheet_of(days: DataFrame) -> DataFrame:
    """Monthly sheet with gaps: a price is quoted only in months whose own lines are
    at least as many as the other side's."""
    monthly = days.groupBy(KEY, month_start(F.col("period")).alias(MONTH)).agg(
        *[F.sum(c).alias(c) for c in ("f_sum", "f_n", "o_sum", "o_n")]
    )
    f_n, o_n = F.col("f_n"), F.col("o_n")
    return monthly.select(
        KEY,
        MONTH,
        F.when(f_n >= o_n, F.col("f_sum") / F.nullif(f_n, F.lit(0)) / UREA_SCALE).alias("urea"),
        F.when(o_n >= f_n, F.col("o_sum") / F.nullif(o_n, F.lit(0)) / DAP_SCALE).alias("dap"),
    )


def feeds_of(daily: DataFrame, days: DataFrame) -> Feeds:
    return Feeds(daily, backbone_of(days), weekly_of(days), storage_backbone_of(days), sheet_of(days))


def landed_feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    """Feeds over two landed day-grain tables: each raw table is read once."""
    daily = materialize(order_days(spark, sf_dir), "order_days")
    days = materialize(ship_days(spark, sf_dir), "ship_days")
    return feeds_of(daily, days)


def lazy_feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    """The same feeds without landing, for queries that need a single one."""
    return feeds_of(order_days(spark, sf_dir), ship_days(spark, sf_dir))


# Farms, states, change log ---------------------------------------------------


def _lookup(pairs: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)


def farms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One farm per customer, priced by the series of its region."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    series = F.element_at(F.array(*[F.lit(s) for s in REGION_SERIES]), F.col("n_regionkey") + 1)
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("farm_id"),
        series.alias(KEY),
        _lookup(SEGMENT_CROP, F.col("c_mktsegment")).alias("crop_name"),
        F.abs("c_acctbal").alias("acres"),
        (F.col("c_nationkey") * 4).cast("double").alias("pre_pct"),
    )


def nation_acreage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acreage per nation and crop from the customers of three segments."""
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    acres = F.abs("c_acctbal") * 1000

    def of(segment: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("c_mktsegment") == segment, acres)), F.lit(0.0))

    sums = customer.groupBy("c_nationkey").agg(
        of("MACHINERY").alias("corn_acres"), of("BUILDING").alias("wheat_acres"), of("FURNITURE").alias("soy_acres")
    )
    return sums.join(nation, sums.c_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("state"),
        F.element_at(F.array(*[F.lit(s) for s in REGION_SERIES]), F.col("n_regionkey") + 1).alias(KEY),
        "corn_acres",
        "wheat_acres",
        "soy_acres",
    )


def crop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop change log from events; signups carry no change."""
    code = F.get_json_object("props", "$.k").cast("int")
    crop = F.element_at(F.array(*[F.lit(c) for c in CROP_BY_CODE]), code % len(CROP_BY_CODE) + 1)
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .where(kind != "signup")
        .select(
            "user_id",
            # Clicks spell crops in lower case.
            F.when(kind == "click", F.lower(crop)).otherwise(crop).alias("crop_name"),
            F.when(F.floor(code / 6) % 2 == 0, "Spring").otherwise("Fall").alias("season"),
            F.year("ts").alias("year"),
            # Order by time, then by id, as one number.
            (
                F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts").cast("decimal(38,0)")
                * F.lit(Decimal(10) ** ID_DIGITS)
                + F.col("event_id")
            ).cast("decimal(38,0)").alias("seq"),
            F.when(kind == "purchase", "set").when(kind == "error", "delete").otherwise("add").alias("action"),
            F.col("value").alias("acres"),
        )
    )
