"""Borrower attributes, drawn or taken from accounts, and their stress score.

Drawn attributes follow from the row number alone, so any split of the rows over tasks
gives the same borrowers.  ``from_accounts`` takes them from customers, orders and events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import SEED
from nitrapanel.functions.clean import clip
from nitrapanel.functions.draws import beta_5_2, normal, pick, uniform

# Categories, their weights and the crops' fertilizer multipliers.
CROPS = {
    "Cotton": 0.14,
    "Barley": 0.14,
    "Tomato": 0.12,
    "Sugarcane": 0.1,
    "Soybean": 0.1,
    "Rice": 0.1,
    "Carrot": 0.08,
    "Wheat": 0.08,
    "Potato": 0.08,
    "Maize": 0.06,
}
IRRIGATION = {"Drip": 0.30, "Flood": 0.26, "Sprinkler": 0.18, "Rain-fed": 0.14, "Manual": 0.12}
SOIL = {"Clay": 0.28, "Loamy": 0.22, "Sandy": 0.22, "Silty": 0.20, "Peaty": 0.08}
SEASON = {"Zaid": 0.46, "Kharif": 0.32, "Rabi": 0.22}
MULTIPLIER = {
    "Maize": 1.8,
    "Sugarcane": 1.6,
    "Cotton": 1.4,
    "Tomato": 1.2,
    "Potato": 1.2,
    "Wheat": 1.0,
    "Barley": 0.9,
    "Rice": 0.8,
    "Carrot": 0.6,
    "Soybean": 0.3,
}
NEVER_DELINQUENT = 0.7
STRESS_LIMIT = 0.65
NOISE_STD = 0.1


def fert_multiplier(crop: Column) -> Column:
    table = F.create_map(*[x for k, v in MULTIPLIER.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, crop)


def borrowers(ids: DataFrame, row: str = "id", seed: int = SEED) -> DataFrame:
    """One borrower per row of ``ids``; each attribute has its own stream."""
    n = F.col(row).cast("bigint")

    def u(stream: int) -> Column:
        return uniform(n, seed + stream)

    made = ids.select(
        row,
        F.concat(F.lit("FARM-"), (n + 1000).cast("string")).alias("borrower_id"),
        pick(u(1), list(CROPS), list(CROPS.values())).alias("crop_type"),
        F.round(50 + u(2) * 1450, 2).alias("farm_area_acres"),
        pick(u(3), list(IRRIGATION), list(IRRIGATION.values())).alias("irrigation_type"),
        pick(u(4), list(SOIL), list(SOIL.values())).alias("soil_type"),
        pick(u(5), list(SEASON), list(SEASON.values())).alias("season"),
        F.round(beta_5_2(n, seed + 7) * 0.95, 2).alias("current_ltv_ratio"),
        F.when(u(8) < NEVER_DELINQUENT, F.lit(-1))
        .otherwise(F.least(F.floor(u(9) * 47), F.lit(46).cast("bigint")).cast("int") + 1)
        .alias("months_since_delinquency"),
        (u(6) * 0.10 + 0.05).alias("rate"),
    )
    tons = F.round(F.col("farm_area_acres") * fert_multiplier(F.col("crop_type")) * F.col("rate"), 2)
    return made.withColumn("fertilizer_used_tons", tons).drop("rate")


# What a customer of each segment grows.
SEGMENT_CROPS = {"AUTOMOBILE": "Maize", "BUILDING": "Cotton", "FURNITURE": "Rice", "HOUSEHOLD": "Wheat", "MACHINERY": "Soybean"}
LEAST_BALANCE, MOST_BALANCE = -1_000.0, 10_000.0
USUAL_ERRORS = 0.2  # share of a customer's events


def from_accounts(customers: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    """One borrower per customer row, with ``id`` and ``drift`` beside the score's inputs.

    The crop follows from the segment, the loan-to-value ratio from the balance, months
    since the last order stand for those since a delinquency (-1 without orders), and the
    share of errors among the customer's events shifts the score.  Orders and events are
    reduced to one row a customer before they meet the customers.
    """
    newest = orders.agg(F.max("o_orderdate")).first()[0]
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    errors = events.groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("errors"))
    crop = F.create_map(*[F.lit(x) for pair in SEGMENT_CROPS.items() for x in pair])
    balance = (F.lit(MOST_BALANCE) - F.col("c_acctbal")) / F.lit(MOST_BALANCE - LEAST_BALANCE)
    months = F.floor(F.datediff(F.lit(newest), F.col("last_order")) / 30).cast("int")
    joined = customers.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    joined = joined.join(errors, F.col("c_custkey") == F.col("user_id"), "left")
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.try_element_at(crop, F.col("c_mktsegment")).alias("crop_type"),
        clip(balance, 0, 1).alias("current_ltv_ratio"),
        F.coalesce(months, F.lit(-1)).alias("months_since_delinquency"),
        (F.coalesce("errors", F.lit(USUAL_ERRORS)) - F.lit(USUAL_ERRORS)).alias("drift"),
    )


def stress_noise(row: Column, seed: int = SEED) -> Column:
    return normal(row, seed + 10) * F.lit(NOISE_STD)


def stress_score(df: DataFrame, noise: Column) -> DataFrame:
    """Stress probability and intervention flag from borrower attributes."""
    months = F.col("months_since_delinquency")
    recent = F.when(months != -1, F.lit(12.0) / (months + 1)).otherwise(0.0)
    base = (
        F.col("current_ltv_ratio") * 0.4
        + fert_multiplier(F.col("crop_type")) / 2.0 * 0.4
        + recent * 0.2
    )
    return df.withColumn("stress_probability", clip(base + noise, 0, 1)).withColumn(
        "requires_intervention", (F.col("stress_probability") > STRESS_LIMIT).cast("int")
    )
