"""Buy/wait signal from forecast, bands and the gas move: one row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import KEY
from nitrapanel.functions.clean import ratio

# Texts and labels of the signal.
HORIZON_LABELS = {1: "Next month", 2: "In 2 months", 3: "In 3 months"}
TEXT_BUY = (
    "Urea prices are forecast to rise %.0f%% over the next 60 days "
    "with %.0f%% probability. Consider purchasing inputs soon."
)
TEXT_CONSIDER = (
    "Prices lean upward (%+.0f%% forecast at 60 days) "
    "but uncertainty is moderate. Partial pre-purchase may make sense."
)
TEXT_WAIT = "Prices are forecast to soften (%.0f%% over 60 days). Waiting may reduce your input costs."
TEXT_NEUTRAL = (
    "No strong price signal. Urea prices expected to remain stable. "
    "Monitor weekly and act if nat gas moves more than 10% in either direction."
)
TEXT_DRIVER = "Nat gas %s %.0f%% in 30 days"
TEXT_SUMMARY = "Urea forecast: $%.0f/mt in 60 days (%+.0f%%) — 80%% range: $%.0f–$%.0f"


def pct_change_t2(t2: Column, current: Column) -> Column:
    return ratio(t2 - current, current)


def rule(pct: Column, prob: Column) -> Column:
    """Ordered rules; every bound is strict."""
    # The thresholds of the rule.
    return (
        F.when((pct > 0.08) & (prob > 0.65), "BUY_NOW")
        .when((pct > 0.04) | (prob > 0.55), "CONSIDER_BUYING")
        .when((pct < -0.04) & (prob < 0.40), "WAIT")
        .otherwise("NEUTRAL")
    )


def urgency(signal: Column) -> Column:
    return F.when(signal == "BUY_NOW", "HIGH").when(signal == "CONSIDER_BUYING", "MODERATE").otherwise("LOW")


def rationale(signal: Column, pct: Column, prob: Column) -> Column:
    rise, chance = pct * 100, prob * 100
    return (
        F.when(signal == "BUY_NOW", F.format_string(TEXT_BUY, rise, chance))
        .when(signal == "CONSIDER_BUYING", F.format_string(TEXT_CONSIDER, rise))
        .when(signal == "WAIT", F.format_string(TEXT_WAIT, rise))
        .otherwise(F.lit(TEXT_NEUTRAL))
    )


def best_horizon(p50: dict[int, Column]) -> Column:
    """Horizon with the lowest median; the earliest one on a tie."""
    return F.array_min(F.array(*[F.struct(c.alias("price"), F.lit(h).alias("horizon")) for h, c in p50.items()]))


def generate_signal(mc: DataFrame) -> DataFrame:
    """``mc`` holds current, t2, ng_spot, ng_mom_1m and the bands of one series per row."""
    prob, move = F.col("prob_rising_t2"), F.coalesce(F.col("ng_mom_1m"), F.lit(0.0))
    pct = F.col("pct_change_t2")
    best = best_horizon({h: F.col(f"p50_t{h}") for h in (1, 2, 3)})
    label = F.lit(None).cast("string")
    for h, text in HORIZON_LABELS.items():
        label = F.when(F.col("best.horizon") == h, text).otherwise(label)
    way = F.when(move >= 0, "up").otherwise("down")
    judged = (
        mc.withColumn("pct_change_t2", pct_change_t2(F.col("t2"), F.col("current")))
        .withColumn("best", best)
        .withColumn("signal", rule(pct, prob))
    )
    signal = F.col("signal")
    return judged.select(
        KEY,
        "signal",
        urgency(signal).alias("urgency"),
        F.initcap(F.replace(F.lower(signal), F.lit("_"), F.lit(" "))).alias("recommendation"),
        rationale(signal, pct, prob).alias("rationale"),
        F.format_string(TEXT_DRIVER, way, F.abs(move) * 100).alias("key_driver"),
        F.format_string(TEXT_SUMMARY, F.col("p50_t2"), pct * 100, F.col("p10_t2"), F.col("p90_t2")).alias(
            "forecast_summary"
        ),
        F.round(F.when(signal == "WAIT", 1 - prob).otherwise(prob), 2).alias("confidence"),
        F.round("current", 1).alias("current_price"),
        label.alias("best_month"),
        F.round("best.price", 0).alias("best_price"),
        *[F.round(f"p50_t{h}", 1).alias(f"forecast_t{h}") for h in (1, 2, 3)],
        F.round("p10_t2", 1).alias("p10_t2"),
        F.round("p90_t2", 1).alias("p90_t2"),
        F.round(prob, 2).alias("prob_rising"),
        F.round(F.coalesce("ng_spot", F.lit(0.0)), 2).alias("ng_current"),
        F.round(move, 4).alias("ng_change_30d"),
    )
