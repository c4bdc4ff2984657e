"""Farm crop state, fertilizer cost, exposure, hedge split and timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nitrapanel.constants import (
    DEFAULT_N_LBS,
    HEDGE_CEILING,
    HEDGE_FLOOR,
    HEDGE_STEPS,
    DRAWS,
    KEY,
    LBS_PER_MT,
    N_LBS_PER_ACRE,
    RISK_ALPHA,
    SEED,
    UREA_N_SHARE,
)
from nitrapanel.functions.clean import ratio
from nitrapanel.functions.stats import chance_above
from nitrapanel.operators.simulate import bands

CROP_KEY = ["user_id", "crop_key", "season", "year"]
BLOCK, SPAN = 1_024, 4_096  # sequence numbers of a block of changes, blocks of a span
GAS_ALERT = 0.05
BADGE_BREAK = 70


def n_intensity(crop: Column, default: float | None = DEFAULT_N_LBS) -> Column:
    """Pounds of nitrogen per acre; the crop name is matched as written."""
    table = F.create_map(*[x for k, v in N_LBS_PER_ACRE.items() for x in (F.lit(k), F.lit(float(v)))])
    found = F.try_element_at(table, crop)
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def cost_per_lb_n(price_per_mt: Column) -> Column:
    return price_per_mt / F.lit(LBS_PER_MT) / F.lit(UREA_N_SHARE)


def urea_mt(n_lbs: Column) -> Column:
    return n_lbs / F.lit(UREA_N_SHARE * LBS_PER_MT)


# Crop state ------------------------------------------------------------------


# What a run of changes does to a crop row: whether it deletes it, and what it holds after the
# last delete.  ``live`` says that the last set meets a row that the run itself has created.
EFFECT = (
    "struct<reset:boolean,crop_name:string,created:{seq},added:double,"
    "is_set:boolean,live:boolean,set_acres:double,added_after:double>"
)


def _effect(like: Column, kind: str) -> Column:
    return like.cast(EFFECT.format(seq=kind))


def _plus(total: Column, acres: Column) -> Column:
    """Sum that ignores what is missing."""
    return F.when(acres.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + acres)


def _made(*values: Column, kind: str) -> Column:
    names = ("reset", "crop_name", "created", "added", "is_set", "live", "set_acres", "added_after")
    return _effect(F.struct(*[v.alias(n) for n, v in zip(names, values)]), kind)


def _change(before: Column, e: Column, kind: str) -> Column:
    """Effect of a run followed by one change."""
    none, no = F.lit(None), F.lit(False)
    gone = _made(F.lit(True), none, none, none, no, no, none, none, kind=kind)
    more = _made(
        before["reset"], F.coalesce(before["crop_name"], e["crop_name"]), F.coalesce(before["created"], e["seq"]),
        _plus(before["added"], e["acres"]), before["is_set"], before["live"], before["set_acres"],
        F.when(before["is_set"], _plus(before["added_after"], e["acres"])), kind=kind,
    )
    put = _made(
        before["reset"], before["crop_name"], before["created"], before["added"], F.lit(True), before["created"].isNotNull(),
        e["acres"], none, kind=kind,
    )
    action = e["action"]
    return F.when(action == "delete", gone).when(action == "add", more).when(action == "set", put).otherwise(before)


def _then(a: Column, b: Column, kind: str) -> Column:
    """Effect of run ``a`` followed by run ``b``; this is associative."""
    kept = F.when(b["is_set"], b["added_after"]).otherwise(F.when(a["is_set"], _plus(a["added_after"], b["added"])))
    joined = _made(
        a["reset"], F.coalesce(a["crop_name"], b["crop_name"]), F.coalesce(a["created"], b["created"]), _plus(a["added"], b["added"]),
        a["is_set"] | b["is_set"], F.when(b["is_set"], b["live"] | a["created"].isNotNull()).otherwise(a["live"]),
        F.when(b["is_set"], b["set_acres"]).otherwise(a["set_acres"]), kept, kind=kind,
    )
    return F.when(b["reset"], b).otherwise(joined)


def crop_state(log: DataFrame) -> DataFrame:
    """Fold a change log (user_id, crop_name, season, year, seq, action, acres).

    ``add`` creates a row or adds acres to it (crop names match without case and the
    first spelling stays), ``set`` replaces the acres of an existing row, ``delete``
    removes it. ``seq`` is a number; the result carries the one that created the row.

    The log is read and moved once: the changes of a row are cut into blocks of ``BLOCK``
    sequence numbers, each block is reduced to its effect, and effects, which may be joined
    in any grouping that keeps their order, meet by spans of blocks and then by row. So a
    row with a large share of the log is spread over its blocks, and no task holds more
    changes of it than a block has numbers.
    """
    kind = log.schema["seq"].dataType.simpleString()
    keyed = log.withColumn("crop_key", F.lower("crop_name")).withColumn("block", F.floor(F.col("seq") / BLOCK))
    nothing = _made(F.lit(False), *[F.lit(None)] * 3, F.lit(False), F.lit(False), *[F.lit(None)] * 2, kind=kind)
    event = F.struct("seq", "action", F.col("acres").cast("double").alias("acres"), "crop_name")
    fold = F.aggregate(F.sort_array(F.collect_list(event)), nothing, lambda s, e: _change(s, e, kind))
    effects = keyed.groupBy(*CROP_KEY, "block").agg(fold.alias("effect"))
    for span in (SPAN, None):
        joined = F.aggregate(F.sort_array(F.collect_list(F.struct("block", "effect"))), nothing, lambda s, e: _then(s, e["effect"], kind))
        if span:
            effects = effects.groupBy(*CROP_KEY, F.floor(F.col("block") / span).alias("span")).agg(joined.alias("effect"))
            effects = effects.withColumnRenamed("span", "block")
        else:
            effects = effects.groupBy(*CROP_KEY).agg(joined.alias("effect"))
    e = F.col("effect")
    # A set before the row exists touches nothing.
    acres = F.when(e["is_set"] & e["live"], e["set_acres"] + F.coalesce(e["added_after"], F.lit(0.0))).otherwise(e["added"])
    out = effects.where(e["created"].isNotNull())
    return out.select("user_id", e["crop_name"].alias("crop_name"), "season", "year", acres.alias("acres"), e["created"].alias("created"))


def select_crops(crops: DataFrame, seasons: list[str], year: int) -> DataFrame:
    """Crops of the chosen seasons and year; no season chosen selects nothing."""
    chosen = F.col("season").isin(*seasons) if seasons else F.lit(False)
    return crops.where(chosen & (F.col("year") == year))


def crop_labels(crops: DataFrame) -> DataFrame:
    """Crop name, with its season where a user grows the crop more than once."""
    seen = F.count("*").over(Window.partitionBy("user_id", "crop_name"))
    label = F.when(seen > 1, F.concat("crop_name", F.lit(" ("), "season", F.lit(")"))).otherwise(F.col("crop_name"))
    return crops.withColumn("display_label", label)


# Cost summary ----------------------------------------------------------------


def fertilizer_totals(crops: DataFrame, price: Column) -> DataFrame:
    """Nitrogen, cost, acres and crop count per user."""
    lbs = n_intensity(F.col("crop_name")) * F.col("acres")
    totals = crops.groupBy("user_id").agg(
        F.sum(lbs).alias("fertilizer_used_lbs"),
        F.sum(lbs * cost_per_lb_n(price)).alias("fertilizer_cost_usd"),
        F.sum("acres").alias("total_acres"),
        F.count_distinct("crop_name").alias("n_crops"),
    )
    per_acre = F.when(F.col("total_acres") > 0, F.col("fertilizer_cost_usd") / F.col("total_acres")).otherwise(0.0)
    return totals.withColumn("cost_per_acre", per_acre)


def crop_costs(crops: DataFrame, price: Column) -> DataFrame:
    """Cost per user and crop with its percentage of the user's total."""
    lbs = n_intensity(F.col("crop_name")) * F.col("acres")
    per_crop = crops.groupBy("user_id", "crop_name").agg(
        F.sum(lbs * cost_per_lb_n(price)).alias("cost"), F.min("created").alias("created")
    )
    total = F.sum("cost").over(Window.partitionBy("user_id"))
    return per_crop.withColumn("cost_pct", F.coalesce(ratio(F.col("cost"), total), F.lit(0.0)) * 100)


def farm_summary(crops: DataFrame, price: Column, gas_move: Column | None = None) -> DataFrame:
    """One row per user: totals, dearest crop, hungriest crop and gas alert.

    Ties go to the crop entered first.
    """
    costs = crop_costs(crops, price)
    intensity = n_intensity(F.col("crop_name"), 0)
    cards = costs.groupBy("user_id").agg(
        F.min_by(F.struct("crop_name", "cost", "cost_pct"), F.struct(-F.col("cost"), F.col("created"))).alias("top"),
        F.min_by(F.struct(F.col("crop_name"), intensity.alias("n_lbs")), F.struct(-intensity, F.col("created"))).alias("hungry"),
    )
    out = fertilizer_totals(crops, price).join(cards, "user_id").select(
        "user_id",
        "fertilizer_used_lbs",
        "fertilizer_cost_usd",
        "total_acres",
        "n_crops",
        "cost_per_acre",
        F.col("top.crop_name").alias("top_crop"),
        F.col("top.cost").alias("top_cost"),
        F.col("top.cost_pct").alias("top_pct"),
        F.col("hungry.crop_name").alias("top_n_crop"),
        F.col("hungry.n_lbs").alias("top_n_lbs"),
    )
    return out if gas_move is None else out.withColumn("gas_alert", gas_alert(gas_move))


def gas_alert(move: Column) -> Column:
    """Text when gas moved more than five percent, else NULL."""
    way = F.when(move > 0, "up").otherwise("down")
    return F.when(F.abs(move) > GAS_ALERT, F.format_string("Nat gas %s %.0f%% last 30 days", way, F.abs(move) * 100))


# Exposure --------------------------------------------------------------------


def remaining_need(farms: DataFrame) -> DataFrame:
    """Tonnes of urea a farm (crop_name, acres, pre_pct) still has to buy."""
    total = urea_mt(F.col("acres") * n_intensity(F.col("crop_name")))
    return farms.withColumn("total_urea_mt", total).withColumn(
        "remaining_mt", total * (F.lit(1.0) - F.col("pre_pct") / F.lit(100.0))
    )


def published(price: str) -> Column:
    """A price as it is published: one decimal."""
    return F.round(price, 1).alias(price)


def exposure_table(farms: DataFrame, price_bands: DataFrame) -> DataFrame:
    """Cost per farm and horizon at the published mean, low and high price, and at today's.

    ``price_bands`` has one row per series and horizon, far fewer rows than farms.
    """
    need = F.col("remaining_mt")
    return remaining_need(farms).join(
        price_bands.select(KEY, "horizon", *map(published, ("current", "p10", "p50", "p90"))), KEY
    ).select(
        "farm_id",
        KEY,
        "horizon",
        "total_urea_mt",
        "remaining_mt",
        (need * F.col("p50")).alias("cost_expected"),
        (need * F.col("p10")).alias("cost_low"),
        (need * F.col("p90")).alias("cost_high"),
        (need * F.col("current")).alias("cost_now"),
    )


# Hedge -----------------------------------------------------------------------


def hedge_prices(price_bands: DataFrame, n: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Mean, p10 and p90 of the hedge's own draws around each horizon's median.

    All horizons use the same stream of draws, clipped to the hedge's range.
    """
    around = price_bands.select(
        KEY,
        "horizon",
        "current",
        F.col("p50").alias("pred"),
        F.lit(0.0).alias("residual_mean"),
        "residual_std",
    )
    drawn = bands(around, n, seed, HEDGE_FLOOR, HEDGE_CEILING, stream=F.lit(1))
    return drawn.select(
        KEY,
        "horizon",
        published("current"),
        F.col("mean").alias("exp_price"),
        F.col("p10").alias("p10_price"),
        F.col("p90").alias("p90_price"),
    )


def with_risk(df: DataFrame) -> DataFrame:
    options = F.array(*[F.struct(F.lit(k).alias("risk"), F.lit(v).alias("alpha")) for k, v in RISK_ALPHA.items()])
    return df.withColumn("o", F.explode(options)).select(*df.columns, "o.risk", "o.alpha")


def objective_curve(prices: DataFrame) -> DataFrame:
    """Objective per tonne over the grid of buy-now fractions.

    Cost is linear in the price for a fraction up to one, so mean and p90 of the cost
    follow from mean and p90 of the price; the curve scales with a farm's tonnes and
    is therefore computed once per series, horizon and risk, not per farm.
    """
    f, alpha = F.col("fraction"), F.col("alpha")
    grid = F.transform(F.sequence(F.lit(0), F.lit(HEDGE_STEPS)), lambda i: i / F.lit(float(HEDGE_STEPS)))
    mean = f * F.col("current") + (1 - f) * F.col("exp_price")
    tail = f * F.col("current") + (1 - f) * F.col("p90_price")
    return (
        with_risk(prices)
        .withColumn("fraction", F.explode(grid))
        .withColumn("objective", (1 - alpha) * mean + alpha * tail)
    )


def best_fraction(curve: DataFrame) -> DataFrame:
    """Fraction with the lowest objective, the smallest one on a tie."""
    # Objectives are compared at a nano-dollar so that a flat curve counts as a tie.
    level = F.round("objective", 9)
    return curve.groupBy(KEY, "horizon", "risk").agg(
        F.min_by("fraction", F.struct(level, F.col("fraction"))).alias("f_star"),
        F.first("current").alias("current"),
        F.first("exp_price").alias("exp_price"),
        F.first("p10_price").alias("p10_price"),
        F.first("p90_price").alias("p90_price"),
    )


def hedge_split(farms: DataFrame, prices: DataFrame) -> DataFrame:
    """Buy-now share per farm, horizon and risk with the three strategies' costs.

    ``prices`` comes from :func:`hedge_prices`. Minimises
    (1 - alpha) * mean + alpha * p90 of the total cost.
    """
    need, now = F.col("remaining_mt"), F.col("current")
    f = F.when(need > 0, F.col("f_star")).otherwise(0.0)

    def split(price: str) -> Column:
        return need * (f * now + (1 - f) * F.col(price))

    return remaining_need(farms).join(best_fraction(objective_curve(prices)), KEY).select(
        "farm_id",
        KEY,
        "horizon",
        "risk",
        f.alias("f_star"),
        F.round(f * 100).cast("int").alias("pct_now"),
        (need * f).alias("mt_now"),
        (need * (1 - f)).alias("mt_wait"),
        (need * now).alias("cost_all_now"),
        split("exp_price").alias("exp_optimal"),
        split("p10_price").alias("p10_optimal"),
        split("p90_price").alias("p90_optimal"),
        (need * F.col("exp_price")).alias("exp_wait"),
        (need * F.col("p10_price")).alias("p10_wait"),
        (need * F.col("p90_price")).alias("p90_wait"),
        (need * F.col("exp_price") - split("exp_price")).alias("saving_vs_wait"),
    )


# Timing ----------------------------------------------------------------------


def timing_choices(mc: DataFrame) -> DataFrame:
    """Three price scenarios per series: now, in 30 days, in 60 days."""
    cur = published("current")
    none = F.lit(None).cast("double")
    options = F.array(
        F.struct(
            F.lit(0).alias("wait_days"), cur.alias("p10"), cur.alias("p50"), cur.alias("p90"), none.alias("prob_rising")
        ),
        F.struct(
            F.lit(30).alias("wait_days"),
            F.col("p10_t1").alias("p10"),
            F.col("p50_t1").alias("p50"),
            F.col("p90_t1").alias("p90"),
            chance_above(cur, F.col("p50_t1"), F.col("residual_std_t1")).alias("prob_rising"),
        ),
        F.struct(
            F.lit(60).alias("wait_days"),
            F.col("p10_t2").alias("p10"),
            F.col("p50_t2").alias("p50"),
            F.col("p90_t2").alias("p90"),
            F.col("prob_rising_t2").alias("prob_rising"),
        ),
    )
    return mc.select(KEY, cur, F.explode(options).alias("o")).select(KEY, "current", "o.*")


def badge(days: Column, p50: Column, current: Column, delta_pct: Column, prob: Column) -> Column:
    return (
        F.when(days == 0, "BASELINE")
        .when(p50 < current, F.format_string("SAVE %.1f%%", F.abs(delta_pct)))
        .otherwise(F.format_string("%.0f%% CHANCE HIGHER", prob * 100))
    )


def badge_level(days: Column, p50: Column, current: Column, prob: Column) -> Column:
    return (
        F.when(days == 0, "baseline")
        .when(p50 < current, "save")
        .when(prob * 100 < BADGE_BREAK, "moderate")
        .otherwise("high")
    )


def timing_options(farms: DataFrame, mc: DataFrame) -> DataFrame:
    """Cost of buying now, in 30 and in 60 days per farm."""
    need, cur, p50, prob = F.col("remaining_mt"), F.col("current"), F.col("p50"), F.col("prob_rising")
    now = need * cur
    delta = need * p50 - now
    pct = F.when(now > 0, delta / F.nullif(now, F.lit(0.0)) * 100).otherwise(0.0)
    days = F.col("wait_days")
    return (
        remaining_need(farms)
        .join(timing_choices(mc), KEY)
        .select(
            "farm_id",
            KEY,
            days,
            (need * F.col("p10")).alias("cost_p10"),
            (need * p50).alias("cost_p50"),
            (need * F.col("p90")).alias("cost_p90"),
            delta.alias("delta"),
            pct.alias("delta_pct"),
            F.when(days == 0, 0.0).otherwise((1 - prob) * 100).alias("prob_cheaper_pct"),
            badge(days, p50, cur, pct, prob).alias("badge"),
            badge_level(days, p50, cur, prob).alias("badge_level"),
        )
    )
