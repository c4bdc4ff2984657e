"""Monte Carlo price bands around the point forecasts.

Every series uses the same seeded standard normals, so a simulated price is a
non-decreasing function of the draw. The bands therefore follow from the order
statistics of the draws: an index holds them ascending in blocks with their ranks and
running sums, percentiles read fixed ranks, and each probability finds its rank by a
look-up in one block. No path is shuffled, and the plan is the same for any number of
draws. :func:`simulate_paths` gives the plain paths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nitrapanel.constants import DRAWS, HORIZONS, KEY, MONTH, SEED, SIM_CEILING, SIM_FLOOR
from nitrapanel.functions.clean import clip
from nitrapanel.functions.draws import path_normal
from nitrapanel.functions.stats import histogram_bin, sorted_count_above
from nitrapanel.session import materialize

QUANTILES = (10, 25, 50, 75, 90)
JUMPS = {"prob_rising": 1.0, "prob_10pct_increase": 1.10, "prob_20pct_increase": 1.20}
THIN = 10
BINS = 60
# Draws that a block of the index is meant to hold, and paths that a task makes in one go.
BLOCK = 5_000


def _price(point: Column, mean: Column, std: Column, z: Column, low: float, high: float) -> Column:
    return clip(point + (mean + std * z), low, high)


def _draws(spark: SparkSession, n: int, seed: int) -> DataFrame:
    paths = spark.range(n).select(
        F.col("id").alias("path_id"), F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("stream")
    )
    return paths.withColumn("z", path_normal(F.col("path_id"), F.col("stream"), seed))


def draw_index(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """Blocks of ascending draws per stream: ``stream, block, skip, before, zs, run``.

    ``skip`` draws lie below the block and sum up to ``before``; ``run`` holds the
    running sums inside it. A draw's block follows from the logistic of its value,
    which is near enough to the normal distribution to fill the blocks evenly.
    """
    blocks = -(-n // BLOCK)
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-1.702) * F.col("z")))
    placed = _draws(spark, n, seed).withColumn("block", F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("int"))
    upward = Window.partitionBy("stream", "block").orderBy("z", "path_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = F.sort_array(F.collect_list(F.struct("z", "path_id", "run")))
    packed = placed.withColumn("run", F.sum("z").over(upward)).groupBy("stream", "block").agg(ranked.alias("d"))
    packed = packed.select(
        "stream", "block", F.transform("d", lambda d: d["z"]).alias("zs"), F.transform("d", lambda d: d["run"]).alias("run")
    )
    packed = materialize(packed, "draw_blocks")
    earlier = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = packed.select("stream", "block", F.size("zs").cast("bigint").alias("n"), F.element_at("run", -1).alias("total"))
    offsets = sizes.select(
        "stream",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("before"),
    )
    return materialize(packed.join(offsets, ["stream", "block"]), "draw_index")


def draw_keys(index: DataFrame, n: int) -> DataFrame:
    """One row per stream: first draw of every block, and the draws at the quantiles' ranks."""
    places = [(n - 1) * p / 100.0 for p in QUANTILES]
    ranks = sorted({r for x in places for r in (math.floor(x), min(math.floor(x) + 1, n - 1))})
    end = F.col("skip") + F.size("zs")
    here = F.filter(F.array(*[F.lit(r).cast("bigint") for r in ranks]), lambda r: (r >= F.col("skip")) & (r < end))
    found = F.transform(here, lambda r: F.struct(r.alias("rank"), F.get("zs", (r - F.col("skip")).cast("int")).alias("z")))
    keys = index.groupBy("stream").agg(
        F.sort_array(F.collect_list(F.struct("block", F.get("zs", F.lit(0)).alias("z")))).alias("first"),
        F.map_from_entries(F.flatten(F.collect_list(found))).alias("at_rank"),
    )
    return materialize(keys, "draw_keys")


def simulate_paths(
    forecast: DataFrame,
    n: int = DRAWS,
    seed: int = SEED,
    low: float = SIM_FLOOR,
    high: float = SIM_CEILING,
    stream: Column | None = None,
) -> DataFrame:
    """One row per series, horizon and path with the simulated price.

    Paths are made block by block, and blocks are spread over the tasks.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"), F.lit(BLOCK).cast("bigint"))
    blocks = forecast.withColumn("first_path", F.explode(starts)).repartition(KEY, "horizon", "first_path")
    last = F.least(F.col("first_path") + BLOCK, F.lit(n).cast("bigint")) - 1
    paths = blocks.withColumn("path_id", F.explode(F.sequence("first_path", last))).drop("first_path")
    z = path_normal(F.col("path_id"), F.col("horizon") if stream is None else stream, seed)
    sim = _price(F.col("pred"), F.col("residual_mean"), F.col("residual_std"), z, low, high)
    return paths.withColumn("sim", sim)


def bands(
    forecast: DataFrame,
    n: int = DRAWS,
    seed: int = SEED,
    low: float = SIM_FLOOR,
    high: float = SIM_CEILING,
    sample_of: tuple[int, ...] = (),
    stream: Column | None = None,
) -> DataFrame:
    """Bands per series and horizon; forecast rows carry pred, current and residuals.

    For the horizons in ``sample_of`` every tenth simulated price, in path order, is
    added as an array; it is NULL for the others. Without a forecast or residuals the
    bands are NULL.
    """
    index = draw_index(forecast.sparkSession, n, seed)
    own = F.struct(*forecast.columns).alias("row")
    rows = forecast.select(own, (F.col("horizon") if stream is None else stream).alias("stream"))
    rows = rows.join(draw_keys(index, n), "stream", "left")
    base, std = F.col("row.pred") + F.col("row.residual_mean"), F.col("row.residual_std")

    def price(z: Column) -> Column:
        return _price(F.col("row.pred"), F.col("row.residual_mean"), std, z, low, high)

    def above(z: Column, probe: Column) -> Column:
        # Probability levels look at clipped prices, the clip bounds at plain ones.
        return F.when(probe["clipped"], price(z) > probe["level"]).otherwise(base + std * z > probe["level"])

    names = [*JUMPS, "low", "high"]
    levels = [F.col("row.current") * F.lit(m) for m in JUMPS.values()] + [F.lit(float(low)), F.lit(float(high))]
    probes = [
        F.struct(F.lit(k).alias("name"), v.alias("level"), F.lit(k in JUMPS).alias("clipped")) for k, v in zip(names, levels)
    ]
    asked = rows.withColumn("probe", F.explode(F.array(*probes)))
    not_above = F.filter("first", lambda b: ~F.coalesce(above(b["z"], F.col("probe")), F.lit(False)))
    block = F.get("first.block", F.greatest(F.size(not_above) - 1, F.lit(0)))
    met = asked.withColumn("block", block).join(index, ["stream", "block"], "left")
    inside = F.size("zs") - sorted_count_above(F.col("zs"), lambda z: above(z, F.col("probe")))
    run = F.when(inside > 0, F.get("run", inside - 1)).otherwise(0.0)
    known = F.col("probe.level").isNotNull() & std.isNotNull() & base.isNotNull()
    met = met.withColumn("below", F.when(known, F.col("skip") + inside)).withColumn("sum_below", F.when(known, F.col("before") + run))

    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col("probe.name") == name, F.col(c))).alias(f"{c}_{name}")

    wide = met.groupBy(F.col("row.series").alias("k"), F.col("row.horizon").alias("h")).agg(
        F.any_value("row").alias("row"),
        F.any_value("at_rank").alias("at_rank"),
        *[of(k, "below") for k in names],
        *[of(k, "sum_below") for k in ("low", "high")],
    )

    def quantile(p: int) -> Column:
        place = (n - 1) * p / 100.0
        rank = math.floor(place)
        a, b = (price(F.try_element_at("at_rank", F.lit(r).cast("bigint"))) for r in (rank, min(rank + 1, n - 1)))
        return (a + F.lit(place - rank) * (b - a)).alias(f"p{p}")

    between = F.col("below_high") - F.col("below_low")
    total = (
        F.col("below_low") * F.lit(float(low))
        + (n - F.col("below_high")) * F.lit(float(high))
        + std * (F.col("sum_below_high") - F.col("sum_below_low"))
        + base * between
    )
    out = wide.select(
        "row.*",
        F.lit(n).cast("bigint").alias("n_simulations"),
        *[quantile(p) for p in QUANTILES],
        (total / n).alias("mean"),
        *[((n - F.col(f"below_{k}")) / F.lit(float(n))).alias(k) for k in JUMPS],
    )
    if not sample_of:
        return out
    thinned = _draws(forecast.sparkSession, n, seed).where(F.col("path_id") % THIN == 0)
    sample = thinned.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("path_id", "z"))).alias("sample"))
    sample = materialize(sample.select(F.col("stream").alias("sample_stream"), F.transform("sample", lambda d: d["z"]).alias("z_sample")), "draw_sample")
    wanted = F.when(F.col("horizon").isin(*sample_of), F.col("horizon") if stream is None else stream)
    shaped = F.transform("z_sample", lambda z: _price(F.col("pred"), F.col("residual_mean"), F.col("residual_std"), z, low, high))
    return out.join(sample, wanted == F.col("sample_stream"), "left").select(*out.columns, shaped.alias("sim_sample"))


def with_residuals(forecast: DataFrame, residuals: DataFrame) -> DataFrame:
    """Forecast rows with their residual statistics and ``residual_source``.

    A series without own residuals takes those pooled over all series (``pooled``); if
    there are none either, the statistics stay NULL (``none``). No series is lost.
    """
    n, mean, std = F.col("n"), F.col("residual_mean"), F.col("residual_std")
    centre = F.sum(n * mean) / F.sum(n)
    spread = F.sqrt(F.greatest(F.sum(n * (std * std + mean * mean)) / F.sum(n) - centre * centre, F.lit(0.0)))
    pooled = residuals.groupBy("horizon").agg(centre.alias("pooled_mean"), spread.alias("pooled_std"))
    rows = forecast.join(residuals.drop("n"), [KEY, "horizon"], "left").join(pooled, "horizon", "left")
    source = F.when(std.isNotNull(), "own").when(F.col("pooled_std").isNotNull(), "pooled").otherwise("none")
    return rows.select(
        *forecast.columns,
        F.coalesce(mean, "pooled_mean").alias("residual_mean"),
        F.coalesce(std, "pooled_std").alias("residual_std"),
        source.alias("residual_source"),
    )


def monte_carlo(forecast: DataFrame, n: int = DRAWS, seed: int = SEED) -> DataFrame:
    """One row per series: bands of all horizons, probabilities and sample of t2."""
    b = bands(forecast, n, seed, sample_of=(2,))

    def at(h: int, c: str) -> Column:
        return F.max(F.when(F.col("horizon") == h, F.col(c)))

    aggs = [F.max("n_simulations").alias("n_simulations"), at(1, MONTH).alias(MONTH)]
    if "residual_source" in forecast.columns:
        aggs.append(at(2, "residual_source").alias("residual_source"))
    aggs += [at(1, c).alias(c) for c in ("current", "ng_spot", "ng_mom_1m") if c in forecast.columns]
    for h in HORIZONS:
        aggs.append(at(h, "pred").alias(f"t{h}"))
        aggs.append(at(h, "residual_std").alias(f"residual_std_t{h}"))
        kept = QUANTILES if h < 3 else (10, 50, 90)
        aggs += [at(h, f"p{p}").alias(f"p{p}_t{h}") for p in kept]
    aggs += [at(2, k).alias(f"{k}_t2") for k in JUMPS]
    sampled = F.when(F.col("horizon") == 2, F.col("sim_sample"))
    aggs.append(F.any_value(sampled, True).alias("sim_t2_distribution"))
    return b.groupBy(KEY).agg(*aggs)


def histogram(mc: DataFrame, values: str = "sim_t2_distribution", bins: int = BINS) -> DataFrame:
    """Counts of the sampled draws in at most ``bins`` equal bins per series."""
    x = F.col("x")
    return (
        mc.select(
            KEY,
            F.array_min(values).alias("low"),
            F.array_max(values).alias("high"),
            F.explode(values).alias("x"),
        )
        .groupBy(KEY, histogram_bin(x, F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
