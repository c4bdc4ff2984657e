from __future__ import annotations

import itertools

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from nitrapanel.functions.draws import path_normal
from nitrapanel.operators import simulate
from nitrapanel.operators.signal import generate_signal, rule

# Bounds of the rules: (change, probability) of buy, consider and wait.
BUY, CONSIDER, WAIT = (0.08, 0.65), (0.04, 0.55), (-0.04, 0.40)
STEP = 1e-9


def expected(change: float, chance: float) -> str:
    if change > BUY[0] and chance > BUY[1]:
        return "BUY_NOW"
    if change > CONSIDER[0] or chance > CONSIDER[1]:
        return "CONSIDER_BUYING"
    return "WAIT" if change < WAIT[0] and chance < WAIT[1] else "NEUTRAL"


def test_rules_on_each_bound_and_one_step_beside_it(spark):
    changes = [b[0] + d for b in (BUY, CONSIDER, WAIT) for d in (-STEP, 0.0, STEP)]
    chances = [b[1] + d for b in (BUY, CONSIDER, WAIT) for d in (-STEP, 0.0, STEP)]
    grid = list(itertools.product(changes, chances))
    rng = np.random.default_rng(12)
    grid += list(zip(rng.uniform(-0.2, 0.2, 200).tolist(), rng.uniform(0, 1, 200).tolist()))
    df = spark.createDataFrame(grid, "change double, chance double")
    got = df.select("change", "chance", rule(F.col("change"), F.col("chance")).alias("s")).collect()
    assert [(r.change, r.chance, r.s) for r in got if r.s != expected(r.change, r.chance)] == []
    assert {r.s for r in got} == {"BUY_NOW", "CONSIDER_BUYING", "WAIT", "NEUTRAL"}


MC = (
    "series string, current double, t2 double, ng_spot double, ng_mom_1m double, p50_t1 double, p50_t2 double, "
    "p50_t3 double, p10_t2 double, p90_t2 double, prob_rising_t2 double"
)


def outlook(name, change, chance, medians, gas_move):
    return (name, 410.0, 410.0 * (1 + change), 5.5, gas_move, *medians, 371.0, 466.0, chance)


def test_signal_row(spark):
    rows = [
        outlook("up", 0.21, 0.9, (420.0, 415.0, 431.0), 0.14),
        outlook("down", -0.12, 0.1, (401.0, 390.0, 390.0), -0.07),
        outlook("flat", 0.0, 0.5, (410.0, 410.0, 410.0), 0.01),
    ]
    got = {r["series"]: r for r in rows_of(generate_signal(spark.createDataFrame(rows, MC)))}
    assert [(got[k]["signal"], got[k]["urgency"]) for k in ("up", "down", "flat")] == [
        ("BUY_NOW", "HIGH"), ("WAIT", "LOW"), ("NEUTRAL", "LOW"),
    ]
    assert got["up"]["confidence"] == pytest.approx(0.9) and got["down"]["confidence"] == pytest.approx(0.9)
    # The cheapest median decides the month, the earliest one on a tie.
    assert [got[k]["best_month"] for k in ("up", "down", "flat")] == ["In 2 months", "In 2 months", "Next month"]
    assert got["up"]["key_driver"] == "Nat gas up 14% in 30 days" and got["down"]["key_driver"] == "Nat gas down 7% in 30 days"
    assert "-12%" in got["down"]["rationale"]


FORECAST = (
    "series string, month date, horizon int, current double, ng_spot double, ng_mom_1m double, pred double, "
    "residual_mean double, residual_std double"
)


def forecast(spark, wide=1.0):
    """Two series with different levels, biases and spreads at every horizon."""
    rows = [
        (s, None, h, level, 4.4, -0.02, level * (1 + 0.03 * h), bias, wide * (0.02 + 0.03 * h) * level)
        for s, level, bias in (("a", 333.0, 4.0), ("b", 720.0, -11.0))
        for h in (1, 2, 3)
    ]
    return spark.createDataFrame(rows, FORECAST)


def drawn(spark, n, seed=42):
    paths = spark.range(n).select("id", *[path_normal(F.col("id"), F.lit(h), seed).alias(f"z{h}") for h in (1, 2, 3)])
    return paths.orderBy("id").toPandas()


@pytest.mark.parametrize("n,wide", [(1_500, 1.0), (1_500, 0.0), (1_500, 40.0), (300_000, 3.0), (7, 1.0)])
def test_bands_match_numpy(spark, n, wide):
    z = drawn(spark, n)
    rows = rows_of(simulate.bands(forecast(spark, wide), n, 42, sample_of=(2,)), "series", "horizon")
    assert len(rows) == 6
    for r in rows:
        paths = np.clip(r["pred"] + (r["residual_mean"] + r["residual_std"] * z[f"z{r['horizon']}"].to_numpy()), 100.0, 2000.0)
        assert [r[f"p{p}"] for p in simulate.QUANTILES] == pytest.approx(list(np.percentile(paths, simulate.QUANTILES)), rel=1e-12)
        assert r["mean"] == pytest.approx(paths.mean(), rel=1e-9) and r["n_simulations"] == n
        for name, m in simulate.JUMPS.items():
            assert r[name] == pytest.approx((paths > r["current"] * m).mean(), abs=1e-12), name
        if r["horizon"] == 2:
            assert r["sim_sample"] == pytest.approx(list(paths[:: simulate.THIN]))
        else:
            assert r["sim_sample"] is None


def test_missing_spread_gives_missing_bands(spark):
    f = forecast(spark).withColumn("residual_std", F.when(F.col("series") == "a", F.col("residual_std")))
    rows = rows_of(simulate.bands(f, 200), "series", "horizon")
    assert len(rows) == 6
    assert all((r["p50"] is None) == (r["series"] == "b") and (r["prob_rising"] is None) == (r["series"] == "b") for r in rows)
    assert all((r["mean"] is None) == (r["series"] == "b") for r in rows)


def test_paths_are_spread_and_equal_the_draws(spark):
    paths = simulate.simulate_paths(forecast(spark).where("series = 'b' AND horizon = 2"), 20_001, 42)
    z = drawn(spark, 20_001)["z2"].to_numpy()
    got = paths.orderBy("path_id").toPandas()
    assert got.path_id.tolist() == list(range(20_001))
    assert np.allclose(got.sim, np.clip(got.pred + (got.residual_mean + got.residual_std * z), 100.0, 2000.0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = simulate.simulate_paths(forecast(spark).where("series = 'b' AND horizon = 2"), 60_000, 42)
        assert again.select(F.spark_partition_id().alias("t")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_seed_decides(spark):
    one, two, other = (rows_of(simulate.monte_carlo(forecast(spark), 900, seed), "series") for seed in (5, 5, 6))
    assert one == two and one != other
    assert one[0]["n_simulations"] == 900 and len(one[0]["sim_t2_distribution"]) == 90


def test_horizons_are_independent(spark):
    z = drawn(spark, 6_000)
    assert np.abs(np.corrcoef(z[["z1", "z2", "z3"]].to_numpy().T) - np.eye(3)).max() < 0.05


def test_young_series_take_pooled_residuals(spark):
    rows = forecast(spark).drop("residual_mean", "residual_std")
    known = spark.createDataFrame(
        [("a", h, 10, 1.0, 2.0) for h in (1, 2)] + [("c", 1, 30, 5.0, 4.0)],
        "series string, horizon int, n long, residual_mean double, residual_std double",
    )
    got = {(r["series"], r["horizon"]): r for r in rows_of(simulate.with_residuals(rows, known))}
    assert len(got) == 6
    assert [got[k]["residual_source"] for k in (("a", 1), ("b", 1), ("b", 3))] == ["own", "pooled", "none"]
    sample = np.concatenate([[1.0 - 2, 1.0 + 2] * 5, [5.0 - 4, 5.0 + 4] * 15])
    assert got["b", 1]["residual_mean"] == pytest.approx(sample.mean())
    assert got["b", 1]["residual_std"] == pytest.approx(sample.std())
    assert got["a", 1]["residual_mean"] == 1.0 and got["b", 3]["residual_std"] is None


def test_histogram_counts_every_sampled_draw(spark):
    h = simulate.histogram(simulate.monte_carlo(forecast(spark), 3000))
    assert [r["n"] for r in h.groupBy("series").agg(F.sum("n").alias("n")).collect()] == [300, 300]
    assert h.agg(F.max("bin")).first()[0] == simulate.BINS
    flat = simulate.histogram(simulate.monte_carlo(forecast(spark, 0.0), 3000))
    assert rows_of(flat.where("series = 'b'")) == [{"series": "b", "bin": 1, "n": 300}]
