from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from nitrapanel.constants import LBS_PER_MT, N_LBS_PER_ACRE, UREA_N_SHARE
from nitrapanel.functions.draws import path_normal
from nitrapanel.operators import borrowers, farm, states

LOG = "user_id long, crop_name string, season string, year int, seq long, action string, acres double"


def brute_fold(log):
    """The change log applied one entry at a time."""
    state = {}
    for user, crop, season, year, _, action, acres in sorted(log, key=lambda r: r[4]):
        key = (user, crop.lower(), season, year)
        if action == "add":
            name, have = state.get(key, (crop, 0.0))
            state[key] = (name, have + acres)
        elif key in state and action == "set":
            state[key] = (state[key][0], acres)
        elif action == "delete":
            state.pop(key, None)
    return {k: (n, round(a, 6)) for k, (n, a) in state.items()}


@pytest.mark.parametrize("seed,n,block,span", [(0, 60, 1024, 4096), (1, 60, 5, 2), (2, 7, 1, 1), (3, 900, 7, 4), (4, 900, 64, 3), (5, 300, 1, 5)])
def test_crop_state_equals_sequential_application(spark, monkeypatch, seed, n, block, span):
    # With 900 changes one crop row holds most of the log; blocks cut it anywhere.
    monkeypatch.setattr(farm, "BLOCK", block)
    monkeypatch.setattr(farm, "SPAN", span)
    rnd = random.Random(seed)
    log = [
        (
            rnd.choice([1, 1, 1, 2]),
            rnd.choice(["Corn", "corn", "CORN", "Corn" if n > 100 else "Hay"]),
            "Spring" if n > 100 and i % 20 else rnd.choice(["Spring", "Fall"]),
            2025,
            i,
            rnd.choice(["add", "add", "set", "delete"]),
            float(rnd.randint(1, 50)),
        )
        for i in range(n)
    ]
    got = rows_of(farm.crop_state(spark.createDataFrame(log, LOG)))
    assert {
        (r["user_id"], r["crop_name"].lower(), r["season"], r["year"]): (r["crop_name"], round(r["acres"], 6)) for r in got
    } == brute_fold(log)


def test_the_log_is_read_once_and_not_joined(spark, tmp_path):
    spark.createDataFrame([(1, "Corn", "Fall", 2025, i, "add", 1.0) for i in range(9)], LOG).write.parquet(str(tmp_path / "log"))
    plan = farm.crop_state(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_missing_acres_and_unknown_actions(spark):
    log = [(1, "Corn", "Fall", 2025, 1, "add", None), (1, "corn", "Fall", 2025, 2, "add", 4.0), (1, "Corn", "Fall", 2025, 3, "look", 9.0), (2, "Hay", "Fall", 2025, 4, "set", 3.0)]
    assert [(r["user_id"], r["crop_name"], r["acres"], r["created"]) for r in rows_of(farm.crop_state(spark.createDataFrame(log, LOG)))] == [(1, "Corn", 4.0, 1)]
    assert farm.crop_state(spark.createDataFrame([], LOG)).count() == 0


def crops(spark):
    rows = [(1, "Corn", "Spring", 2025, 100.0), (1, "Corn", "Fall", 2025, 50.0), (1, "Rice", "Fall", 2025, 10.0), (1, "corn", "Fall", 2024, 1.0), (2, "Hay", "Fall", 2025, 0.0)]
    return numbered(spark, rows)


def numbered(spark, rows):
    """Crop rows in the order they were entered."""
    rows = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "user_id long, crop_name string, season string, year int, acres double, created long")


def test_ties_go_to_the_crop_entered_first(spark):
    rows = [(2, "Hay", "Fall", 2025, 0.0), (2, "Clover", "Fall", 2025, 0.0), (3, "Yam", "Fall", 2025, 1.0), (3, "Fig", "Fall", 2025, 1.0)]
    got = {r["user_id"]: r for r in rows_of(farm.farm_summary(numbered(spark, rows), F.lit(440.0)))}
    assert got[2]["top_crop"] == "Hay" and got[3]["top_crop"] == got[3]["top_n_crop"] == "Yam"


def test_totals_use_defaults_and_exact_names(spark):
    got = {r["user_id"]: r for r in rows_of(farm.fertilizer_totals(crops(spark), F.lit(440.0)))}
    lbs = 150 * 150 + 10 * 100 + 1 * 100
    assert got[1]["fertilizer_used_lbs"] == lbs
    assert got[1]["fertilizer_cost_usd"] == pytest.approx(lbs * 440 / LBS_PER_MT / UREA_N_SHARE)
    assert got[1]["n_crops"] == 3 and got[2]["cost_per_acre"] == 0.0


def test_summary_cards(spark):
    got = {r["user_id"]: r for r in rows_of(farm.farm_summary(crops(spark), F.lit(440.0), F.lit(0.07)))}
    assert got[1]["top_crop"] == "Corn" and got[1]["top_n_crop"] == "Corn" and got[1]["top_n_lbs"] == 150
    assert got[1]["gas_alert"] == "Nat gas up 7% last 30 days"
    quiet = farm.farm_summary(crops(spark), F.lit(440.0), F.lit(-0.05)).first()
    assert quiet.gas_alert is None


def test_season_filter_and_labels(spark):
    assert farm.select_crops(crops(spark), [], 2025).count() == 0
    assert farm.select_crops(crops(spark), ["Fall"], 2025).count() == 3
    labels = {(r["crop_name"], r["season"]): r["display_label"] for r in rows_of(farm.crop_labels(crops(spark)))}
    assert labels["Corn", "Fall"] == "Corn (Fall)" and labels["Rice", "Fall"] == "Rice" and labels["Hay", "Fall"] == "Hay"


FARMS = "farm_id long, series string, crop_name string, acres double, pre_pct double"


def farms(spark):
    rows = [(1, "a", "Corn", 500.0, 20.0), (2, "a", "Kale", 300.0, 0.0), (3, "a", "Corn", 100.0, 100.0), (4, "b", "Hay", 0.0, 0.0)]
    return spark.createDataFrame(rows, FARMS)


def test_exposure_of_a_fully_prepurchased_farm_is_zero(spark):
    b = spark.createDataFrame([("a", 1, 400.0, 380.0, 420.0, 450.0)], "series string, horizon int, current double, p10 double, p50 double, p90 double")
    got = {r["farm_id"]: r for r in rows_of(farm.exposure_table(farms(spark), b))}
    mt = 500 * 150 / (0.46 * 2204.6)
    assert got[1]["total_urea_mt"] == pytest.approx(mt) and got[1]["cost_expected"] == pytest.approx(mt * 0.8 * 420)
    assert got[2]["total_urea_mt"] == pytest.approx(300 * 100 / (0.46 * 2204.6))
    assert got[3]["cost_high"] == 0.0 and 4 not in got


BANDS = "series string, horizon int, current double, p50 double, residual_std double"


@pytest.mark.parametrize("current,p50,std", [(400.0, 430.0, 40.0), (430.0, 400.0, 60.0), (400.0, 398.0, 30.0), (400.0, 400.0, 0.0)])
def test_hedge_equals_the_full_grid_over_paths(spark, current, p50, std):
    n = 2000
    z = np.array([r.z for r in spark.range(n).orderBy("id").select(path_normal(F.col("id"), F.lit(1), 42).alias("z")).collect()])
    paths = np.clip(p50 + std * z, 50, 2000)
    b = spark.createDataFrame([("a", h, current, p50, std) for h in (1, 2, 3)] + [("b", 1, 1.0, 1.0, 1.0)], BANDS)
    got = rows_of(farm.hedge_split(farms(spark), farm.hedge_prices(b, n)))
    for r in (x for x in got if x["series"] == "a" and x["farm_id"] in (1, 3)):
        alpha = {"Conservative": 0.75, "Balanced": 0.45, "Aggressive": 0.15}[r["risk"]]
        need = 500 * 150 / (0.46 * 2204.6) * 0.8 if r["farm_id"] == 1 else 0.0
        grid = np.linspace(0, 1, 201)
        costs = [need * (f * current + (1 - f) * paths) for f in grid]
        obj = np.round([(1 - alpha) * c.mean() + alpha * np.percentile(c, 90) for c in costs], 6)
        assert r["f_star"] == pytest.approx(grid[int(np.argmin(obj))])
        best = costs[int(np.argmin(obj))]
        assert r["exp_optimal"] == pytest.approx(best.mean()) and r["p90_optimal"] == pytest.approx(np.percentile(best, 90))
        assert r["p10_wait"] == pytest.approx(np.percentile(need * paths, 10))
        assert r["saving_vs_wait"] == pytest.approx((need * paths).mean() - best.mean(), abs=1e-6)


def test_timing_badges(spark):
    mc = spark.createDataFrame(
        [("a", 400.0, 380.0, 390.0, 420.0, 30.0, 390.0, 440.0, 480.0, 0.9), ("b", 400.0, 400.0, 410.0, 420.0, 0.0, 390.0, 400.0, 480.0, 0.5)],
        "series string, current double, p10_t1 double, p50_t1 double, p90_t1 double, residual_std_t1 double, "
        "p10_t2 double, p50_t2 double, p90_t2 double, prob_rising_t2 double",
    )
    got = {(r["farm_id"], r["wait_days"]): r for r in rows_of(farm.timing_options(farms(spark), mc))}
    assert got[1, 0]["badge"] == "BASELINE" and got[1, 0]["prob_cheaper_pct"] == 0
    assert got[1, 30]["badge"] == "SAVE 2.5%" and got[1, 30]["badge_level"] == "save"
    assert got[1, 60]["badge"] == "90% CHANCE HIGHER" and got[1, 60]["badge_level"] == "high"
    assert got[4, 30]["badge"] == "100% CHANCE HIGHER" and got[4, 30]["delta_pct"] == 0.0
    assert got[4, 60]["badge_level"] == "moderate"


def test_fixed_state_table(spark):
    st = states.us_states(spark)
    assert st.count() == 31
    got = rows_of(states.state_exposure(st, F.lit(440.0), F.lit(484.0)), "state")
    top = max(got, key=lambda r: r["urea_mt"])
    assert top["state"] == "Iowa" and top["elevation"] == 500_000 and top["color_r"] == 255 and top["color_g"] == 55
    iowa = 1000 * (12900 * N_LBS_PER_ACRE["Corn"] + 9400 * N_LBS_PER_ACRE["Soybeans"]) / (0.46 * 2204.6)
    assert top["urea_mt"] == pytest.approx(iowa) and top["impact_m"] == pytest.approx(iowa * 44 / 1e6)
    by_cost = rows_of(states.state_exposure(st, F.lit(440.0), F.lit(440.0 * 1.0001), by="impact_m"))
    assert min(r["elevation"] for r in by_cost) >= 1000
    text = {r["state"]: r for r in rows_of(states.ranking_table(states.state_exposure(st, F.lit(440.0), F.lit(484.0))))}
    assert text["Iowa"]["corn"] == "12.9M ac" and text["Delaware"]["wheat"] == "100K ac" and text["Iowa"]["impact"].startswith("▲$")


def test_borrowers_follow_their_distributions(spark):
    pdf = borrowers.borrowers(spark.range(20_000)).toPandas()
    assert abs((pdf.crop_type == "Maize").mean() - 0.06) < 0.01
    assert abs((pdf.months_since_delinquency == -1).mean() - 0.7) < 0.015
    assert pdf.months_since_delinquency.max() == 47 and set(pdf.season) == {"Zaid", "Kharif", "Rabi"}
    assert pdf.farm_area_acres.between(50, 1500).all() and abs(pdf.current_ltv_ratio.mean() - 0.95 * 5 / 7) < 0.01


def test_stress_score(spark):
    df = spark.createDataFrame([("Maize", 0.9, 1), ("Soybean", 0.1, -1)], "crop_type string, current_ltv_ratio double, months_since_delinquency int")
    got = rows_of(borrowers.stress_score(df, F.lit(0.0)))
    assert got[0]["stress_probability"] == 1.0 and got[0]["requires_intervention"] == 1
    assert got[1]["stress_probability"] == pytest.approx(0.1)


def test_stress_of_an_unknown_crop_or_ratio_is_missing(spark):
    rows = [("Quinoa", 0.5, 3), ("Wheat", None, 3), (None, 0.5, 3)]
    df = spark.createDataFrame(rows, "crop_type string, current_ltv_ratio double, months_since_delinquency int")
    got = rows_of(borrowers.stress_score(df, F.lit(0.0)))
    assert [(r["stress_probability"], r["requires_intervention"]) for r in got] == [(None, None)] * 3
