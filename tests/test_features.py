from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from nitrapanel.constants import FEATURE_COLS, TARGET_COLS
from nitrapanel.operators.features import build_features, complete_rows, daily_features, latest_complete
from nitrapanel.operators.quality import leakage_probe


@pytest.fixture(scope="module")
def features(panel):
    return build_features(panel).cache()


def test_feature_count():
    assert len(FEATURE_COLS) == 43 and len(set(FEATURE_COLS)) == 43


@pytest.mark.parametrize("col,delta", [("ng_spot", 100.0), ("urea", 100.0), ("dap", 100.0), ("storage_mmcf", 1000.0)])
def test_no_feature_of_an_earlier_row_moves(panel, col, delta):
    assert leakage_probe(build_features, panel, col, delta, FEATURE_COLS).count() == 0


def test_the_probe_sees_a_leak(panel):
    def leaky(p):
        from pyspark.sql import Window

        whole = Window.partitionBy("series")
        return p.select("series", "month", (F.col("urea") - F.avg("urea").over(whole)).alias("x"))

    assert [r["column"] for r in leakage_probe(leaky, panel, "urea", 100.0, ["x"]).collect()] == ["x"]


def test_targets_are_shifted_prices_with_trailing_nulls(features):
    pdf = features.where("series = 'a'").orderBy("month").toPandas()
    for h in (1, 2, 3):
        want = pdf["urea"].shift(-h)
        pd.testing.assert_series_equal(pdf[f"target_urea_t{h}"], want, check_names=False)
        assert pdf[f"target_urea_t{h}"].isna().sum() == h


def test_features_match_pandas(features, panel):
    raw = panel.where("series = 'b'").orderBy("month").toPandas()
    got = features.where("series = 'b'").orderBy("month").toPandas()
    ng, urea, st = raw["ng_spot"], raw["urea"], raw["storage_mmcf"]
    want = {
        "ng_lag9": ng.shift(9),
        "ng_rolling_mean_6m": ng.rolling(6).mean(),
        "ng_rolling_std_12m": ng.rolling(12).std(),
        "ng_mom_3m": ng.pct_change(3),
        "urea_zscore_24m": (urea - urea.rolling(24).mean()) / urea.rolling(24).std(),
        "urea_vs_12m_low": urea / urea.rolling(12).min(),
        "storage_zscore": (st - st.expanding().mean()) / st.expanding().std(),
        "ng_ma90_eom": ng.rolling(6).mean(),
        "ng_daily_vol_1m": ng.rolling(3).std(),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series, rtol=1e-9, equal_nan=True, err_msg=name)


def test_an_interior_null_empties_the_windows_over_it(spark, panel):
    hole = panel.where("series = 'a'").withColumn("urea", F.when(F.col("month") != dt.date(2021, 6, 1), F.col("urea")))
    got = rows_of(build_features(hole), "month")
    three = {r["month"]: r["urea_rolling_mean_3m"] for r in got}
    assert [three[dt.date(2021, m, 1)] is None for m in (5, 6, 7, 8, 9)] == [False, True, True, True, False]


def test_constant_series_gives_null_scores(spark):
    rows = [("k", dt.date(2020 + m // 12, m % 12 + 1, 1), 3.0, 400.0, 500.0, 10.0) for m in range(30)]
    df = spark.createDataFrame(rows, "series string, month date, ng_spot double, urea double, dap double, storage_mmcf double")
    last = rows_of(build_features(df), "month")[-1]
    assert last["urea_zscore_12m"] is None and last["storage_zscore"] is None and last["urea_vs_12m_high"] == 1.0


def test_daily_features_match_pandas(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", periods=200)
    price = 3 + rng.normal(0, 0.1, 200).cumsum()
    df = spark.createDataFrame([("a", d.date(), float(p)) for d, p in zip(days, price)], "series string, period date, value double")
    got = daily_features(df).orderBy("month").toPandas()
    s = pd.Series(price, index=days)
    for n in (30, 60, 90):
        want = s.rolling(n, min_periods=n // 2).mean().resample("MS").last()
        np.testing.assert_allclose(got[f"ng_ma{n}_eom"].astype(float), want.values, rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(got["ng_daily_vol_1m"], s.resample("MS").std().values, rtol=1e-9)


def test_latest_complete_row(features):
    got = rows_of(latest_complete(features).select("series", "month"), "series")
    assert [r["month"] for r in got] == [dt.date(2022, 8, 1), dt.date(2023, 2, 1), dt.date(2022, 1, 1)]
    assert complete_rows(features, True).agg(F.max("month")).first()[0] == dt.date(2022, 11, 1)
    assert set(TARGET_COLS) <= set(features.columns)


def test_one_shuffle_and_one_sort_for_all_features(panel):
    plan = build_features(panel)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning") == 1
    assert initial.count("Sort [") == 1
    assert initial.count("Window [") == 1


def test_result_does_not_depend_on_partitions(spark, panel):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return rows_of(build_features(panel.repartition(n)), "series", "month")

    try:
        assert run(1) == run(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
