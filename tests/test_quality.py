from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from nitrapanel.operators import quality

T = "series string, month date, urea double, dap double"
D = dt.date


def two(spark):
    left = [("a", D(2020, 1, 1), 1.0, None), ("a", D(2020, 2, 1), 2.0, 5.0), ("a", D(2020, 3, 1), 3.0, None)]
    right = [("a", D(2020, 1, 1), 1.0 + 5e-7, None), ("a", D(2020, 2, 1), 2.1, None), ("a", D(2020, 4, 1), None, None)]
    return spark.createDataFrame(left, T), spark.createDataFrame(right, T)


def test_parity_counts(spark):
    got = {r["column"]: r for r in rows_of(quality.parity(*two(spark), ["urea", "dap"]))}
    assert got["urea"]["diff_cells"] == 1 and got["urea"]["max_abs_diff"] == pytest.approx(0.1)
    assert got["dap"]["diff_cells"] == 1 and got["dap"]["max_abs_diff"] is None
    assert got["dap"]["first_month"] == D(2020, 2, 1)
    assert (got["urea"]["common"], got["urea"]["only_left"], got["urea"]["only_right"]) == (2, 1, 1)
    assert got["urea"]["verdict"] == "MISMATCH PRESENT"
    left, _ = two(spark)
    assert {r["verdict"] for r in rows_of(quality.parity(left, left, ["urea", "dap"]))} == {"PARITY OK"}


def test_classification_and_extra_rows(spark):
    left, right = two(spark)
    tags = {
        r["column"]: r["tag"]
        for r in rows_of(quality.parity_classified(left, right, ["urea", "dap"], {"urea": "2020-03-01", "dap": "2020-02-01"}))
    }
    assert tags == {"urea": "EXPECTED", "dap": "UNEXPLAINED"}
    shifted = quality.parity_classified(left, right, ["urea"], {}, {"urea": 0.2})
    assert shifted.first().tag == "EXPECTED"
    extra = {(r["side"], r["month"].month): r["verdict"] for r in rows_of(quality.extra_rows(left, right))}
    assert extra == {("left", 3): "UNEXPECTED", ("right", 4): "EXPECTED"}
    assert quality.column_parity(left, right.drop("dap")) == {"identical": False, "missing_right": ["dap"], "missing_left": []}


def test_preview_is_cut_per_column(spark):
    rows = [("a", D(2000 + i, 1, 1), float(i), 0.0) for i in range(30)]
    left = spark.createDataFrame(rows, T)
    got = rows_of(quality.parity_preview(left, left.withColumn("urea", F.col("urea") + 1), ["urea", "dap"]), "rn")
    plan = quality.first_n(left, "series", ["month"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert len(got) == 10 and got[0]["month"] == D(2000, 1, 1)


def test_null_and_unique_checks(spark):
    left, _ = two(spark)
    got = {r["name"]: (r["failures"], r["status"]) for r in rows_of(quality.not_null(left, "p", ["urea", "dap"]))}
    assert got == {"not_null_p_urea": (0, "pass"), "not_null_p_dap": (2, "fail")}
    assert quality.unique(left, "p", ["series"]).first().failures == 1
    assert quality.unique(left, "p", ["series", "month"]).first().status == "pass"
    assert quality.unique(left, "p", ["dap"]).first().failures == 0


@pytest.mark.parametrize("age,want", [(3, "pass"), (4, "warn"), (7, "warn"), (8, "error")])
def test_freshness_thresholds(spark, age, want):
    df = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 2),)], "period date")
    as_of = F.lit(D(2020, 1, 2) + dt.timedelta(days=age))
    tables = {"daily": (df, "period"), "static": (df, "period")}
    got = rows_of(quality.freshness_report(tables, {"daily": (3, 7)}, as_of))
    assert [(r["name"], r["age_days"], r["status"]) for r in got] == [("daily", age, want)]


def test_rollup_and_listing(spark):
    df = spark.createDataFrame([("b", "pass"), ("a", "FAIL"), ("c", "runtime error"), ("d", "warn"), ("e", None), ("f", "Success")], "name string, status string")
    got = rows_of(quality.status_rollup(df))[0]
    assert (got["n_ok"], got["n_warn"], got["n_bad"], got["n_unknown"]) == (2, 1, 2, 1)
    assert [r["name"] for r in quality.status_listing(df).collect()] == ["a", "c", "b", "d", "e", "f"]


def test_bundle_age(spark):
    got = spark.sql("select timestamp'2020-01-01 00:00:00' a, timestamp'2020-01-01 01:00:05' b")
    assert got.select(quality.bundle_age_seconds(F.col("a"), F.col("b")).alias("s")).first().s == 3605
