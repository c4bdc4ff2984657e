from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitrapanel.functions import clean, draws, stats


def test_normals_look_normal_and_ignore_partitioning(spark):
    ids = spark.range(0, 30_000)
    z = [r.z for r in ids.repartition(1).select("id", draws.normal(F.col("id"), 42).alias("z")).orderBy("id").collect()]
    other = [r.z for r in ids.repartition(7).select("id", draws.normal(F.col("id"), 42).alias("z")).orderBy("id").collect()]
    assert z == other
    z = np.array(z)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    assert abs(np.corrcoef(z[1:], z[:-1])[0, 1]) < 0.02
    assert abs((z > 1.2816).mean() - 0.1) < 0.01


def test_beta_draws_have_the_right_mean(spark):
    b = np.array([r.b for r in spark.range(20_000).select(draws.beta_5_2(F.col("id"), 1).alias("b")).collect()])
    assert abs(b.mean() - 5 / 7) < 0.01
    assert abs(b.var() - 10 / (49 * 8)) < 0.002


def test_pick_follows_weights(spark):
    u = draws.uniform(F.col("id"), 3)
    got = {r["p"]: r["count"] for r in spark.range(20_000).select(draws.pick(u, ["x", "y", "z"], [0.5, 0.3, 0.2]).alias("p")).groupBy("p").count().collect()}
    assert abs(got["x"] / 20_000 - 0.5) < 0.02 and abs(got["z"] / 20_000 - 0.2) < 0.02


@pytest.mark.parametrize("level,mean,std", [(400.0, 410.0, 25.0), (400.0, 300.0, 40.0), (1.0, 1.0, 1.0)])
def test_chance_above_matches_erf(spark, level, mean, std):
    got = spark.range(1).select(stats.chance_above(F.lit(level), F.lit(mean), F.lit(std)).alias("p")).first().p
    assert got == pytest.approx(0.5 * (1 - math.erf((level - mean) / std / math.sqrt(2))), abs=2e-7)


def test_chance_above_is_a_step_without_spread(spark):
    df = spark.createDataFrame([(500.0, 510.0, 0.0), (500.0, 500.0, 0.0), (500.0, 490.0, -1.0)], "c double, m double, s double")
    assert [r.p for r in df.select(stats.chance_above(F.col("c"), F.col("m"), F.col("s")).alias("p")).collect()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 3_000_000])
def test_count_above_by_bisection(spark, n):
    df = spark.range(1).select(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")).alias("v"))
    for level in {0, 1, n // 2, n - 1, n}:
        got = df.select(stats.sorted_count_above(F.col("v"), lambda x, level=level: x > level).alias("c")).first().c
        assert got == n - level


def test_clip_keeps_missing_values(spark):
    df = spark.createDataFrame([(None,), (5.0,), (50.0,), (5000.0,)], "x double")
    assert [r.c for r in df.select(clean.clip(F.col("x"), 10, 100).alias("c")).collect()] == [None, 10.0, 50.0, 100.0]


def test_draws_do_not_repeat_in_other_streams_or_far_away(spark):
    n = F.col("id")
    near = spark.range(4000).select(
        draws.uniform(n, 7).alias("a"),
        draws.uniform(n + 1_000_003, 7).alias("far"),
        draws.uniform(n, 8).alias("next"),
        draws.uniform(n + (1 << 31), 7).alias("high"),
        draws.uniform(n + (1 << 31) - 1, 7).alias("period"),
        draws.uniform(n + (1 << 45), 7).alias("higher"),
    ).toPandas()
    for c in near.columns[1:]:
        assert (near.a == near[c]).mean() < 0.001 and abs(np.corrcoef(near.a, near[c])[0, 1]) < 0.06, c
    assert near.to_numpy().min() > 0 and near.to_numpy().max() < 1
    # No stream is a shifted copy of another one.
    values = {c: set(near[c]) for c in near.columns}
    assert all(len(values["a"] & values[c]) < 10 for c in near.columns[1:])


def test_histogram_keeps_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.9,), (60.0,)], "x double")
    assert [r.b for r in df.select(stats.histogram_bin(F.col("x"), F.lit(0.0), F.lit(60.0), 60).alias("b")).collect()] == [1, 6, 60]
    flat = df.select(stats.histogram_bin(F.col("x"), F.lit(3.0), F.lit(3.0), 60).alias("b")).first()
    assert flat.b == 1


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(stats.correlation(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_direction_accuracy_without_moves_is_one_half(spark):
    df = spark.createDataFrame([(5.0, 6.0, 5.0), (4.0, 3.0, 4.0)], "y double, p double, b double")
    assert df.agg(stats.direction_accuracy(F.col("y"), F.col("p"), F.col("b")).alias("d")).first().d == 0.5


def test_lenient_parsing(spark):
    raw = ["1960M01", " 2024M12 ", "1960M13", "units", "", None, "1960M1"]
    df = spark.createDataFrame([(x,) for x in raw], "t string")
    got = [r.d for r in df.select(clean.period_code(F.col("t")).alias("d")).collect()]
    assert got == [dt.date(1960, 1, 1), dt.date(2024, 12, 1), None, None, None, None, dt.date(1960, 1, 1)]
    nums = spark.createDataFrame([("1.5",), ("..",), ("",), ("NaN",)], "t string")
    assert [r.d for r in nums.select(clean.to_double(F.col("t")).alias("d")).collect()] == [1.5, None, None, None]
    labels = spark.createDataFrame([(dt.date(2026, 5, 1),)], "d date").select(
        clean.month_label(F.col("d")).alias("l"), clean.months_after(F.col("d"), 8).alias("a")
    ).first()
    assert labels.l == "May 2026" and labels.a == dt.date(2027, 1, 1)
