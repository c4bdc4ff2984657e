from __future__ import annotations

import datetime as dt

import pytest
from conftest import PANEL, months, rows_of

from nitrapanel.operators import legacy, staging
from nitrapanel.operators.spine import reindex_months

FEED = "series string, period date, value double"
MONTHLY = "series string, month date, value double"
D = dt.date


def test_last_in_month_and_duplicates(spark):
    feed = spark.createDataFrame(
        [("a", D(2020, 1, 3), 1.0), ("a", D(2020, 1, 31), 2.0), ("a", D(2020, 3, 6), 5.0), ("a", D(2020, 3, 13), None)], FEED
    )
    assert [(r["month"].month, r["value"]) for r in rows_of(staging.monthly_last(feed), "month")] == [(1, 2.0), (3, 5.0)]
    doubled = spark.createDataFrame([("a", D(2020, 1, 3), 1.0), ("a", D(2020, 1, 3), 3.0)], FEED)
    assert staging.period_mean(doubled).first().value == 2.0


def test_live_wins_over_backbone_and_backbone_fills(spark):
    daily = spark.createDataFrame([("a", D(2020, 2, 1), 10.0), ("a", D(2020, 2, 2), 20.0), ("a", D(2020, 5, 2), 7.0)], FEED)
    backbone = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 2, 1), 2.0), ("a", D(2020, 3, 1), None)], FEED)
    got = {r["month"].month: r["value"] for r in rows_of(staging.stage_spot(daily, backbone), "month")}
    assert got == {1: 1.0, 2: 15.0, 5: 7.0}


def test_storage_is_scaled_from_bcf(spark):
    weekly = spark.createDataFrame([("a", D(2020, 2, 7), 2.0), ("a", D(2020, 2, 28), 3.0)], FEED)
    backbone = spark.createDataFrame([("a", D(2020, 2, 1), 9.0), ("a", D(2020, 1, 1), 8.0)], FEED)
    got = {r["month"].month: r["value"] for r in rows_of(staging.stage_storage(weekly, backbone), "month")}
    assert got == {1: 8.0, 2: 3000.0}


def test_panel_equals_full_outer_join(spark):
    def monthly(*ms):
        return spark.createDataFrame([("a", D(2020, m, 1), float(m)) for m in ms], MONTHLY)

    got = rows_of(staging.build_panel(monthly(1, 2), monthly(2), monthly(4), monthly(1)), "month")
    assert [(r["month"].month, r["ng_spot"], r["urea"], r["dap"], r["storage_mmcf"]) for r in got] == [
        (1, 1.0, None, None, 1.0), (2, 2.0, 2.0, None, None), (4, None, None, 4.0, None)]


def gap_panel(spark):
    ms = months("2020-01", 6)
    rows = [("a", ms[0], 1.0, 1.0, 1.0, 1.0), ("a", ms[3], 2.0, 2.0, None, 1.0), ("a", ms[5], 3.0, None, None, None),
            ("b", ms[1], 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, PANEL)


def test_spine_end_rules(spark):
    p = gap_panel(spark)

    def count(**kw):
        return {s: n for s, n in ((r["series"], r["count"]) for r in reindex_months(p, **kw).groupBy("series").count().collect())}

    assert count() == {"a": 6, "b": 1}
    assert count(shared=True) == {"a": 6, "b": 6}
    assert count(end_rule="shortest") == {"a": 1, "b": 1}
    assert count(start="2020-02-01", end="2020-04-01", shared=True) == {"a": 3, "b": 3}
    gap = rows_of(reindex_months(p).where("series = 'a'"), "month")[1]
    assert gap["urea"] is None
    with pytest.raises(ValueError):
        reindex_months(p, end_rule="other")


def test_empty_inputs_stay_empty(spark):
    empty = spark.createDataFrame([], FEED)
    assert staging.monthly_mean(empty).count() == 0
    assert reindex_months(spark.createDataFrame([], PANEL)).count() == 0
    assert reindex_months(spark.createDataFrame([], PANEL), shared=True).count() == 0


def test_overlay_drops_live_months_in_holes_but_priority_merge_keeps_them(spark):
    backbone = spark.createDataFrame([("a", D(2020, m, 1), float(m)) for m in (2, 4)], MONTHLY)
    live = spark.createDataFrame([("a", D(2020, m, 1), 10.0 * m) for m in (1, 3, 4, 5)], MONTHLY)
    old = {r["month"].month: r["value"] for r in rows_of(legacy.overlay_live(backbone, live), "month")}
    assert old == {2: 2.0, 4: 40.0, 5: 50.0}
    new = {r["month"].month: r["value"] for r in rows_of(staging.stage_priority(live, backbone), "month")}
    assert new == {1: 10.0, 2: 2.0, 3: 30.0, 4: 40.0, 5: 50.0}


def test_sheet_fill_stops_after_two_months(spark):
    ms = months("2020-01", 6)
    vals = [1.0, None, None, None, 5.0, None]
    sheet = spark.createDataFrame([("a", m, v, v) for m, v in zip(ms, vals)], "series string, month date, urea double, dap double")
    got = [r["urea"] for r in rows_of(legacy.filled_sheet(sheet, ["urea", "dap"]), "month")]
    assert got == [1.0, 1.0, 1.0, None, 5.0, 5.0]


def test_backbone_fill_is_unlimited(spark):
    ms = months("2020-01", 5)
    feed = spark.createDataFrame([("a", m, v) for m, v in zip(ms, [None, 2.0, None, None, None])], FEED)
    assert [r["value"] for r in rows_of(legacy.filled_backbone(feed), "month")] == [None, 2.0, 2.0, 2.0, 2.0]


def test_legacy_storage_months_cover_holes(spark):
    feed = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 4, 1), None)], FEED)
    assert [(r["month"].month, r["value"]) for r in rows_of(legacy.storage_months(feed), "month")] == [
        (1, 1.0), (2, None), (3, None), (4, None)]


def test_legacy_panel_ends_with_the_shortest_measure(spark):
    ms = months("2018-01", 6)
    daily = spark.createDataFrame([("a", m, 3.0) for m in ms], FEED)
    weekly = spark.createDataFrame([("a", m, 2.0) for m in ms[:5]], FEED)
    base = spark.createDataFrame([("a", m, 1.0) for m in ms[:2]], FEED)
    sheet = spark.createDataFrame([("a", m, 400.0, 500.0) for m in ms[:4]], "series string, month date, urea double, dap double")
    got = rows_of(legacy.ingest_legacy(daily, base, weekly, base, sheet), "month")
    assert len(got) == 4 and got[-1]["ng_spot"] == 3.0 and got[-1]["storage_mmcf"] == 2000.0
