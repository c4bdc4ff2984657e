from __future__ import annotations

import datetime as dt
import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from nitrapanel.operators import bundle
from nitrapanel.plans.refresh import StepFailed, run_steps
from nitrapanel.sources import feeds, landing, versions
from nitrapanel.sources.resolve import known_rows, publish, resolve

D = dt.date


def test_api_pages_are_flattened_over_pages(spark, tmp_path):
    rows = [{"period": "2020-01-0%d" % i, "value": v, "series": s} for i, (v, s) in enumerate([("1.5", "X"), (None, "X"), ("bad", "X"), ("4", "Y")], 1)]
    (tmp_path / "p1.json").write_text(json.dumps({"response": {"data": rows[:2]}}, indent=1))
    (tmp_path / "p2.json").write_text(json.dumps({"response": {"data": rows[2:]}}))
    (tmp_path / "p3.json").write_text(json.dumps({"response": {"data": []}}))
    got = rows_of(feeds.read_api_pages(spark, str(tmp_path)), "period")
    assert [(r["period"], r["value"], r["series"]) for r in got] == [(D(2020, 1, 1), 1.5, "X"), (D(2020, 1, 4), 4.0, "Y")]
    assert feeds.read_api_pages(spark, str(tmp_path), {"series": "Y"}).count() == 1


def test_monthly_csv_with_and_without_missing(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("Month,Price\n2020-01,3.1\n2020-02,\n2020-03,n/a\nbad,1\n2020-04,3.4\n")
    assert [r["value"] for r in rows_of(feeds.read_monthly_csv(spark, str(p)), "period")] == [3.1, 3.4]
    assert [r["value"] for r in rows_of(feeds.read_monthly_csv(spark, str(p), True), "period")] == [3.1, None, None, 3.4]


def test_newest_price_sheet_vintage(spark, tmp_path):
    for name, price in (("prices-2025.csv", "1"), ("prices-2026.csv", "2")):
        (tmp_path / name).write_text(f"period,Urea ,DAP\n,($/mt),($/mt)\n1960M01,{price},..\nfoo,9,9\n")
    got = rows_of(feeds.read_price_sheet(spark, [str(tmp_path / n) for n in ("prices-2025.csv", "prices-2026.csv")]))
    assert got == [{"period": D(1960, 1, 1), "urea": 2.0, "dap": None}]


def test_storage_column_is_found_by_name(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("Date,Base Gas,U.S. Working Gas (MMcf),Other Working Gas\n2020-01-15,1,7,8\nnone,1,2,3\n2020-02-15,1,..,3\n")
    got = rows_of(feeds.read_storage_sheet(spark, str(p)), "period")
    assert [(r["period"], r["value"]) for r in got] == [(D(2020, 1, 1), 7.0), (D(2020, 2, 1), None)]
    with pytest.raises(ValueError):
        feeds.parse_storage_sheet(spark.createDataFrame([("x", "y")], "Date string, Gas string"))


def test_daily_sheet(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("Date,Spot\n2020-01-02,3.0\n2020-01-03,\nx,1\n")
    assert feeds.read_daily_sheet(spark, str(p)).count() == 1


def feed(spark, n):
    return spark.createDataFrame([("a", D(2020, 1, 1 + i), float(i)) for i in range(n)], "series string, period date, value double")


def test_landing_adds_versions_and_refuses_empty(spark, tmp_path):
    root = str(tmp_path)
    registry = {"one": lambda: feed(spark, 3), "two": lambda: feed(spark, 2)}
    got = rows_of(landing.land_all(registry, root, only={"two"}, provenance={"two": {"source": "api"}}))
    assert [(r["table_name"], r["n_rows"], r["last_period"]) for r in got] == [("two", 2, D(2020, 1, 2))]
    first = versions.read_version(spark, root, "two")
    assert first.first()["source"] == "api" and "loaded_at" in first.columns
    landing.land_raw(feed(spark, 1), root, "two")
    assert versions.read_version(spark, root, "two").count() == 1
    # Whoever reads the first version, by its number or since before, still does.
    assert first.count() == versions.read_version(spark, root, "two", 1).count() == 2
    with pytest.raises(RuntimeError, match="refusing"):
        landing.land_raw(feed(spark, 1).where("false"), root, "two")
    assert versions.versions(spark, root, "two") == [1, 2]
    with pytest.raises(ValueError):
        landing.land_all(registry, root, only={"other"})
    with pytest.raises(ValueError):
        versions.read_version(spark, root, "one")


def test_a_feed_runs_once_when_it_is_landed(spark, tmp_path):
    root, seen = str(tmp_path), spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(value):
        seen.add(1)
        return value >= 0

    # Counts of a task are known when it has read all its rows, as ahead of a shuffle.
    moved = feed(spark, 5).where(counted("value")).repartition(2, "period")
    assert landing.land_raw(moved, root, "t").count() == 5
    assert seen.value == 5
    # Nothing of a refused feed is kept, also where it has neither rows nor partitions.
    for empty in (feed(spark, 2).where("value < 0"), spark.createDataFrame([], feed(spark, 1).schema)):
        with pytest.raises(RuntimeError, match="refusing"):
            landing.land_raw(empty, root, "t")
    assert versions.versions(spark, root, "t") == [1] and len(versions.names(spark, f"{root}/t/{versions.DATA}")) == 1


def test_a_torn_landing_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    landing.land_raw(feed(spark, 3), root, "t")
    folder = versions.new_folder(root, "t")
    feed(spark, 9).write.parquet(folder)  # written, never given a number
    assert versions.read_version(spark, root, "t").count() == 3
    assert versions.publish_folder(spark, root, "t", folder) == 2 and versions.read_version(spark, root, "t").count() == 9
    landing.land_raw(feed(spark, 4), root, "t")
    assert versions.drop_versions(spark, root, "t", keep=2) == [1]
    assert versions.versions(spark, root, "t") == [2, 3] and versions.read_version(spark, root, "t", 2).count() == 9
    assert len(versions.names(spark, f"{root}/t/data")) == 2
    assert not versions.commit(spark, f"{root}/t/_manifests/00000003.json", {"version": 3, "folder": "data/none"})
    assert versions.read_version(spark, root, "t").count() == 4


def test_scan_turns_nan_into_null(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, float("nan")), (2, 2.0)], "id int, v double").write.parquet(path)
    assert [r["v"] for r in rows_of(landing.scan(spark, path, ["id", "v"]), "id")] == [None, 2.0]


def test_source_choice(spark, tmp_path):
    here = str(tmp_path / "here")
    feed(spark, 2).write.parquet(here)
    sources = {"mart": lambda: spark.read.parquet(str(tmp_path / "gone")), "local": lambda: spark.read.parquet(here)}
    said = []
    assert resolve("auto", sources, said.append).count() == 2 and len(said) == 1
    assert resolve("local", sources).count() == 2
    with pytest.raises(ValueError):
        resolve("csv", sources)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        resolve("mart", sources)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        resolve("auto", {"bad": lambda: spark.read.parquet(here).select("nope"), **sources}, said.append)


def test_view_and_stored_model(spark, tmp_path):
    root = str(tmp_path)
    publish(feed(spark, 3), "model_view")
    first = publish(feed(spark, 3), "model_table", root)
    assert spark.table("model_view").count() == first.count() == 3
    assert known_rows(spark, "model_view") is None and known_rows(spark, "model_table") == 3
    publish(feed(spark, 5), "model_table", root)
    assert spark.table("model_table").count() == known_rows(spark, "model_table") == 5
    assert versions.read_version(spark, root, "model_table", 1).count() == 3
    with pytest.raises(ValueError):
        publish(feed(spark, 5).drop("value"), "model_table", root)
    spark.sql("DROP TABLE model_table")


def test_feature_store_round_trip(spark, panel, tmp_path):
    path = str(tmp_path / "fs")
    for by_series in (False, True):
        landing.write_feature_store(panel, path, by_series)
        assert landing.read_feature_store(spark, path).where("series = 'b'").count() == 44


def test_contract_check(spark):
    whole = spark.range(1).select(*[F.lit(1).alias(c) for c in bundle.REQUIRED])
    assert bundle.check_contract(whole) is whole
    assert bundle.check_contract(whole.drop("signal")) is None


def test_history_payload_and_data_through(spark, panel):
    h = bundle.history_payload(panel.where("series = 'a'"), "2022-01-01")
    row = h.first()
    assert row.urea_history.labels[0] == "Jan 2022" and len(row.natgas_history["values"]) == 8
    assert bundle.data_through(h).first().data_through == "2022-08"


def test_job_stops_at_the_first_failure():
    ran = []
    with pytest.raises(StepFailed, match="two failed after"):
        run_steps([("one", lambda: ran.append(1)), ("two", lambda: 1 / 0), ("three", lambda: ran.append(3))], say=lambda _: None)
    assert ran == [1]
