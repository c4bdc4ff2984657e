"""The whole chain on the small tables, from landing to the bundle file."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from conftest import rows_of

from nitrapanel.catalog import cases, jobs
from nitrapanel.models import boosted
from nitrapanel.operators import bundle
from nitrapanel.plans.refresh import STAGES, Run, StepFailed, published, refresh
from nitrapanel.sources import tables as t
from nitrapanel.sources import versions

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def registry(spark):
    f = t.lazy_feeds(spark, SF)
    return {name: (lambda df=df: df) for name, df in f._asdict().items()}


def run(spark, registry, root, **more):
    return refresh(spark, registry, root, None, t.HOLDOUT_START, t.SHOCK_START, t.HISTORY_START, iterations=1, say=lambda _: None, **more)


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_tables
def test_refresh_is_resumed_and_published_last(spark, registry, tmp_path):
    root, begun = str(tmp_path), []

    def stop(stage):
        begun.append(stage)
        if stage == "train":
            raise RuntimeError("stopped")

    with pytest.raises(StepFailed):
        run(spark, registry, root, before=stop)
    with pytest.raises(ValueError):
        published(spark, root)
    landed = versions.folder_of(spark, root, "daily")
    # Feeds that have changed meanwhile do not matter: the run goes on with what it has landed.
    empty = {name: (lambda get=get: get().limit(0)) for name, get in registry.items()}
    assert run(spark, empty, root, before=begun.append) == list(STAGES)
    assert begun == ["land", "stage", "features", "train", "train", "bundle"]
    done = published(spark, root)
    assert done.name == "000001" and done.folder_of("daily") == landed
    got = spark.read.json(done.folder_of("bundle"))
    assert got.count() == 5 and bundle.check_contract(got) is got
    row = got.select("forecast.months", "signal.signal", "monte_carlo.n_simulations", "model_metadata.cv_residual_std_t2").first()
    assert row.cv_residual_std_t2 > 0
    assert row.months == ["2001-08", "2001-09", "2001-10"] and row.n_simulations == 10_000
    saved = boosted.load_saved(spark, done.folder_of("models"))
    assert saved.facts["iterations"] == 1 and saved.metrics.count() > 0

    # The next call is a new run; while it is torn, readers keep the published one.
    with pytest.raises(StepFailed):
        run(spark, registry, root, before=lambda stage: 1 / (stage != "features"))
    assert published(spark, root).name == "000001" and versions.versions(spark, root, "panel") == [1, 2]
    assert done.read("panel").count() == versions.read_version(spark, root, "panel", 1).count()
    # Other settings do not go on with it.
    with pytest.raises(ValueError):
        refresh(spark, registry, root, "1999-01", iterations=1, say=lambda _: None, run="000002")
    with pytest.raises(StepFailed):
        run(spark, empty, root, run="000003")


def test_the_query_joins_the_raw_tables_once_for_all_feeds(spark, tmp_path, monkeypatch):
    # Keys repeat and are missing, as are days and prices.
    orders = [(k, p, 8e4 * (k or 1), dt.datetime(2000, 1, 1 + i)) for i, (k, p) in enumerate([(1, "a"), (2, "a"), (3, None), (3, "b"), (None, "b")])]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [
        (k, 5.0 + i, None if i == 4 else 100.0 * i, "FO"[i % 2], None if i == 7 else dt.datetime(2000, 1 + i % 3, 3 + i))
        for i, k in enumerate([1, 1, 2, 3, 3, None, 2, 1, 9])
    ]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    given, joined, ship_days = {}, [], t.ship_days

    class Stop(Exception):
        pass

    def only_land(spark, registry, *settings, **more):
        assert not joined
        given.update({name: get() for name, get in registry.items()})
        raise Stop

    monkeypatch.setattr(jobs.job, "refresh", only_land)
    monkeypatch.setattr(t, "ship_days", lambda *a: joined.append(a) or ship_days(*a))
    with pytest.raises(Stop):
        cases()["k37_refresh"].run(spark, str(tmp_path))
    assert len(joined) == 1 and set(given) == set(t.Feeds._fields)
    for name, want in t.lazy_feeds(spark, str(tmp_path))._asdict().items():
        assert not [f for f in given[name].inputFiles() if str(tmp_path) in f]
        assert given[name].schema == want.schema and rows_of(given[name], "series", "period") == rows_of(want, "series", "period")


def test_a_registry_must_be_whole(spark, tmp_path):
    with pytest.raises(ValueError):
        refresh(spark, {}, str(tmp_path))


def test_a_manifest_behind_a_gap_does_not_count(spark, tmp_path):
    own = Run(spark, str(tmp_path), "x")
    assert own.done() == [] and own.tables() == {}
    own.finish("stage", {"panel": 1})
    assert own.done() == []
    own.finish("land", {"daily": 3})
    assert own.done() == ["land", "stage"] and own.tables() == {"daily": 3, "panel": 1}
    with pytest.raises(RuntimeError):
        own.finish("land", {"daily": 4})
