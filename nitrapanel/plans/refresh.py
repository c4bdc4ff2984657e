"""The refresh job: land, stage, features, train, bundle; stops at the first failure.

Every stage writes new versions of its tables and, when all of them are there, commits a
manifest that names them; the stages after it read those versions.  The last step swaps
the pointer to the published run.  A run that stopped is never read; called again with
the same settings, it goes on at the first stage without a manifest, on the very tables
that its finished stages wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.constants import HOLDOUT_START, SHOCK_TARGET_START
from nitrapanel.functions.clean import iso_utc
from nitrapanel.models import boosted
from nitrapanel.models.metrics import residual_stats
from nitrapanel.operators.bundle import (
    HISTORY_START,
    build_bundle,
    history_payload,
    metadata_from_metrics,
    training_window,
    write_bundle,
)
from nitrapanel.operators.features import build_features, complete_rows, daily_features, latest_complete
from nitrapanel.operators.simulate import monte_carlo, with_residuals
from nitrapanel.operators.spine import reindex_months
from nitrapanel.plans.forecast import panel_from
from nitrapanel.sources import versions
from nitrapanel.sources.landing import land_all, read_feature_store, write_feature_store
from nitrapanel.sources.tables import Feeds

FEED_TABLES = Feeds._fields
STAGES = ("land", "stage", "features", "train", "bundle")
RUNS, PUBLISHED, SETTINGS = "runs", "published", "settings.json"


class StepFailed(RuntimeError):
    """A step of the job failed; the steps after it did not run."""


def run_steps(
    steps: list[tuple[str, Callable[[], object]]], say: Callable[[str], None] = print, done: list[str] | None = None
) -> list[str]:
    """Run the steps in order; those in ``done`` are passed over."""
    finished: list[str] = list(done or [])
    for name, step in steps:
        if name in finished:
            say(f"passed over {name}")
            continue
        say(f"starting {name}")
        try:
            step()
        except Exception as error:
            raise StepFailed(f"{name} failed after {finished or 'no finished step'}") from error
        finished.append(name)
        say(f"done {name}")
    return finished


class Run:
    """Manifests of one run: which versions each finished stage has written."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.folder = f"{self.root}/{RUNS}/{name}"

    def settings(self) -> dict | None:
        return versions.read_json(self.spark, f"{self.folder}/{SETTINGS}")

    def tables(self) -> dict[str, int]:
        """Versions that the stages up to the first unfinished one have written."""
        out: dict[str, int] = {}
        for stage in self.done():
            out |= versions.read_json(self.spark, f"{self.folder}/{stage}.json")["tables"]
        return out

    def done(self) -> list[str]:
        """Stages with a manifest; what comes after a gap does not count."""
        found = set(versions.names(self.spark, self.folder))
        return list(takewhile(lambda stage: f"{stage}.json" in found, STAGES))

    def finish(self, stage: str, tables: dict[str, int]) -> None:
        if not versions.commit(self.spark, f"{self.folder}/{stage}.json", {"tables": tables}):
            raise RuntimeError(f"{self.name}: another job has finished {stage}")

    def folder_of(self, table: str) -> str:
        return versions.folder_of(self.spark, self.root, table, self.tables()[table])

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.folder_of(table))


def open_run(spark: SparkSession, root: str, settings: dict, name: str | None = None) -> Run:
    """The named run, or the newest one if it is unfinished and has these settings, or a new one."""
    known = versions.names(spark, f"{root.rstrip('/')}/{RUNS}")
    if name is None and known:
        last = Run(spark, root, known[-1])
        if last.settings() == settings and last.name not in published_runs(spark, root):
            return last
    run = Run(spark, root, name or f"{len(known) + 1:06d}")
    if not versions.commit(spark, f"{run.folder}/{SETTINGS}", settings) and run.settings() != settings:
        raise ValueError(f"run {run.name} was started with other settings: {run.settings()}")
    return run


def published_runs(spark: SparkSession, root: str) -> list[str]:
    """Published runs, oldest first."""
    folder = f"{root.rstrip('/')}/{PUBLISHED}"
    return [versions.read_json(spark, f"{folder}/{n:08d}.json")["run"] for n in versions.numbers(spark, folder)]


def published(spark: SparkSession, root: str) -> Run:
    """The run that readers see."""
    found = published_runs(spark, root)
    if not found:
        raise ValueError(f"no published run below {root}")
    return Run(spark, root, found[-1])


def refresh(
    spark: SparkSession,
    registry: dict[str, Callable[[], DataFrame]],
    root: str,
    start: str | None = None,
    holdout_start: str = HOLDOUT_START,
    shock_start: str = SHOCK_TARGET_START,
    history_start: str = HISTORY_START,
    iterations: int = boosted.ITERATIONS,
    say: Callable[[str], None] = print,
    run: str | None = None,
    before: Callable[[str], None] = lambda stage: None,
) -> list[str]:
    """Run, or go on with, the whole chain below ``root``; ``before`` is called ahead of each stage that runs."""
    missing = set(FEED_TABLES) - set(registry)
    if missing:
        raise ValueError(f"registry lacks {sorted(missing)}")
    told = {"start": start, "holdout_start": holdout_start, "shock_start": shock_start, "history_start": history_start, "iterations": iterations}
    own = open_run(spark, root, told, run)
    base = own.root

    def write(df: DataFrame, table: str) -> int:
        return versions.write_version(df, base, table, {"run": own.name})

    def feeds() -> Feeds:
        return Feeds(*[own.read(name) for name in FEED_TABLES])

    def land() -> dict[str, int]:
        land_all({name: registry[name] for name in FEED_TABLES}, base).collect()
        return {name: versions.versions(spark, base, name)[-1] for name in FEED_TABLES}

    def stage() -> dict[str, int]:
        # Stored first: the reindexing reads the panel for its range, its keys and its rows.
        rows = write(panel_from(feeds()), "panel_rows")
        stored = versions.read_version(spark, base, "panel_rows", rows)
        return {"panel_rows": rows, "panel": write(reindex_months(stored, start, shared=True), "panel")}

    def make_features() -> dict[str, int]:
        folder = versions.new_folder(base, "feature_store")
        write_feature_store(build_features(own.read("panel"), daily_features(feeds().daily)), folder)
        return {"feature_store": versions.publish_folder(spark, base, "feature_store", folder, {"run": own.name})}

    def train() -> dict[str, int]:
        features = read_feature_store(spark, own.folder_of("feature_store"))
        result = boosted.train(features, holdout_start, shock_start, iterations)
        made = {"metrics": write(result.metrics, "metrics"), "cv_residuals": write(result.cv, "cv_residuals")}
        folder = versions.new_folder(base, "models")
        boosted.save(result.models, folder, {**told, **boosted.window_facts(features, holdout_start, shock_start)}, versions.read_version(spark, base, "metrics", made["metrics"]))
        return {**made, "models": versions.publish_folder(spark, base, "models", folder, {"run": own.name})}

    def bundle() -> dict[str, int]:
        features = read_feature_store(spark, own.folder_of("feature_store"))
        metrics = own.read("metrics")
        point = boosted.predict(boosted.load(spark, own.folder_of("models")), latest_complete(features))
        mc = monte_carlo(with_residuals(boosted.forecast_long(point), residual_stats(metrics)))
        facts = metadata_from_metrics(
            metrics,
            training_window(complete_rows(features, True), holdout_start, shock_start),
            own.read("cv_residuals"),
        )
        made = build_bundle(
            mc, history_payload(own.read("panel"), history_start), facts, iso_utc(F.current_timestamp())
        )
        folder = versions.new_folder(base, "bundle")
        write_bundle(made, folder)
        return {"bundle": versions.publish_folder(spark, base, "bundle", folder, {"run": own.name})}

    def kept(name: str, step: Callable[[], dict[str, int]]) -> Callable[[], None]:
        def run_stage() -> None:
            before(name)
            own.finish(name, step())

        return run_stage

    steps = {"land": land, "stage": stage, "features": make_features, "train": train, "bundle": bundle}
    out = run_steps([(name, kept(name, steps[name])) for name in STAGES], say, own.done())
    if own.name not in published_runs(spark, base):
        versions.append(spark, f"{base}/{PUBLISHED}", {"run": own.name, "tables": own.tables()})
    return out
