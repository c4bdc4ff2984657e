"""Panel to bundle: the plan behind the published forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import DRAWS, HOLDOUT_START, SEED, SHOCK_TARGET_START
from nitrapanel.functions.clean import iso_utc
from nitrapanel.models import boosted
from nitrapanel.models.baseline import holdout_predictions, labelled, latest_forecast
from nitrapanel.models.metrics import evaluate, residual_stats
from nitrapanel.operators.bundle import (
    HISTORY_START,
    build_bundle,
    history_payload,
    metadata_from_metrics,
    training_window,
)
from nitrapanel.operators.features import build_features, complete_rows, daily_features, latest_complete
from nitrapanel.operators.signal import generate_signal
from nitrapanel.operators.simulate import monte_carlo, with_residuals
from nitrapanel.operators.spine import reindex_months
from nitrapanel.operators.staging import build_panel, stage_single, stage_spot, stage_storage
from nitrapanel.session import materialize
from nitrapanel.sources.tables import Feeds


def panel_from(feeds: Feeds) -> DataFrame:
    """Priority-merged monthly panel of all measures."""
    return build_panel(
        stage_spot(feeds.daily, feeds.backbone),
        stage_single(feeds.sheet, "urea"),
        stage_single(feeds.sheet, "dap"),
        stage_storage(feeds.weekly_bcf, feeds.storage_backbone),
    )


def spine_panel(feeds: Feeds, start: str | None = None, end: str | None = None) -> DataFrame:
    """Gap-free panel over one month range shared by all series."""
    return reindex_months(materialize(panel_from(feeds), "panel"), start, end, shared=True)


def features_from(feeds: Feeds, start: str | None = None, end: str | None = None) -> DataFrame:
    return build_features(spine_panel(feeds, start, end), daily_features(feeds.daily))


def baseline_metrics(
    features: DataFrame, holdout_start: str = HOLDOUT_START, shock_start: str = SHOCK_TARGET_START
) -> DataFrame:
    return evaluate(holdout_predictions(labelled(features, holdout_start)), shock_start)


def simulated(
    features: DataFrame,
    holdout_start: str = HOLDOUT_START,
    shock_start: str = SHOCK_TARGET_START,
    n: int = DRAWS,
    seed: int = SEED,
) -> DataFrame:
    """Wide Monte Carlo row per series from the baseline forecast of the as-of row."""
    residuals = residual_stats(baseline_metrics(features, holdout_start, shock_start))
    return monte_carlo(with_residuals(latest_forecast(features), residuals), n, seed)


def signals(features: DataFrame, holdout_start: str, shock_start: str) -> DataFrame:
    return generate_signal(simulated(features, holdout_start, shock_start))


def tree_bundle_from(
    panel: DataFrame,
    features: DataFrame,
    generated_at: Column | None = None,
    holdout_start: str = HOLDOUT_START,
    shock_start: str = SHOCK_TARGET_START,
    history_start: str = HISTORY_START,
    iterations: int = boosted.ITERATIONS,
) -> DataFrame:
    """Bundle per series from the boosted trees: their forecasts, holdout residuals and metrics."""
    trained = boosted.train(features, holdout_start, shock_start, iterations)
    metrics = materialize(trained.metrics, "metrics")
    point = boosted.forecast_long(boosted.predict(trained.models, latest_complete(features)))
    mc = monte_carlo(with_residuals(materialize(point, "point"), residual_stats(metrics)))
    window = training_window(complete_rows(features, True), holdout_start, shock_start)
    written = iso_utc(F.current_timestamp() if generated_at is None else generated_at)
    facts = metadata_from_metrics(metrics, window, trained.cv)
    return build_bundle(materialize(mc, "monte_carlo"), history_payload(panel, history_start), facts, written)


def bundle_from(
    panel: DataFrame,
    features: DataFrame,
    generated_at: Column | None = None,
    holdout_start: str = HOLDOUT_START,
    shock_start: str = SHOCK_TARGET_START,
    history_start: str = HISTORY_START,
) -> DataFrame:
    """Bundle per series; panel and features are stored tables by now."""
    metrics = materialize(baseline_metrics(features, holdout_start, shock_start), "metrics")
    mc = monte_carlo(with_residuals(latest_forecast(features), residual_stats(metrics)))
    trained = training_window(complete_rows(features, True), holdout_start, shock_start)
    written = iso_utc(F.current_timestamp() if generated_at is None else generated_at)
    return build_bundle(
        materialize(mc, "monte_carlo"), history_payload(panel, history_start), metadata_from_metrics(metrics, trained), written
    )
