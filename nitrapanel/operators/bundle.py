"""The published bundle: one nested row per series and its sub-views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import HORIZONS, KEY, MONTH
from nitrapanel.functions.clean import label_month, month_iso, month_label, months_after
from nitrapanel.operators.signal import generate_signal

HISTORY_START = "2018-01-01"
REQUIRED = ("signal", "monte_carlo", "forecast", "model_metadata")


def history_rows(panel: DataFrame, start: str = HISTORY_START) -> DataFrame:
    """Months from ``start`` where both gas and urea hold a value, rounded for display."""
    return (
        panel.where(F.col(MONTH) >= F.lit(start).cast("date"))
        .dropna(subset=["ng_spot", "urea"])
        .select(KEY, MONTH, F.round("urea", 2).alias("urea"), F.round("ng_spot", 3).alias("ng_spot"))
    )


def history_payload(panel: DataFrame, start: str = HISTORY_START) -> DataFrame:
    """Ordered label and value arrays per series."""
    rows = F.sort_array(F.collect_list(F.struct(MONTH, "urea", "ng_spot")))
    packed = history_rows(panel, start).groupBy(KEY).agg(rows.alias("h"))

    def series(c: str) -> Column:
        return F.struct(
            F.transform("h", lambda r: month_label(r[MONTH])).alias("labels"),
            F.transform("h", lambda r: r[c]).alias("values"),
        )

    return packed.select(KEY, series("urea").alias("urea_history"), series("ng_spot").alias("natgas_history"))


def forecast_months(as_of: Column) -> dict[str, Column]:
    ahead = [months_after(as_of, h) for h in HORIZONS]
    return {"labels": F.array(*[month_label(m) for m in ahead]), "months": F.array(*[month_iso(m) for m in ahead])}


def forecast_band(mc: DataFrame) -> DataFrame:
    """Labels, ISO months and the rounded p50/p10/p90 of the three horizons."""
    ahead = forecast_months(F.col(MONTH))

    def line(p: int) -> Column:
        return F.array(*[F.round(f"p{p}_t{h}", 1) for h in HORIZONS])

    return mc.select(
        KEY,
        F.struct(
            ahead["labels"].alias("labels"),
            ahead["months"].alias("months"),
            line(50).alias("mean"),
            line(10).alias("low"),
            line(90).alias("high"),
        ).alias("forecast"),
    )


def data_through(history: DataFrame) -> DataFrame:
    """Newest month named by the last label of either history, else the as-of month."""

    def newest(c: str) -> Column:
        labels = F.col(f"{c}.labels")
        return label_month(F.try_element_at(labels, F.lit(-1)))

    through = month_iso(F.greatest(newest("urea_history"), newest("natgas_history")))
    if "as_of_date" in history.columns:
        through = F.coalesce(through, F.col("as_of_date"))
    return history.select(KEY, through.alias("data_through"))


STATS = [
    *(f"p{p}_t{h}" for h in (1, 2) for p in (10, 25, 50, 75, 90)),
    *(f"p{p}_t3" for p in (10, 50, 90)),
    "prob_rising_t2",
    "prob_10pct_increase_t2",
    "prob_20pct_increase_t2",
]


def build_bundle(mc: DataFrame, history: DataFrame, metadata: DataFrame, generated_at: Column) -> DataFrame:
    """One row per series; ``mc`` is the wide Monte Carlo frame."""
    signal = generate_signal(mc)
    parts = [c for c in signal.columns if c != KEY]
    facts = [c for c in metadata.columns if c != KEY]
    head = mc.select(
        KEY,
        month_iso(F.col(MONTH)).alias("as_of_date"),
        F.struct("n_simulations", *STATS).alias("monte_carlo"),
        "sim_t2_distribution",
    )
    return (
        head.join(history, KEY, "left")
        .join(forecast_band(mc), KEY)
        .join(signal.select(KEY, F.struct(*parts).alias("signal")), KEY)
        .join(metadata.select(KEY, F.struct(*facts).alias("model_metadata")), KEY, "left")
        .select(
            KEY,
            F.lit(1).alias("schema_version"),
            generated_at.alias("generated_at"),
            "as_of_date",
            "urea_history",
            "natgas_history",
            "forecast",
            "signal",
            "monte_carlo",
            "sim_t2_distribution",
            "model_metadata",
        )
    )


def summary_view(bundle: DataFrame) -> DataFrame:
    return bundle.select(KEY, "schema_version", "generated_at", "as_of_date", "forecast", "signal")


def history_view(bundle: DataFrame, commodity: str) -> DataFrame:
    column = {"urea": "urea_history", "natgas": "natgas_history"}[commodity]
    return bundle.select(KEY, f"{column}.labels", f"{column}.values")


def monte_carlo_view(bundle: DataFrame) -> DataFrame:
    return bundle.select(KEY, "monte_carlo", "sim_t2_distribution")


WINDOW_SUFFIX = {"preshock": "", "full": "_full", "shock": "_shock"}
HOLDOUT_METRICS = ("rmse", "mae", "dir_acc", "clf_acc")


def metadata_from_metrics(metrics: DataFrame, training: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """One row per series: training window plus every metric per window and horizon.

    Pre-shock metrics carry the plain name; shock metrics are NULL without shock rows.
    ``cv`` adds the residual statistics of the walk-forward folds.
    """

    def at(window: str, h: int, c: str) -> Column:
        return F.max(F.when((F.col("bucket") == window) & (F.col("horizon") == h), F.col(c)))

    aggs = []
    for h in HORIZONS:
        for window, suffix in WINDOW_SUFFIX.items():
            aggs += [at(window, h, m).alias(f"test_{m}{suffix}_t{h}") for m in HOLDOUT_METRICS]
        aggs += [at("preshock", h, m).alias(f"{m}_t{h}") for m in ("residual_mean", "residual_std")]
        for window in ("preshock", "shock"):
            aggs.append(F.coalesce(at(window, h, "n"), F.lit(0)).alias(f"n_test_{window}_t{h}"))
    out = training.join(metrics.groupBy(KEY).agg(*aggs), KEY, "left")
    if cv is None:
        return out
    folds = [
        F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_t{h}")
        for h in HORIZONS
        for c in ("cv_residual_mean", "cv_residual_std")
    ]
    return out.join(cv.groupBy(KEY).agg(*folds), KEY, "left")


def training_window(rows: DataFrame, holdout_start: str, shock_start: str) -> DataFrame:
    """First trainable month and the nominal boundaries of the evaluation."""
    start = F.lit(holdout_start).cast("date")
    return rows.groupBy(KEY).agg(
        month_iso(F.min(MONTH)).alias("training_window_start"),
        month_iso(F.max(MONTH)).alias("holdout_end"),
    ).select(
        KEY,
        "training_window_start",
        month_iso(months_after(start, -1)).alias("training_window_end"),
        month_iso(start).alias("holdout_start"),
        "holdout_end",
        month_iso(F.lit(shock_start).cast("date")).alias("shock_target_start"),
    )


def check_contract(bundle: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame | None:
    """The bundle, or None ("unavailable") when a required top-level key is absent."""
    return None if set(required) - set(bundle.columns) else bundle


def to_documents(bundle: DataFrame) -> DataFrame:
    """One JSON document per series."""
    return bundle.select(KEY, F.to_json(F.struct(*bundle.columns)).alias("value"))


def write_bundle(bundle: DataFrame, path: str) -> None:
    to_documents(bundle).select("value").write.mode("overwrite").text(path)
