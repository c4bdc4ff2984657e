"""Daily-derived monthly features and the feature store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import (
    DAILY_FEATURES,
    FEATURE_COLS,
    HORIZONS,
    KEY,
    MEASURES,
    MONTH,
    NG_LAGS,
    NG_MOMENTUM,
    NG_ROLLS,
    TARGET_COLS,
)
from nitrapanel.functions.clean import month_start, ratio
from nitrapanel.functions.windows import (
    by_series,
    change,
    expanding_zscore,
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_std,
    rolling_zscore,
)
from nitrapanel.operators.staging import observed

DAILY_WINDOWS = (30, 60, 90)


def daily_averages(daily: DataFrame) -> DataFrame:
    """Moving averages over the last 30/60/90 priced rows, half of them required.

    Frames count rows, so the feed holds one row per series and trading day.
    """
    w = by_series("period")
    price = F.col("value")
    return observed(daily, "period", "value").select(
        KEY,
        "period",
        "value",
        *[rolling_mean(price, w, n, at_least=n // 2).alias(f"ma{n}") for n in DAILY_WINDOWS],
    )


def daily_features(daily: DataFrame) -> DataFrame:
    """Month-end moving averages, their cross-overs and the within-month spread."""
    eom = {n: F.max_by(f"ma{n}", F.when(F.col(f"ma{n}").isNotNull(), F.col("period"))) for n in DAILY_WINDOWS}
    monthly = (
        daily_averages(daily)
        .groupBy(KEY, month_start(F.col("period")).alias(MONTH))
        .agg(
            *[agg.alias(f"ng_ma{n}_eom") for n, agg in eom.items()],
            F.stddev_samp("value").alias("ng_daily_vol_1m"),
        )
    )
    return monthly.select(
        KEY,
        MONTH,
        "ng_ma30_eom",
        "ng_ma60_eom",
        "ng_ma90_eom",
        (ratio(F.col("ng_ma30_eom"), F.col("ng_ma60_eom")) - 1).alias("ng_ma_cross_30_60"),
        (ratio(F.col("ng_ma30_eom"), F.col("ng_ma90_eom")) - 1).alias("ng_ma_cross_30_90"),
        "ng_daily_vol_1m",
    )


def _proxies(ng: Column, w) -> dict[str, Column]:
    """Monthly stand-ins used where no daily feed exists."""
    mean3, mean6 = rolling_mean(ng, w, 3), rolling_mean(ng, w, 6)
    cross = ratio(mean3, mean6) - 1
    return dict(zip(DAILY_FEATURES, (mean3, mean6, mean6, cross, cross, rolling_std(ng, w, 3))))


def feature_columns(with_daily: bool) -> dict[str, Column]:
    """Every feature and target as an expression over one window per series."""
    w = by_series()
    ng, urea, dap, storage = (F.col(c) for c in MEASURES)
    quarter = F.quarter(MONTH)
    out: dict[str, Column] = {}
    out |= {f"ng_lag{k}": F.lag(ng, k).over(w) for k in NG_LAGS}
    out |= {f"ng_rolling_mean_{n}m": rolling_mean(ng, w, n) for n in NG_ROLLS}
    out |= {f"ng_rolling_std_{n}m": rolling_std(ng, w, n) for n in NG_ROLLS}
    out |= {f"ng_mom_{k}m": change(ng, w, k) for k in NG_MOMENTUM}
    out |= {c: F.col(c) for c in DAILY_FEATURES} if with_daily else _proxies(ng, w)
    out |= {
        "urea_lag1": F.lag(urea, 1).over(w),
        "urea_rolling_mean_3m": rolling_mean(urea, w, 3),
        "urea_ng_ratio": ratio(urea, ng),
        "urea_mom_1m": change(urea, w, 1),
        "urea_mom_3m": change(urea, w, 3),
        "urea_zscore_12m": rolling_zscore(urea, w, 12),
        "urea_zscore_24m": rolling_zscore(urea, w, 24),
        "urea_vs_12m_high": ratio(urea, rolling_max(urea, w, 12)),
        "urea_vs_12m_low": ratio(urea, rolling_min(urea, w, 12)),
        "ng_zscore_12m": rolling_zscore(ng, w, 12),
        "dap_lag1": F.lag(dap, 1).over(w),
        "dap_urea_ratio": ratio(dap, urea),
        "storage_zscore": expanding_zscore(storage, w),
    }
    out |= {f"season_q{q}": (quarter == q).cast("int") for q in (1, 2, 3, 4)}
    out |= {f"target_urea_t{h}": F.lead(urea, h).over(w) for h in HORIZONS}
    return out


def build_features(panel: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Feature store over a gap-free panel: one shuffle and one sort by month.

    ``daily`` is the result of :func:`daily_features`; without it the monthly
    proxies are used. Rows lacking targets stay, they are the prediction rows.
    """
    base = panel if daily is None else panel.join(daily, [KEY, MONTH], "left")
    made = feature_columns(with_daily=daily is not None)
    named = {**{m: F.col(m) for m in MEASURES}, **made}
    wanted = [*FEATURE_COLS, "storage_mmcf", *TARGET_COLS]
    return base.select(KEY, MONTH, *[named[c].alias(c) for c in wanted])


def complete_rows(features: DataFrame, with_targets: bool) -> DataFrame:
    """Rows with all features, and all three targets where training needs them."""
    need = FEATURE_COLS + (TARGET_COLS if with_targets else [])
    return features.dropna(how="any", subset=need)


def latest_complete(features: DataFrame) -> DataFrame:
    """Newest month per series that has every feature."""
    rest = [c for c in features.columns if c != KEY]
    newest = complete_rows(features, False).groupBy(KEY).agg(F.max_by(F.struct(*rest), MONTH).alias("r"))
    return newest.select(KEY, "r.*")
