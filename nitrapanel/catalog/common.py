"""Common tables of the SQL side, and the frames of the Spark side they mirror."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from nitrapanel.catalog.base import cte
from nitrapanel.constants import FEATURE_COLS, TARGET_COLS
from nitrapanel.functions.draws import LOW_BITS, MODULUS, MULTIPLIER, ROUNDS, seed_words
from nitrapanel.models.baseline import holdout_predictions, labelled, latest_forecast
from nitrapanel.models.metrics import evaluate, residual_stats
from nitrapanel.operators.simulate import with_residuals
from nitrapanel.plans.forecast import features_from, panel_from, spine_panel
from nitrapanel.session import materialize
from nitrapanel.sources import tables as t

# Feeds -----------------------------------------------------------------------

cte(
    "spot_daily",
    f"""SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS period,
    avg(o_totalprice) / {t.SPOT_SCALE!r}e0 AS value FROM orders GROUP BY 1, 2""",
)
cte(
    "ship_days",
    """SELECT o_orderpriority AS series, CAST(l_shipdate AS DATE) AS period,
    sum(l_quantity) AS qty, sum(l_extendedprice) AS price_sum, count(l_extendedprice) AS price_n,
    sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS f_sum,
    count(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS f_n,
    sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS o_sum,
    count(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS o_n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
cte(
    "backbone",
    f"""SELECT series, CAST(date_trunc('month', period) AS DATE) AS period,
    sum(price_sum) / sum(price_n) / {t.BACKBONE_SCALE!r}e0 AS value FROM ship_days GROUP BY 1, 2""",
)
cte(
    "weekly",
    """SELECT series, CAST(date_trunc('week', period) AS DATE) AS period, sum(qty) AS value
    FROM ship_days GROUP BY 1, 2""",
)
cte(
    "storage_backbone",
    f"""SELECT series, CAST(date_trunc('month', period) AS DATE) AS period,
    sum(qty) * {t.STORAGE_MMCF_PER_UNIT!r}e0 AS value FROM ship_days GROUP BY 1, 2""",
)
cte(
    "sheet",
    f"""SELECT series, period, f_sum / nullif(f_n, 0) / {t.UREA_SCALE!r}e0 AS urea,
    o_sum / nullif(o_n, 0) / {t.DAP_SCALE!r}e0 AS dap FROM ship_days""",
)
cte(
    "quoted",
    f"""SELECT series, month,
    CASE WHEN f_n >= o_n THEN f_sum / nullif(f_n, 0) / {t.UREA_SCALE!r}e0 END AS urea,
    CASE WHEN o_n >= f_n THEN o_sum / nullif(o_n, 0) / {t.DAP_SCALE!r}e0 END AS dap
    FROM (SELECT series, CAST(date_trunc('month', period) AS DATE) AS month, sum(f_sum) AS f_sum,
          sum(f_n) AS f_n, sum(o_sum) AS o_sum, sum(o_n) AS o_n FROM ship_days GROUP BY 1, 2)""",
)

# Staging and panel -------------------------------------------------------------

cte(
    "live_ng",
    """SELECT series, CAST(date_trunc('month', period) AS DATE) AS month, avg(value) AS value
    FROM spot_daily WHERE period IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""",
)
cte(
    "live_storage",
    """SELECT series, month, value * 1000e0 AS value FROM (
      SELECT series, CAST(date_trunc('month', period) AS DATE) AS month, value,
        row_number() OVER (PARTITION BY series, date_trunc('month', period) ORDER BY period DESC) AS rn
      FROM weekly WHERE period IS NOT NULL AND value IS NOT NULL) WHERE rn = 1""",
)


def _priority(live: str, local: str) -> str:
    return f"""SELECT series, month, value FROM (
      SELECT series, month, value, row_number() OVER (PARTITION BY series, month ORDER BY pr) AS rn FROM (
        SELECT series, month, value, 1 AS pr FROM {live}
        UNION ALL
        SELECT series, CAST(date_trunc('month', period) AS DATE), value, 2 FROM {local}
        WHERE period IS NOT NULL AND value IS NOT NULL)) WHERE rn = 1"""


def _single(col: str) -> str:
    return f"""SELECT series, CAST(date_trunc('month', period) AS DATE) AS month, avg({col}) AS value
    FROM sheet WHERE period IS NOT NULL AND {col} IS NOT NULL GROUP BY 1, 2"""


cte("stg_ng", _priority("live_ng", "backbone"))
cte("stg_storage", _priority("live_storage", "storage_backbone"))
cte("stg_urea", _single("urea"))
cte("stg_dap", _single("dap"))
cte(
    "panel",
    """SELECT m.series, m.month, a.value AS ng_spot, b.value AS urea, c.value AS dap, d.value AS storage_mmcf
    FROM (SELECT series, month FROM stg_ng UNION SELECT series, month FROM stg_urea
          UNION SELECT series, month FROM stg_dap UNION SELECT series, month FROM stg_storage) m
    LEFT JOIN stg_ng a USING (series, month) LEFT JOIN stg_urea b USING (series, month)
    LEFT JOIN stg_dap c USING (series, month) LEFT JOIN stg_storage d USING (series, month)""",
)
cte(
    "spine",
    """SELECT k.series, k.month, ng_spot, urea, dap, storage_mmcf FROM (
      SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
      FROM (SELECT DISTINCT series FROM panel),
           (SELECT min(month) AS lo, max(month) FILTER (ng_spot IS NOT NULL OR urea IS NOT NULL
              OR dap IS NOT NULL OR storage_mmcf IS NOT NULL) AS hi FROM panel)) k
    LEFT JOIN panel p ON p.series = k.series AND p.month = k.month""",
)

# Features ----------------------------------------------------------------------


def full(c: str, agg: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER w{n} = {n} THEN {agg}({c}) OVER w{n} END"


def zscore(c: str, n: int) -> str:
    return f"({c} - ({full(c, 'avg', n)})) / nullif({full(c, 'stddev_samp', n)}, 0)"


def change(c: str, k: int) -> str:
    return f"{c} / nullif(lag({c}, {k}) OVER w, 0) - 1"


WINDOWS = "WINDOW w AS (PARTITION BY series ORDER BY month), " + ", ".join(
    f"w{n} AS (PARTITION BY series ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    for n in (3, 6, 12, 24)
)

cte(
    "daily_ma",
    "SELECT series, period, value, "
    + ", ".join(f"CASE WHEN count(value) OVER d{n} >= {n // 2} THEN avg(value) OVER d{n} END AS ma{n}" for n in (30, 60, 90))
    + " FROM spot_daily WHERE period IS NOT NULL AND value IS NOT NULL WINDOW "
    + ", ".join(
        f"d{n} AS (PARTITION BY series ORDER BY period ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in (30, 60, 90)
    ),
)
cte(
    "daily_feats",
    """SELECT *, ng_ma30_eom / nullif(ng_ma60_eom, 0) - 1 AS ng_ma_cross_30_60,
      ng_ma30_eom / nullif(ng_ma90_eom, 0) - 1 AS ng_ma_cross_30_90 FROM (
      SELECT series, CAST(date_trunc('month', period) AS DATE) AS month,
        arg_max(ma30, period) FILTER (ma30 IS NOT NULL) AS ng_ma30_eom,
        arg_max(ma60, period) FILTER (ma60 IS NOT NULL) AS ng_ma60_eom,
        arg_max(ma90, period) FILTER (ma90 IS NOT NULL) AS ng_ma90_eom,
        stddev_samp(value) AS ng_daily_vol_1m FROM daily_ma GROUP BY 1, 2)""",
)
FEATURE_SQL = {
    **{f"ng_lag{k}": f"lag(ng_spot, {k}) OVER w" for k in (1, 2, 3, 4, 5, 6, 9, 12)},
    **{f"ng_rolling_mean_{n}m": full("ng_spot", "avg", n) for n in (3, 6, 12)},
    **{f"ng_rolling_std_{n}m": full("ng_spot", "stddev_samp", n) for n in (3, 6, 12)},
    **{f"ng_mom_{k}m": change("ng_spot", k) for k in (1, 3, 6)},
    "urea_lag1": "lag(urea, 1) OVER w",
    "urea_rolling_mean_3m": full("urea", "avg", 3),
    "urea_ng_ratio": "urea / nullif(ng_spot, 0)",
    "urea_mom_1m": change("urea", 1),
    "urea_mom_3m": change("urea", 3),
    "urea_zscore_12m": zscore("urea", 12),
    "urea_zscore_24m": zscore("urea", 24),
    "urea_vs_12m_high": f"urea / nullif({full('urea', 'max', 12)}, 0)",
    "urea_vs_12m_low": f"urea / nullif({full('urea', 'min', 12)}, 0)",
    "ng_zscore_12m": zscore("ng_spot", 12),
    "dap_lag1": "lag(dap, 1) OVER w",
    "dap_urea_ratio": "dap / nullif(urea, 0)",
    "storage_zscore": "(storage_mmcf - avg(storage_mmcf) OVER w) / nullif(stddev_samp(storage_mmcf) OVER w, 0)",
    **{f"season_q{q}": f"CAST(quarter(month) = {q} AS INTEGER)" for q in (1, 2, 3, 4)},
    **{f"target_urea_t{h}": f"lead(urea, {h}) OVER w" for h in (1, 2, 3)},
}
cte(
    "features",
    "SELECT series, month, ng_spot, urea, dap, storage_mmcf, ng_ma30_eom, ng_ma60_eom, ng_ma90_eom, "
    "ng_ma_cross_30_60, ng_ma_cross_30_90, ng_daily_vol_1m, "
    + ", ".join(f"{e} AS {c}" for c, e in FEATURE_SQL.items())
    + f" FROM spine LEFT JOIN daily_feats USING (series, month) {WINDOWS}",
)
PROXY_FEATURES = (
    "SELECT series, month, ng_spot, urea, dap, "
    + ", ".join(f"{e} AS {c}" for c, e in FEATURE_SQL.items())
    + " FROM {source} "
    + WINDOWS
)
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLS)
TRAINABLE = COMPLETE + " AND " + " AND ".join(f"{c} IS NOT NULL" for c in TARGET_COLS)
cte(
    "latest",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS rn
    FROM features WHERE {COMPLETE}) WHERE rn = 1""",
)

# Split, baseline, metrics --------------------------------------------------------

cte(
    "by_horizon",
    "\nUNION ALL\n".join(
        f"""SELECT series, month, urea, {h} AS horizon, CAST(month + INTERVAL {h} MONTH AS DATE) AS target_month,
        target_urea_t{h} AS target, CAST(target_urea_t{h} > urea AS INTEGER) AS label
        FROM features WHERE {TRAINABLE}"""
        for h in (1, 2, 3)
    ),
)
cte(
    "split",
    f"""SELECT *, CASE WHEN target_month < DATE '{t.HOLDOUT_START}' THEN 'train'
      WHEN month >= DATE '{t.HOLDOUT_START}' THEN 'test' ELSE 'purged' END AS role FROM by_horizon""",
)


def weighted(source: str, where: str = "TRUE") -> str:
    return f"""SELECT *, 1e0 + 0.5e0 * coalesce(CAST(month - min(month) OVER k AS DOUBLE)
      / nullif(CAST(max(month) OVER k - min(month) OVER k AS DOUBLE), 0), 0) AS weight
      FROM {source} WHERE {where} WINDOW k AS (PARTITION BY series, horizon)"""


def line(source: str) -> str:
    return f"""SELECT series, horizon, any_value(x_mean) AS x_mean, any_value(y_mean) AS y_mean,
      coalesce(sum(weight * (urea - x_mean) * (target - y_mean))
        / nullif(sum(weight * (urea - x_mean) * (urea - x_mean)), 0), 0) AS slope
      FROM (SELECT *, sum(weight * urea) OVER k / sum(weight) OVER k AS x_mean,
              sum(weight * target) OVER k / sum(weight) OVER k AS y_mean
            FROM {source} WINDOW k AS (PARTITION BY series, horizon)) GROUP BY 1, 2"""


cte("train_rows", weighted("split", "role = 'train'"))
cte("train_line", line("train_rows"))
cte(
    "holdout",
    """SELECT *, CAST(pred > urea AS INTEGER) AS label_pred FROM (
      SELECT s.*, coalesce(y_mean + slope * (urea - x_mean), urea) AS pred
      FROM split s LEFT JOIN train_line USING (series, horizon) WHERE role = 'test')""",
)


def metrics(source: str, keys: str = "series", shock: str = t.SHOCK_START) -> str:
    return f"""SELECT {keys}, horizon, win AS bucket, count(*) AS n,
      sqrt(avg((target - pred) * (target - pred))) AS rmse, avg(abs(target - pred)) AS mae,
      coalesce(avg(CASE WHEN sign(target - urea) <> 0
        THEN CAST(sign(target - urea) = sign(pred - urea) AS DOUBLE) END), 0.5) AS dir_acc,
      avg(CAST(label = label_pred AS DOUBLE)) AS clf_acc,
      avg(target - pred) AS residual_mean, stddev_pop(target - pred) AS residual_std
      FROM (SELECT *, unnest(['full', CASE WHEN target_month >= DATE '{shock}' THEN 'shock' ELSE 'preshock' END]) AS win
            FROM {source}) GROUP BY {keys}, horizon, win"""


cte("holdout_metrics", metrics("holdout"))
cte(
    "residuals",
    """SELECT series, horizon, n, residual_mean, residual_std FROM holdout_metrics WHERE bucket = 'preshock'""",
)
cte(
    "pooled",
    """SELECT horizon, sum(n * residual_mean) / sum(n) AS pm, sqrt(greatest(sum(n * (residual_std * residual_std
      + residual_mean * residual_mean)) / sum(n) - pow(sum(n * residual_mean) / sum(n), 2), 0)) AS ps FROM residuals GROUP BY 1""",
)
cte("all_rows", weighted("by_horizon"))
cte("all_line", line("all_rows"))
cte(
    "forecast",
    """SELECT l.series, l.month, h.horizon, CAST(l.month + to_months(h.horizon) AS DATE) AS target_month,
      l.urea AS current, l.ng_spot, l.ng_mom_1m, coalesce(y_mean + slope * (l.urea - x_mean), l.urea) AS pred
      FROM latest l CROSS JOIN (SELECT unnest([1, 2, 3]) AS horizon) h
      LEFT JOIN all_line a ON a.series = l.series AND a.horizon = h.horizon""",
)

# Draws and simulation --------------------------------------------------------------


def _mix(s: str) -> str:
    """The mixing rounds; each value is bound to a name once."""
    for k in range(ROUNDS):
        s = f"list_transform([({s} * {MULTIPLIER} + 11) % {MODULUS}], lambda v{k}: xor(v{k}, v{k} >> 15))[1]"
    return s


def uniform(counter: str, seed: int) -> str:
    a, b, w = seed_words(seed)
    n = f"CAST({counter} AS BIGINT)"
    stride = f"({_mix(f'((({n} >> {LOW_BITS}) * {a} + {b}) % {MODULUS})')} % {MODULUS - 1} + 1)"
    s = _mix(f"((({n} & {(1 << LOW_BITS) - 1}) * {stride} + {w}) % {MODULUS})")
    return f"((({s} * {MULTIPLIER} + 11) % {MODULUS}) + 0.5e0) / {MODULUS}e0"


def normal(counter: str, seed: int) -> str:
    base = f"(CAST({counter} AS BIGINT) * 2)"
    return f"sqrt(-2e0 * ln({uniform(base, seed)})) * cos({2 * math.pi!r}e0 * ({uniform(base + ' + 1', seed)}))"


def draws(n: int = 10_000, seed: int = 42) -> str:
    return f"""SELECT path_id, stream, {normal('(path_id * 3 + stream - 1)', seed)} AS z FROM (
      SELECT unnest(range({n})) AS path_id), (SELECT unnest([1, 2, 3]) AS stream)"""


cte("draws", draws())
cte(
    "paths",
    """SELECT f.*, path_id, CASE WHEN pred + (residual_mean + residual_std * z) IS NOT NULL
        THEN least(greatest(pred + (residual_mean + residual_std * z), 100e0), 2000e0) END AS sim
      FROM (SELECT f.*, coalesce(r.residual_mean, p.pm) AS residual_mean, coalesce(r.residual_std, p.ps) AS residual_std
            FROM forecast f LEFT JOIN residuals r USING (series, horizon) LEFT JOIN pooled p USING (horizon)) f
      JOIN draws d ON d.stream = f.horizon""",
)
cte(
    "bands",
    """SELECT series, horizon, any_value(month) AS month, any_value(current) AS current,
      any_value(ng_spot) AS ng_spot, any_value(ng_mom_1m) AS ng_mom_1m, any_value(pred) AS pred,
      any_value(residual_std) AS residual_std, count(*) AS n_simulations, """
    + ", ".join(f"quantile_cont(sim, {q / 100}) AS p{q}" for q in (10, 25, 50, 75, 90))
    + """, avg(sim) AS mean, avg(CAST(sim > current AS DOUBLE)) AS prob_rising,
      avg(CAST(sim > current * 1.10e0 AS DOUBLE)) AS prob_10pct_increase,
      avg(CAST(sim > current * 1.20e0 AS DOUBLE)) AS prob_20pct_increase
      FROM paths GROUP BY series, horizon""",
)


def at(h: int, c: str, name: str | None = None) -> str:
    return f"max(CASE WHEN horizon = {h} THEN {c} END) AS {name or f'{c}_t{h}'}"


cte(
    "mc",
    "SELECT series, max(n_simulations) AS n_simulations, max(month) AS month, max(current) AS current, "
    "max(ng_spot) AS ng_spot, max(ng_mom_1m) AS ng_mom_1m, "
    + ", ".join(
        [at(h, "pred", f"t{h}") for h in (1, 2, 3)]
        + [at(h, "residual_std") for h in (1, 2, 3)]
        + [at(h, f"p{q}") for h in (1, 2) for q in (10, 25, 50, 75, 90)]
        + [at(3, f"p{q}") for q in (10, 50, 90)]
        + [at(2, c) for c in ("prob_rising", "prob_10pct_increase", "prob_20pct_increase")]
    )
    + " FROM bands GROUP BY series",
)

# Spark side ----------------------------------------------------------------------


def feeds(spark: SparkSession, sf_dir: str) -> t.Feeds:
    return t.landed_feeds(spark, sf_dir)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_from(feeds(spark, sf_dir))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine_panel(feeds(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_from(feeds(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(features(spark, sf_dir), "features")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(features(spark, sf_dir), t.HOLDOUT_START)


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout_predictions(labelled(stored_features(spark, sf_dir), t.HOLDOUT_START))


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast per series and horizon with its residual statistics."""
    f = stored_features(spark, sf_dir)
    metrics_ = evaluate(holdout_predictions(labelled(f, t.HOLDOUT_START)), t.SHOCK_START)
    return with_residuals(latest_forecast(f), residual_stats(metrics_))

# Farms and lead-lag pairs on the SQL side -------------------------------------------

cte(
    "farms",
    """SELECT c_custkey AS farm_id,
      CASE n_regionkey WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
        WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' END AS series,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 'Corn' WHEN 'BUILDING' THEN 'Wheat' WHEN 'AUTOMOBILE' THEN 'Cotton'
        WHEN 'FURNITURE' THEN 'Soybeans' WHEN 'HOUSEHOLD' THEN 'Barley' END AS crop_name,
      abs(c_acctbal) AS acres, CAST(c_nationkey * 4 AS DOUBLE) AS pre_pct
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
cte(
    "pairs",
    """SELECT series, month, urea, ng_spot, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS pos,
      count(*) OVER (PARTITION BY series) AS n FROM spine WHERE urea IS NOT NULL AND ng_spot IS NOT NULL""",
)
