"""Aggregations: monthly reductions, percentiles, metrics, farm totals, lead-lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.catalog import common as c
from nitrapanel.catalog.base import case, cte
from nitrapanel.catalog.sources_and_rows import N_LBS
from nitrapanel.constants import KEY, MEASURES, MONTH
from nitrapanel.functions.draws import path_normal
from nitrapanel.functions.stats import direction_accuracy, hit_rate, mae, rmse
from nitrapanel.models.metrics import evaluate, seed_spread
from nitrapanel.models.splits import direction
from nitrapanel.operators import farm, lag, quality, staging
from nitrapanel.operators.bundle import data_through, history_payload
from nitrapanel.operators.simulate import bands, histogram, monte_carlo
from nitrapanel.sources import landing
from nitrapanel.sources import tables as t

PRICE = 437.0

case(
    "a01_monthly_mean",
    lambda s, sf: staging.monthly_mean(t.order_days(s, sf)),
    "SELECT * FROM live_ng",
    keep="series month",
    nums="value",
)
case(
    "a02_dedupe_mean",
    lambda s, sf: staging.stage_single(t.sheet_of(t.ship_days(s, sf)), "dap"),
    "SELECT * FROM stg_dap",
    keep="series month",
    nums="value",
)
case(
    "a03_period_mean",
    lambda s, sf: staging.period_mean(
        t.table(s, sf, "orders").select(
            F.col("o_orderpriority").alias(KEY),
            t.day("o_orderdate").alias("period"),
            (F.col("o_totalprice") / t.SPOT_SCALE).alias("value"),
        )
    ),
    f"""SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS period,
        avg(o_totalprice / {t.SPOT_SCALE!r}e0) AS value FROM orders GROUP BY 1, 2""",
    keep="series period",
    nums="value",
)
case(
    "a04_last_in_month",
    lambda s, sf: staging.monthly_last(t.weekly_of(t.ship_days(s, sf))),
    "SELECT series, month, value / 1000e0 AS value FROM live_storage",
    keep="series month",
    nums="value",
)
case(
    "a05_first_by_priority",
    lambda s, sf: staging.stage_spot(t.order_days(s, sf), t.backbone_of(t.ship_days(s, sf))),
    "SELECT * FROM stg_ng",
    keep="series month",
    nums="value",
)
case(
    "a06_daily_volatility",
    lambda s, sf: t.order_days(s, sf)
    .groupBy(KEY, F.trunc("period", "MM").alias(MONTH))
    .agg(F.stddev_samp("value").alias("vol")),
    """SELECT series, CAST(date_trunc('month', period) AS DATE) AS month, stddev_samp(value) AS vol
       FROM spot_daily GROUP BY 1, 2""",
    keep="series month",
    nums="vol",
)
case(
    "a07_column_counts",
    lambda s, sf: landing.column_counts(c.spine(s, sf), MEASURES),
    "SELECT count(*) AS n_rows, " + ", ".join(f"count({m}) AS n_{m}" for m in MEASURES) + " FROM spine",
    ints="n_rows " + " ".join(f"n_{m}" for m in MEASURES),
)
case(
    "a08_exact_percentiles",
    lambda s, sf: bands(c.forecast_rows(s, sf)),
    "SELECT * FROM bands",
    keep="series",
    ints="horizon n_simulations",
    nums="p10 p25 p50 p75 p90",
    digits=5,
)
case(
    "a09_chance_above",
    lambda s, sf: bands(c.forecast_rows(s, sf)),
    "SELECT * FROM bands",
    keep="series",
    ints="horizon",
    nums="prob_rising prob_10pct_increase prob_20pct_increase",
)


def _by_horizon(df: DataFrame, **aggs) -> DataFrame:
    return df.groupBy(KEY, "horizon").agg(*[v.alias(k) for k, v in aggs.items()])


case(
    "a10_error_metrics",
    lambda s, sf: _by_horizon(
        c.holdout(s, sf),
        rmse=rmse(F.col("target"), F.col("pred")),
        mae=mae(F.col("target"), F.col("pred")),
        residual_mean=F.avg(F.col("target") - F.col("pred")),
        residual_std=F.stddev_pop(F.col("target") - F.col("pred")),
    ),
    "SELECT * FROM holdout_metrics WHERE bucket = 'full'",
    keep="series",
    ints="horizon",
    nums="rmse mae residual_mean residual_std",
    digits=5,
)
case(
    "a11_direction_accuracy",
    lambda s, sf: _by_horizon(
        c.holdout(s, sf), dir_acc=direction_accuracy(F.col("target"), F.col("pred"), F.col("urea"))
    ),
    "SELECT * FROM holdout_metrics WHERE bucket = 'full'",
    keep="series",
    ints="horizon",
    nums="dir_acc",
)
case(
    "a12_label_accuracy",
    lambda s, sf: _by_horizon(c.holdout(s, sf), clf_acc=hit_rate(F.col("label"), F.col("label_pred"))),
    "SELECT * FROM holdout_metrics WHERE bucket = 'full'",
    keep="series",
    ints="horizon",
    nums="clf_acc",
)
case(
    "a13_window_metrics",
    lambda s, sf: evaluate(c.holdout(s, sf), t.SHOCK_START),
    "SELECT * FROM holdout_metrics",
    keep="series bucket",
    ints="horizon n",
    nums="rmse mae dir_acc clf_acc residual_mean residual_std",
    digits=5,
)

SEEDS = 5


def per_seed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-shock metrics per seed of jittered holdout predictions."""
    month_no = F.year(MONTH) * 12 + F.month(MONTH)
    jitter = path_normal(month_no * SEEDS + F.col("seed"), F.col("horizon"), 7) * F.lit(5.0)
    noisy = (
        c.holdout(spark, sf)
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
        .withColumn("pred", F.col("pred") + jitter)
        .withColumn("label_pred", direction(F.col("pred"), F.col("urea")))
    )
    return evaluate(noisy, t.SHOCK_START, keys=[KEY, "seed"]).where("bucket = 'preshock'")


cte(
    "noisy",
    f"""SELECT * EXCLUDE (p0), CAST(p0 > urea AS INTEGER) AS label_pred, p0 AS pred FROM (
      SELECT * EXCLUDE (pred, label_pred), pred + 5e0 * ({c.normal(f'(((year(month) * 12 + month(month)) * {SEEDS} + seed) * 3 + horizon - 1)', 7)}) AS p0
      FROM holdout CROSS JOIN (SELECT unnest(range({SEEDS})) AS seed))""",
)
cte("seed_metrics", c.metrics("noisy", "series, seed"))
SPREAD = [f"{m}_{s}" for m in ("rmse", "dir_acc", "clf_acc") for s in ("mean", "std", "min", "max")]
SPREAD_SQL = "SELECT series, horizon, count(*) AS n_seeds, " + ", ".join(
    f"{fn}({m}) AS {m}_{name}"
    for m in ("rmse", "dir_acc", "clf_acc")
    for name, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
) + " FROM seed_metrics WHERE bucket = 'preshock' GROUP BY 1, 2"
case(
    "a14_seed_spread",
    lambda s, sf: seed_spread(per_seed_metrics(s, sf)),
    SPREAD_SQL,
    keep="series",
    ints="horizon n_seeds",
    nums=" ".join(SPREAD),
    digits=5,
)

# Farms ---------------------------------------------------------------------------

cte(
    "crop_log",
    """SELECT user_id, CASE WHEN event_type = 'click' THEN lower(crop) ELSE crop END AS crop_name,
      CASE WHEN (k // 6) % 2 = 0 THEN 'Spring' ELSE 'Fall' END AS season, year(ts) AS year,
      row_number() OVER (ORDER BY ts, event_id) AS seq,
      CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'add' END AS action, value AS acres
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              ['Corn', 'Wheat', 'Cotton', 'Sorghum', 'Soybeans', 'Rice']
                [CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 + 1] AS crop
            FROM events WHERE event_type <> 'signup')""",
)
# Row by row: a new life of the row starts at the first add after a delete; in a life
# the last set and the adds after it give the acres.
cte(
    "crop_lives",
    """SELECT *, count(CASE WHEN action = 'delete' THEN 1 END) OVER (PARTITION BY user_id, lower(crop_name), season, year
        ORDER BY seq) AS life FROM crop_log""",
)
cte(
    "crop_sets",
    """SELECT *, count(CASE WHEN action = 'set' AND born IS NOT NULL AND seq > born THEN 1 END) OVER (
        PARTITION BY user_id, lower(crop_name), season, year, life ORDER BY seq) AS sets FROM (
      SELECT *, min(CASE WHEN action = 'add' THEN seq END) OVER (
        PARTITION BY user_id, lower(crop_name), season, year, life) AS born,
        max(life) OVER (PARTITION BY user_id, lower(crop_name), season, year) AS last_life FROM crop_lives)
      WHERE life = last_life AND born IS NOT NULL AND seq >= born""",
)
cte(
    "crop_state",
    """SELECT user_id, any_value(first_name) AS crop_name, season, year, sum(acres) AS acres, any_value(born) AS created FROM (
      SELECT *, max(sets) OVER k AS last_sets, max(CASE WHEN seq = born THEN crop_name END) OVER k AS first_name
      FROM crop_sets WINDOW k AS (PARTITION BY user_id, lower(crop_name), season, year))
      WHERE sets = last_sets AND action IN ('add', 'set') GROUP BY user_id, lower(crop_name), season, year""",
)


def crops(spark: SparkSession, sf: str) -> DataFrame:
    return farm.crop_state(t.crop_log(spark, sf))


LB_COST = f"({PRICE}e0 / 2204.6e0 / 0.46e0)"
case(
    "a16_crop_state",
    crops,
    "SELECT * FROM crop_state",
    keep="crop_name season",
    ints="user_id year",
    nums="acres",
)
cte(
    "farm_totals",
    f"""SELECT user_id, sum(coalesce({N_LBS}, 100) * acres) AS fertilizer_used_lbs,
      sum(coalesce({N_LBS}, 100) * acres * {LB_COST}) AS fertilizer_cost_usd, sum(acres) AS total_acres,
      count(DISTINCT crop_name) AS n_crops,
      CASE WHEN sum(acres) > 0 THEN sum(coalesce({N_LBS}, 100) * acres * {LB_COST}) / sum(acres) ELSE 0 END AS cost_per_acre
      FROM crop_state GROUP BY 1""",
)
case(
    "a15_fertilizer_totals",
    lambda s, sf: farm.fertilizer_totals(crops(s, sf), F.lit(PRICE)),
    "SELECT * FROM farm_totals",
    ints="user_id n_crops",
    nums="fertilizer_used_lbs fertilizer_cost_usd total_acres cost_per_acre",
)
cte(
    "crop_costs",
    f"""SELECT user_id, crop_name, cost, created, coalesce(cost / nullif(sum(cost) OVER (PARTITION BY user_id), 0), 0) * 100 AS cost_pct
      FROM (SELECT user_id, crop_name, sum(coalesce({N_LBS}, 100) * acres * {LB_COST}) AS cost, min(created) AS created
        FROM crop_state GROUP BY 1, 2)""",
)
case(
    "a17_crop_cost_share",
    lambda s, sf: farm.crop_costs(crops(s, sf), F.lit(PRICE)),
    "SELECT * FROM crop_costs",
    keep="crop_name",
    ints="user_id",
    nums="cost cost_pct",
)
cte(
    "crop_cards",
    f"""SELECT a.user_id, a.crop_name AS top_crop, a.cost AS top_cost, a.cost_pct AS top_pct,
      b.crop_name AS top_n_crop, b.n_lbs AS top_n_lbs
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost DESC, created) AS rn FROM crop_costs) a
      JOIN (SELECT user_id, crop_name, coalesce({N_LBS}, 0) AS n_lbs,
              row_number() OVER (PARTITION BY user_id ORDER BY coalesce({N_LBS}, 0) DESC, created) AS rn FROM crop_costs) b
      ON a.user_id = b.user_id AND a.rn = 1 AND b.rn = 1""",
)
case(
    "a18_arg_max_cards",
    lambda s, sf: farm.farm_summary(crops(s, sf), F.lit(PRICE)),
    "SELECT * FROM crop_cards",
    keep="top_crop top_n_crop",
    ints="user_id",
    nums="top_cost top_pct top_n_lbs",
)

# Lead-lag ------------------------------------------------------------------------

cte(
    "ccf",
    """SELECT a.series, k AS lag, corr(a.urea, b.ng_spot) AS r FROM pairs a
      CROSS JOIN (SELECT unnest(range(13)) AS k)
      JOIN pairs b ON b.series = a.series AND b.pos = a.pos - k GROUP BY 1, 2""",
)
cte(
    "peak",
    """SELECT series, lag AS peak_lag, r AS peak_r FROM (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY r DESC, lag) AS rn FROM ccf) WHERE rn = 1""",
)
cte(
    "corr_blocks",
    """SELECT a.series, start, corr(a.urea, b.ng_spot) AS r,
      any_value(year(s.month)) AS start_year FROM pairs a JOIN peak USING (series)
      CROSS JOIN (SELECT unnest(range(0, 1200, 12)) AS start)
      JOIN pairs s ON s.series = a.series AND s.pos = start
      LEFT JOIN pairs b ON b.series = a.series AND b.pos = a.pos - peak_lag
      WHERE a.pos BETWEEN start AND start + 35 AND start < a.n - 36 GROUP BY 1, 2""",
)
case(
    "a19_lag_correlation",
    lambda s, sf: lag.cross_correlation(lag.aligned(c.spine(s, sf))),
    "SELECT * FROM ccf",
    keep="series",
    ints="lag",
    nums="r",
)
case(
    "a20_block_correlation",
    lambda s, sf: lag.rolling_corr(c.spine(s, sf)),
    """SELECT *, CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate'
       WHEN r IS NOT NULL THEN 'Weak' END AS strength FROM corr_blocks""",
    keep="series strength",
    ints="start start_year",
    nums="r",
)
# Lag one in closed form: residual sums of y on y1, and of y on y1 and x1, from
# centred second moments.
GRANGER_ONE = """SELECT series, 1 AS lag, ((rss_r - rss_u) / 1) / (rss_u / (n - 3)) AS f_stat, n - 3 AS df_denom FROM (
  SELECT series, n, syy - s1y * s1y / s11 AS rss_r,
    syy - (s1y * (s1y * sxx - sxy * s1x) + sxy * (sxy * s11 - s1y * s1x)) / (s11 * sxx - s1x * s1x) AS rss_u
  FROM (SELECT a.series, count(*) AS n, regr_syy(a.urea, b.urea) AS syy, regr_sxx(a.urea, b.urea) AS s11,
      regr_sxx(a.urea, b.ng_spot) AS sxx, regr_sxy(a.urea, b.urea) AS s1y, regr_sxy(a.urea, b.ng_spot) AS sxy,
      regr_sxy(b.urea, b.ng_spot) AS s1x
    FROM pairs a JOIN pairs b ON b.series = a.series AND b.pos = a.pos - 1 GROUP BY 1))"""
case(
    "a21_granger_lag_one",
    lambda s, sf: lag.granger(c.spine(s, sf), max_lag=1),
    GRANGER_ONE,
    keep="series",
    ints="lag df_denom",
    nums="f_stat",
)
cte(
    "t2_sample",
    "SELECT series, sim AS x, min(sim) OVER (PARTITION BY series) AS lo, max(sim) OVER (PARTITION BY series) AS hi "
    "FROM paths WHERE horizon = 2 AND path_id % 10 = 0",
)
case(
    "a22_histogram",
    lambda s, sf: histogram(monte_carlo(c.forecast_rows(s, sf))),
    """SELECT series, bin, count(*) AS n FROM (
       SELECT series, CASE WHEN lo = hi THEN 1 ELSE least(floor(60 * (x - lo) / (hi - lo)) + 1, 60) END AS bin FROM t2_sample)
       GROUP BY 1, 2""",
    keep="series",
    ints="bin n",
)
case(
    "a23_data_through",
    lambda s, sf: data_through(history_payload(c.spine(s, sf), t.HISTORY_START)),
    f"""SELECT series, strftime(max(month), '%Y-%m') AS data_through FROM spine
        WHERE urea IS NOT NULL AND ng_spot IS NOT NULL AND month >= DATE '{t.HISTORY_START}' GROUP BY 1""",
    keep="series data_through",
)


def check_results(spark: SparkSession, sf: str) -> DataFrame:
    """Null and uniqueness checks on raw and derived tables."""
    orders, log = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    return quality.union_all(
        [
            quality.not_null(orders, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"]),
            quality.unique(orders, "orders", ["o_orderkey"]),
            quality.unique(orders, "orders", ["o_orderpriority", "o_orderdate"]),
            quality.not_null(c.panel(spark, sf), "panel", [KEY, MONTH, "urea", "ng_spot"]),
            quality.unique(log, "lineitem", ["l_orderkey", "l_linenumber"]),
        ]
    )


def _not_null_sql(table: str, cols: list[str], source: str | None = None) -> list[str]:
    return [
        f"SELECT 'not_null_{table}_{x}' AS name, count(*) FILTER ({x} IS NULL) AS failures FROM {source or table}" for x in cols
    ]


def _unique_sql(table: str, cols: list[str]) -> str:
    keys = ", ".join(cols)
    return f"""SELECT 'unique_{table}_{'_'.join(cols)}' AS name, count(*) AS failures FROM (
      SELECT {keys} FROM {table} GROUP BY {keys} HAVING count(*) > 1)"""


cte(
    "checks",
    "SELECT *, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM ("
    + " UNION ALL ".join(
        [
            *_not_null_sql("orders", ["o_orderkey", "o_totalprice", "o_orderdate"]),
            _unique_sql("orders", ["o_orderkey"]),
            _unique_sql("orders", ["o_orderpriority", "o_orderdate"]),
            *_not_null_sql("panel", [KEY, MONTH, "urea", "ng_spot"]),
            _unique_sql("lineitem", ["l_orderkey", "l_linenumber"]),
        ]
    )
    + ")",
)
case(
    "a24_status_counts",
    lambda s, sf: quality.status_rollup(check_results(s, sf)),
    """SELECT count(*) FILTER (status = 'pass') AS n_ok, 0 AS n_warn, count(*) FILTER (status = 'fail') AS n_bad,
       0 AS n_unknown FROM checks""",
    ints="n_ok n_warn n_bad n_unknown",
)
