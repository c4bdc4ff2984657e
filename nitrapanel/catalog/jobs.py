"""Composite jobs: staging to bundle, models, quality gates, farm analytics."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.catalog import common as c
from nitrapanel.catalog.aggregates import GRANGER_ONE, PRICE, check_results, crops
from nitrapanel.catalog.base import case, cte
from nitrapanel.catalog.sources_and_rows import N_LBS
from nitrapanel.catalog.windows_and_scalars import ERF, TEXTS, exposure
from nitrapanel.constants import FEATURE_COLS, HORIZONS, KEY, MEASURES, MONTH, SEED, TARGET_COLS
from nitrapanel.models import boosted
from nitrapanel.models.baseline import last_value, latest_forecast
from nitrapanel.models.metrics import evaluate, seed_spread
from nitrapanel.models.splits import walk_forward
from nitrapanel.operators import borrowers as bor
from nitrapanel.operators import bundle as bun
from nitrapanel.operators import farm, lag, quality, staging, states
from nitrapanel.operators.features import build_features, daily_features, latest_complete
from nitrapanel.operators.legacy import ingest_legacy
from nitrapanel.operators.signal import generate_signal
from nitrapanel.operators.simulate import bands, monte_carlo
from nitrapanel.plans import refresh as job
from nitrapanel.plans.forecast import bundle_from, panel_from, spine_panel, tree_bundle_from
from nitrapanel.session import materialize, scratch_path
from nitrapanel.sources import tables as t

SWEEP_SEEDS = 20

case(
    "k01_stage_priority",
    lambda s, sf: staging.stage_storage(t.weekly_of(t.ship_days(s, sf)), t.storage_backbone_of(t.ship_days(s, sf))),
    "SELECT * FROM stg_storage",
    keep="series month",
    nums="value",
)
case(
    "k02_stage_single",
    lambda s, sf: staging.stage_single(t.sheet_of(t.ship_days(s, sf)), "urea"),
    "SELECT * FROM stg_urea",
    keep="series month",
    nums="value",
)
case("k03_build_panel", c.panel, "SELECT * FROM panel", keep="series month", nums=" ".join(MEASURES))


def legacy_panel(spark: SparkSession, sf: str) -> DataFrame:
    daily = materialize(t.order_days(spark, sf), "order_days")
    days = materialize(t.ship_days(spark, sf), "ship_days")
    f = t.feeds_of(daily, days)
    return ingest_legacy(f.daily, f.backbone, f.weekly_bcf, f.storage_backbone, t.quoted_sheet_of(days), start=None)


def overlay_sql(local: str, live: str) -> str:
    return f"""SELECT b.series, b.month, coalesce(l.value, b.value) AS value FROM ({local}) b LEFT JOIN ({live}) l USING (series, month)
      UNION ALL SELECT l.series, l.month, l.value FROM ({live}) l
      JOIN (SELECT series, max(month) AS m FROM ({local}) GROUP BY 1) e ON e.series = l.series AND l.month > e.m"""


def fill_two(x: str) -> str:
    return f"""coalesce({x}, last_value({x} IGNORE NULLS) OVER (PARTITION BY series ORDER BY month
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS {x}"""


cte("old_ng", overlay_sql("SELECT series, period AS month, value FROM backbone", "SELECT * FROM live_ng"))
cte("old_storage", overlay_sql("SELECT series, period AS month, value FROM storage_backbone", "SELECT * FROM live_storage"))
cte("old_sheet", f"SELECT series, month, {fill_two('urea')}, {fill_two('dap')} FROM quoted")
cte(
    "old_panel",
    """SELECT k.series, k.month, n.value AS ng_spot, s.urea, s.dap, g.value AS storage_mmcf FROM (
      SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM (
        SELECT series, least((SELECT min(month) FROM old_ng n WHERE n.series = x.series),
          (SELECT min(month) FROM old_storage n WHERE n.series = x.series), min(month)) AS lo, least((SELECT max(month) FROM old_ng n WHERE n.series = x.series AND value IS NOT NULL),
          (SELECT max(month) FROM old_storage n WHERE n.series = x.series AND value IS NOT NULL),
          max(month) FILTER (urea IS NOT NULL), max(month) FILTER (dap IS NOT NULL)) AS hi FROM old_sheet x GROUP BY 1)) k
      LEFT JOIN old_ng n ON n.series = k.series AND n.month = k.month
      LEFT JOIN old_storage g ON g.series = k.series AND g.month = k.month
      LEFT JOIN old_sheet s ON s.series = k.series AND s.month = k.month""",
)
case("k04_ingest_legacy", legacy_panel, "SELECT * FROM old_panel", keep="series month", nums=" ".join(MEASURES))
case(
    "k05_daily_features",
    lambda s, sf: daily_features(t.order_days(s, sf)),
    "SELECT * FROM daily_feats",
    keep="series month",
    nums="ng_ma30_eom ng_ma60_eom ng_ma90_eom ng_ma_cross_30_60 ng_ma_cross_30_90 ng_daily_vol_1m",
)
case(
    "k06_build_features",
    c.features,
    "SELECT * FROM features",
    keep="series month",
    nums=" ".join([*FEATURE_COLS, "storage_mmcf", *TARGET_COLS]),
    digits=5,
)
case(
    "k07_chrono_split",
    c.split,
    "SELECT * FROM split",
    keep="series month target_month role",
    ints="horizon label",
    nums="target",
)

# Models ----------------------------------------------------------------------------


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    return boosted.training_rows(c.stored_features(spark, sf), t.HOLDOUT_START)


def near(pred: Column, low: Column, high: Column) -> Column:
    """Whether a prediction lies in the range of the training targets, a quarter of it beyond at most."""
    margin = (high - low) / 4
    return pred.between(low - margin, high + margin)


def target_range(rows: DataFrame) -> DataFrame:
    return rows.groupBy("horizon").agg(F.min("target").alias("low"), F.max("target").alias("high"))


def regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout predictions of all horizons, each by the model of its own training rows."""
    rows = stored_rows(spark, sf)
    made = boosted.holdout_scores(rows, [SEED]).join(target_range(rows.where("role = 'train'")), "horizon")
    return made.withColumn("plausible", near(F.col("pred"), F.col("low"), F.col("high")))


def classifier(spark: SparkSession, sf: str) -> DataFrame:
    made = boosted.holdout_scores(stored_rows(spark, sf), [SEED])
    return made.withColumn("is_probability", F.col("prob_up").between(0, 1) & (F.col("label_pred") == (F.col("prob_up") > 0.5).cast("int")))


HOLDOUT_ROWS = "SELECT *, TRUE AS plausible, TRUE AS is_probability FROM split WHERE role = 'test'"
case(
    "k08_train_regressor",
    regressor,
    HOLDOUT_ROWS,
    keep="series month plausible",
    ints="horizon",
    nums="target",
    digits=5,
)
case("k09_train_classifier", classifier, HOLDOUT_ROWS, keep="series month is_probability", ints="horizon label")
FOLD_ROWS = """SELECT *, CASE WHEN pos < n - (5 - fold) * (n // 6) - 1 THEN 'train'
    WHEN pos >= n - (5 - fold) * (n // 6) AND pos < n - (4 - fold) * (n // 6) THEN 'valid' END AS fold_role
  FROM split JOIN (SELECT horizon, month, row_number() OVER (PARTITION BY horizon ORDER BY month) - 1 AS pos,
      count(*) OVER (PARTITION BY horizon) AS n FROM (SELECT DISTINCT horizon, month FROM split WHERE role = 'train')) USING (horizon, month)
  CROSS JOIN (SELECT unnest(range(5)) AS fold) WHERE role = 'train'"""
case(
    "k10_cross_validate",
    lambda s, sf: boosted.cv_residuals(boosted.cross_validate(stored_rows(s, sf))).withColumn(
        "spread", F.col("cv_residual_std") > 0
    ),
    f"SELECT series, horizon, count(*) AS n, TRUE AS spread FROM ({FOLD_ROWS}) WHERE fold_role = 'valid' GROUP BY 1, 2",
    keep="series spread",
    ints="horizon n",
)
case(
    "k10_fold_sizes",
    lambda s, sf: walk_forward(c.split(s, sf).where("role = 'train'"), ["horizon"])
    .groupBy(KEY, "horizon", "fold", "fold_role")
    .agg(F.count("*").alias("n"), F.min(MONTH).alias("first_month"), F.max(MONTH).alias("last_month")),
    f"""SELECT series, horizon, fold, fold_role, count(*) AS n, min(month) AS first_month, max(month) AS last_month
        FROM ({FOLD_ROWS}) WHERE fold_role IS NOT NULL GROUP BY 1, 2, 3, 4""",
    keep="series fold_role first_month last_month",
    ints="horizon fold n",
)
case(
    "k11_evaluate",
    lambda s, sf: evaluate(c.holdout(s, sf), t.SHOCK_START),
    "SELECT * FROM holdout_metrics",
    keep="series bucket",
    ints="horizon n",
    nums="rmse mae dir_acc clf_acc residual_mean residual_std",
    digits=5,
)


def refit_models(spark: SparkSession, sf: str) -> tuple[boosted.Models, DataFrame, DataFrame]:
    """Models of all trainable rows, the rows, and the as-of row of each series."""
    f = c.stored_features(spark, sf)
    rows = boosted.training_rows(f, t.HOLDOUT_START)
    return boosted.refit(rows), rows, latest_complete(f)


def refit_predictions(spark: SparkSession, sf: str) -> DataFrame:
    models, rows, now = refit_models(spark, sf)
    probable = [F.col(f"prob_up_t{h}").between(0, 1) for h in HORIZONS]
    span = rows.agg(F.min("target").alias("low"), F.max("target").alias("high")).first()
    close = [near(F.col(f"t{h}"), F.lit(span["low"]), F.lit(span["high"])) for h in HORIZONS]
    return boosted.predict(models, now).withColumns(
        {"plausible": reduce(Column.__and__, close), "is_probability": reduce(Column.__and__, probable)}
    )


def saved_models(spark: SparkSession, sf: str) -> DataFrame:
    """What comes back with saved models: their predictions, inputs, windows and the metrics before the refit."""
    f = c.stored_features(spark, sf)
    trained = boosted.train(f, t.HOLDOUT_START, t.SHOCK_START)
    root, now = scratch_path(spark, "models"), latest_complete(f)
    boosted.save(trained.models, root, boosted.window_facts(f, t.HOLDOUT_START, t.SHOCK_START), trained.metrics)
    saved = boosted.load_saved(spark, root)
    made = [f"{x}_t{h}" if x else f"t{h}" for h in HORIZONS for x in ("", "prob_up")]
    fitted, loaded = (boosted.predict(m, now).select(KEY, MONTH, *made) for m in (trained.models, saved.models))
    pairs = fitted.join(loaded.withColumnsRenamed({x: f"{x}_again" for x in made}), [KEY, MONTH])
    sizes = [F.max(F.when((F.col("horizon") == h) & (F.col("bucket") == "preshock"), F.col("n"))).alias(f"n_preshock_t{h}") for h in HORIZONS]
    told = {**saved.facts, "n_models": len(saved.models.ensembles), "n_trees": sum(len(m.value) for m in saved.models.ensembles.values())}
    return (
        pairs.withColumn("saved_equal", reduce(Column.__and__, [F.col(x) == F.col(f"{x}_again") for x in made]))
        .join(saved.metrics.groupBy(KEY).agg(*sizes), KEY, "left")
        .withColumns({name: F.lit(value) for name, value in told.items()})
    )


def long_predictions(spark: SparkSession, sf: str) -> DataFrame:
    models, rows, now = refit_models(spark, sf)
    made = boosted.forecast_long(boosted.predict(models, now)).join(target_range(rows), "horizon")
    return made.withColumn("plausible", near(F.col("pred"), F.col("low"), F.col("high")))


case(
    "k12_refit_all",
    refit_predictions,
    "SELECT series, month, urea AS current, TRUE AS plausible, TRUE AS is_probability FROM latest",
    keep="series month plausible is_probability",
    nums="current",
)
case(
    "k13_saved_models",
    saved_models,
    f"""SELECT l.series, l.month, TRUE AS saved_equal, 6 AS n_models, 600 AS n_trees, w.a AS training_window_start,
          strftime(DATE '{t.HOLDOUT_START}' - INTERVAL 1 MONTH, '%Y-%m') AS training_window_end,
          strftime(DATE '{t.HOLDOUT_START}', '%Y-%m') AS holdout_start, w.b AS holdout_end,
          strftime(DATE '{t.SHOCK_START}', '%Y-%m') AS shock_target_start, n_preshock_t1, n_preshock_t2, n_preshock_t3
        FROM latest l CROSS JOIN (SELECT strftime(min(month), '%Y-%m') AS a, strftime(max(month), '%Y-%m') AS b FROM features WHERE {c.TRAINABLE}) w
        LEFT JOIN (SELECT series, {', '.join(f'max(n) FILTER (horizon = {h}) AS n_preshock_t{h}' for h in HORIZONS)}
          FROM holdout_metrics WHERE bucket = 'preshock' GROUP BY 1) m ON m.series = l.series""",
    keep="series month saved_equal training_window_start training_window_end holdout_start holdout_end shock_target_start",
    ints="n_models n_trees n_preshock_t1 n_preshock_t2 n_preshock_t3",
)
case(
    "k14_predict",
    long_predictions,
    "SELECT *, TRUE AS plausible FROM forecast",
    keep="series month target_month plausible",
    ints="horizon",
    nums="current ng_spot",
)
case(
    "k15_baseline_line",
    lambda s, sf: latest_forecast(c.stored_features(s, sf)),
    "SELECT * FROM forecast",
    keep="series month target_month",
    ints="horizon",
    nums="current pred",
    digits=5,
)
case(
    "k15_baseline_last_value",
    lambda s, sf: evaluate(last_value(c.split(s, sf).where("role = 'test'")), t.SHOCK_START),
    c.metrics("(SELECT *, urea AS pred, 0 AS label_pred FROM split WHERE role = 'test')"),
    keep="series bucket",
    ints="horizon n",
    nums="rmse mae dir_acc clf_acc",
    digits=5,
)
MC_NUMS = "t1 t2 t3 " + " ".join(bun.STATS)
case(
    "k16_monte_carlo",
    lambda s, sf: monte_carlo(c.forecast_rows(s, sf)),
    "SELECT * FROM mc",
    keep="series month",
    ints="n_simulations",
    nums="current " + MC_NUMS,
    digits=5,
)
case(
    "k16_sampled_distribution",
    lambda s, sf: monte_carlo(c.forecast_rows(s, sf)).select(
        KEY, F.posexplode("sim_t2_distribution").alias("pos", "sim")
    ),
    "SELECT series, path_id // 10 AS pos, sim FROM paths WHERE horizon = 2 AND path_id % 10 = 0",
    keep="series",
    ints="pos",
    nums="sim",
    digits=5,
)
case(
    "k17_signal",
    lambda s, sf: generate_signal(monte_carlo(c.forecast_rows(s, sf))),
    "SELECT * REPLACE (round(p10_t2, 1) AS p10_t2, round(p90_t2, 1) AS p90_t2) FROM signals",
    keep="series signal urgency best_month " + TEXTS,
    nums="confidence current_price best_price forecast_t1 forecast_t2 forecast_t3 p10_t2 p90_t2 prob_rising ng_current ng_change_30d",
    digits=3,
)
case(
    "k18_history_rows",
    lambda s, sf: bun.history_rows(c.spine(s, sf), t.HISTORY_START),
    f"""SELECT series, month, round(urea, 2) AS urea, round(ng_spot, 3) AS ng_spot FROM spine
        WHERE urea IS NOT NULL AND ng_spot IS NOT NULL AND month >= DATE '{t.HISTORY_START}'""",
    keep="series month",
    nums="urea ng_spot",
)


def bundle(spark: SparkSession, sf: str) -> DataFrame:
    f = c.feeds(spark, sf)
    p = materialize(spine_panel(f), "spine")
    feats = materialize(build_features(p, daily_features(f.daily)), "features")
    return bundle_from(
        p, feats, F.lit("2002-01-01 00:00:00Z").cast("timestamp"), t.HOLDOUT_START, t.SHOCK_START, t.HISTORY_START
    )


def bundle_scalars(spark: SparkSession, sf: str) -> DataFrame:
    b = bundle(spark, sf)
    return b.select(
        KEY,
        "generated_at",
        "as_of_date",
        F.col("signal.signal").alias("signal"),
        F.element_at("forecast.labels", 1).alias("label_t1"),
        F.element_at("forecast.months", 3).alias("month_t3"),
        F.size("urea_history.labels").alias("n_history"),
        F.col("monte_carlo.prob_rising_t2").alias("prob_rising_t2"),
        F.element_at("forecast.low", 2).alias("low_t2"),
        F.element_at("forecast.high", 2).alias("high_t2"),
        F.size("sim_t2_distribution").alias("n_sample"),
        "model_metadata.training_window_start",
        "model_metadata.training_window_end",
        "model_metadata.holdout_end",
        "model_metadata.test_rmse_t2",
        "model_metadata.test_mae_full_t3",
        "model_metadata.n_test_shock_t1",
    )


case(
    "k19_bundle",
    bundle_scalars,
    f"""SELECT s.series, '2002-01-01T00:00:00Z' AS generated_at, strftime(s.month, '%Y-%m') AS as_of_date, signal,
         strftime(s.month + INTERVAL 1 MONTH, '%b %Y') AS label_t1, strftime(s.month + INTERVAL 3 MONTH, '%Y-%m') AS month_t3,
         h.n AS n_history, prob_rising_t2, round(p10_t2, 1) AS low_t2, round(p90_t2, 1) AS high_t2, 1000 AS n_sample,
         w.a AS training_window_start, '1999-12' AS training_window_end, w.b AS holdout_end,
         m.rmse AS test_rmse_t2, f.mae AS test_mae_full_t3, k.n AS n_test_shock_t1
       FROM signals s
       JOIN (SELECT series, count(*) AS n FROM spine WHERE urea IS NOT NULL AND ng_spot IS NOT NULL
             AND month >= DATE '{t.HISTORY_START}' GROUP BY 1) h USING (series)
       JOIN (SELECT series, strftime(min(month), '%Y-%m') AS a, strftime(max(month), '%Y-%m') AS b
             FROM features WHERE {c.TRAINABLE} GROUP BY 1) w USING (series)
       JOIN holdout_metrics m ON m.series = s.series AND m.horizon = 2 AND m.bucket = 'preshock'
       JOIN holdout_metrics f ON f.series = s.series AND f.horizon = 3 AND f.bucket = 'full'
       JOIN holdout_metrics k ON k.series = s.series AND k.horizon = 1 AND k.bucket = 'shock'""",
    keep="series generated_at as_of_date signal label_t1 month_t3 training_window_start training_window_end holdout_end",
    ints="n_history n_sample n_test_shock_t1",
    nums="prob_rising_t2 low_t2 high_t2 test_rmse_t2 test_mae_full_t3",
    digits=4,
)


def history_view(spark: SparkSession, sf: str) -> DataFrame:
    """Both history views, one row per label."""
    b = bundle(spark, sf)
    views = [bun.history_view(b, x).withColumn("commodity", F.lit(x)) for x in ("urea", "natgas")]
    rows = quality.union_all(views).select(KEY, "commodity", F.explode(F.arrays_zip("labels", "values")).alias("h"))
    return rows.select(KEY, "commodity", F.col("h.labels").alias("label"), F.col("h.values").alias("value"))


case(
    "k19_history_view",
    history_view,
    f"""WITH h AS (SELECT series, strftime(month, '%b %Y') AS label, urea, ng_spot FROM spine
          WHERE urea IS NOT NULL AND ng_spot IS NOT NULL AND month >= DATE '{t.HISTORY_START}')
        SELECT series, 'urea' AS commodity, label, round(urea, 2) AS value FROM h
        UNION ALL SELECT series, 'natgas', label, round(ng_spot, 3) FROM h""",
    keep="series commodity label",
    nums="value",
)
case(
    "k19_summary_view",
    lambda s, sf: bun.summary_view(bundle(s, sf)).select(
        KEY, "schema_version", "generated_at", "as_of_date", "signal.signal", "signal.urgency", "signal.best_month",
        F.element_at("forecast.mean", 1).alias("mean_t1"), F.element_at("forecast.low", 3).alias("low_t3"),
        F.element_at("forecast.high", 3).alias("high_t3"),
    ),
    """SELECT series, 1 AS schema_version, '2002-01-01T00:00:00Z' AS generated_at, strftime(month, '%Y-%m') AS as_of_date,
         signal, urgency, best_month, round(p50_t1, 1) AS mean_t1, round(p10_t3, 1) AS low_t3, round(p90_t3, 1) AS high_t3
       FROM signals""",
    keep="series generated_at as_of_date signal urgency best_month",
    ints="schema_version",
    nums="mean_t1 low_t3 high_t3",
    digits=4,
)
case(
    "k19_monte_carlo_view",
    lambda s, sf: bun.monte_carlo_view(bundle(s, sf)).select(
        KEY, "monte_carlo.*", F.size("sim_t2_distribution").alias("n_sample")
    ),
    "SELECT *, 1000 AS n_sample FROM mc",
    keep="series",
    ints="n_simulations n_sample",
    nums=" ".join(bun.STATS),
    digits=5,
)


def bundle_file(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle written as JSON documents and read back."""
    path = scratch_path(spark, "bundle")
    bun.write_bundle(bundle(spark, sf), path)
    return spark.read.json(path).select(KEY, "as_of_date", "signal.signal", "signal.best_month")


case(
    "c14_bundle_file",
    bundle_file,
    "SELECT series, strftime(month, '%Y-%m') AS as_of_date, signal, best_month FROM signals",
    keep="series as_of_date signal best_month",
)
case(
    "c15_bundle_contract",
    lambda s, sf: bun.check_contract(bundle(s, sf)).select(KEY, "schema_version"),
    "SELECT series, 1 AS schema_version FROM mc",
    keep="series",
    ints="schema_version",
)

# Quality gates ---------------------------------------------------------------------

THRESHOLDS = {"orders_daily": (3, 7), "lineitem_weekly": (10, 15), "orders_stale": (1, 3)}


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    tables = {
        "orders_daily": (orders, "o_orderdate"),
        "lineitem_weekly": (lines, "l_shipdate"),
        "orders_stale": (orders, "o_orderdate"),
        "events_static": (t.table(spark, sf, "events"), "ts"),
    }
    as_of = orders.agg(F.date_add(F.max("o_orderdate").cast("date"), 5)).scalar()
    return quality.freshness_report(tables, THRESHOLDS, as_of)


def _fresh_sql(name: str, table: str, period: str) -> str:
    warn, error = THRESHOLDS[name]
    age = f"(SELECT CAST(max(o_orderdate) AS DATE) + 5 FROM orders) - CAST(max({period}) AS DATE)"
    return f"""SELECT '{name}' AS name, CAST(max({period}) AS DATE) AS max_period, {age} AS age_days, {warn} AS warn_after,
      {error} AS error_after, CASE WHEN {age} > {error} THEN 'error' WHEN {age} > {warn} THEN 'warn' ELSE 'pass' END AS status
      FROM {table}"""


cte(
    "fresh",
    " UNION ALL ".join(
        [
            _fresh_sql("orders_daily", "orders", "o_orderdate"),
            _fresh_sql("lineitem_weekly", "lineitem", "l_shipdate"),
            _fresh_sql("orders_stale", "orders", "o_orderdate"),
        ]
    ),
)
case(
    "k20_freshness",
    freshness,
    "SELECT * FROM fresh",
    keep="name max_period status",
    ints="age_days warn_after error_after",
)
case("k21_table_checks", check_results, "SELECT * FROM checks", keep="name status", ints="failures")


def two_panels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The current panel and the older path's, from the same landed feeds."""
    daily = materialize(t.order_days(spark, sf), "order_days")
    days = materialize(t.ship_days(spark, sf), "ship_days")
    f = t.feeds_of(daily, days)
    old = ingest_legacy(f.daily, f.backbone, f.weekly_bcf, f.storage_backbone, t.quoted_sheet_of(days), start=None)
    return materialize(panel_from(f), "panel"), materialize(old, "old_panel")


PARITY_COLS = "diff_cells matching_cells common only_left only_right"


def parity_sql(col: str) -> str:
    bad = f"NOT (a.{col} IS NULL AND b.{col} IS NULL) AND coalesce(abs(a.{col} - b.{col}) > 1e-6, TRUE)"
    both = "a.series IS NOT NULL AND b.series IS NOT NULL"
    return f"""SELECT '{col}' AS col_name, count(*) FILTER ({both} AND {bad}) AS diff_cells,
      count(*) FILTER ({both} AND NOT ({bad})) AS matching_cells,
      max(abs(a.{col} - b.{col})) FILTER ({both} AND {bad}) AS max_abs_diff,
      min(a.month) FILTER ({both} AND {bad}) AS first_month, max(a.month) FILTER ({both} AND {bad}) AS last_month,
      count(*) FILTER ({both}) AS common, count(*) FILTER (b.series IS NULL) AS only_left,
      count(*) FILTER (a.series IS NULL) AS only_right, 'MISMATCH PRESENT' AS verdict
      FROM panel a FULL JOIN old_panel b ON a.series = b.series AND a.month = b.month"""


PARITY = " UNION ALL ".join(parity_sql(m) for m in MEASURES)
case(
    "k22_parity",
    lambda s, sf: quality.parity(*two_panels(s, sf), MEASURES).withColumnRenamed("column", "col_name"),
    PARITY,
    keep="col_name first_month last_month verdict",
    ints=PARITY_COLS,
    nums="max_abs_diff",
)
EXPECTED = {"urea": "2001-12-01", "dap": "1999-01-01"}
# Extra rows on the right side explain shifts up to these.
MOST_SHIFT = {"storage_mmcf": 1e9, "ng_spot": 1e-3}
TAGGED = f"""SELECT *, CASE WHEN diff_cells = 0 THEN 'OK' WHEN col_name = 'urea' AND last_month < DATE '2001-12-01' THEN 'EXPECTED'
    WHEN col_name = 'dap' AND last_month < DATE '1999-01-01' THEN 'EXPECTED'
    {' '.join(f"WHEN col_name = '{x}' AND only_right > 0 AND max_abs_diff < {limit!r} THEN 'EXPECTED'" for x, limit in MOST_SHIFT.items())}
    ELSE 'UNEXPLAINED' END AS tag FROM ({PARITY})"""
case(
    "k23_parity_classified",
    lambda s, sf: quality.parity_classified(*two_panels(s, sf), MEASURES, EXPECTED, MOST_SHIFT).withColumnRenamed("column", "col_name"),
    TAGGED,
    keep="col_name first_month last_month tag",
    ints=PARITY_COLS,
    nums="max_abs_diff",
)
EXTRA = """SELECT a.series, a.month, 'right' AS side, CASE WHEN a.urea IS NULL AND a.dap IS NULL THEN 'EXPECTED' ELSE 'UNEXPECTED' END AS verdict
    FROM panel a WHERE NOT EXISTS (SELECT 1 FROM old_panel b WHERE b.series = a.series AND b.month = a.month)
    UNION ALL SELECT b.series, b.month, 'left', 'UNEXPECTED' FROM old_panel b
    WHERE NOT EXISTS (SELECT 1 FROM panel a WHERE b.series = a.series AND b.month = a.month)"""


def gates(spark: SparkSession, sf: str) -> DataFrame:
    """The gate over the two panels, over a panel and itself, and over panels whose columns differ in order."""
    new, old = two_panels(spark, sf)
    pairs = {"paths": (old, new), "same": (new, new), "order": (new, new.select(*reversed(new.columns)))}
    made = [quality.parity_gate(*pair, MEASURES, EXPECTED, MOST_SHIFT).withColumn("pair", F.lit(name)) for name, pair in pairs.items()]
    return quality.union_all(made)


# The same comparison with the older path on the left.
case(
    "k23_gate",
    gates,
    f"""SELECT 'paths' AS pair, TRUE AS columns_agree, a.n AS n_unexplained, b.n AS n_unexpected,
          CASE WHEN a.n + b.n = 0 THEN 'PASS' ELSE 'UNEXPLAINED' END AS verdict
        FROM (SELECT count(*) AS n FROM ({TAGGED.replace('only_right > 0', 'only_left > 0')}) WHERE tag = 'UNEXPLAINED') a
        CROSS JOIN (SELECT count(*) AS n FROM ({EXTRA}) WHERE verdict = 'UNEXPECTED') b
        UNION ALL SELECT 'same', TRUE, 0, 0, 'PASS' UNION ALL SELECT 'order', FALSE, NULL, 0, 'COLUMNS DIFFER'""",
    keep="pair columns_agree verdict",
    ints="n_unexplained n_unexpected",
)
case(
    "k23_column_list",
    lambda s, sf: quality.column_list(c.panel(s, sf).drop("dap"), c.panel(s, sf).select(MONTH, KEY, *MEASURES[1:], F.lit(1).alias("extra"))),
    "SELECT unnest([" + ", ".join(f"'{x}'" for x in [KEY, MONTH, *[m for m in MEASURES if m != "dap"], "dap", "extra"])
    + "]) AS col_name, unnest([" + ", ".join(
        str([KEY, MONTH, *[m for m in MEASURES if m != "dap"]].index(x) + 1) if x not in ("dap", "extra") else "NULL"
        for x in [KEY, MONTH, *[m for m in MEASURES if m != "dap"], "dap", "extra"]
    ) + "]) AS left_at, unnest([" + ", ".join(
        str([MONTH, KEY, *MEASURES[1:], "extra"].index(x) + 1) if x in [MONTH, KEY, *MEASURES[1:], "extra"] else "NULL"
        for x in [KEY, MONTH, *[m for m in MEASURES if m != "dap"], "dap", "extra"]
    ) + "]) AS right_at",
    keep="col_name",
    ints="left_at right_at",
)
case(
    "k23_extra_rows",
    lambda s, sf: quality.extra_rows(*reversed(two_panels(s, sf))),
    EXTRA,
    keep="series month side verdict",
)

# Lead-lag --------------------------------------------------------------------------

case(
    "k24_lag_scan",
    lambda s, sf: lag.lag_scan(c.spine(s, sf)),
    """SELECT *, CASE WHEN peak_lag <= 4 THEN 'covered' ELSE 'add lags 5..' || peak_lag END AS verdict FROM peak""",
    keep="series verdict",
    ints="peak_lag",
    nums="peak_r",
)


def orthogonal(source: str, pivot: str, others: list[str]) -> str:
    """``source`` with the part along ``pivot`` taken out of the other columns, series by series."""
    cleared = ", ".join(
        f"{x} - coalesce(sum({x} * {pivot}) OVER k / nullif(sum({pivot} * {pivot}) OVER k, 0), 0) * {pivot} AS {x}" for x in others
    )
    return f"SELECT series, n, {pivot}, {cleared} FROM ({source}) WINDOW k AS (PARTITION BY series)"


def granger_two() -> str:
    """F of two lags: the residuals of urea after its own lags, and after those of gas as well."""
    names = ["y", "y1", "y2", "x1", "x2"]
    centred = ", ".join(f"{x} - avg({x}) OVER k AS {x}" for x in names)
    step = f"""SELECT series, count(*) OVER k AS n, {centred} FROM (
      SELECT a.series, a.urea AS y, b.urea AS y1, d.urea AS y2, b.ng_spot AS x1, d.ng_spot AS x2 FROM pairs a
      JOIN pairs b ON b.series = a.series AND b.pos = a.pos - 1 JOIN pairs d ON d.series = a.series AND d.pos = a.pos - 2)
      WINDOW k AS (PARTITION BY series)"""
    step = orthogonal(step, "y1", ["y", "y2", "x1", "x2"])
    step = orthogonal(step, "y2", ["y", "x1", "x2"])
    own = f"SELECT *, y AS r FROM ({step})"
    full = orthogonal(f"SELECT series, n, x1, y, x2, r FROM ({own})", "x1", ["y", "x2", "r"]).replace(
        "r - coalesce(sum(r * x1) OVER k / nullif(sum(x1 * x1) OVER k, 0), 0) * x1 AS r", "r"
    )
    full = f"SELECT series, n, r, y - coalesce(sum(y * x2) OVER k / nullif(sum(x2 * x2) OVER k, 0), 0) * x2 AS u FROM ({full}) WINDOW k AS (PARTITION BY series)"
    return f"""SELECT series, 2 AS lag, (sum(r * r) - sum(u * u)) / 2 / (sum(u * u) / (any_value(n) - 5)) AS f_stat,
      any_value(n) - 5 AS df_denom FROM ({full}) GROUP BY 1"""


def granger_p(spark: SparkSession, sf: str) -> DataFrame:
    """All lags with their degrees of freedom; F of the first two and p of the second, which SQL can follow."""
    rows = lag.granger(c.spine(spark, sf))
    known = F.when(F.col("lag") <= 2, F.col("f_stat"))
    p = F.when(F.col("lag") == 2, F.col("p_value"))
    sound = F.col("p_value").between(0, 1) & (F.col("f_stat") >= 0)
    return rows.withColumns({"f_low": known, "p_two": p, "sound": sound})


case(
    "k25_granger",
    granger_p,
    f"""SELECT g.series, g.lag, g.n - g.lag - 2 * g.lag - 1 AS df_denom, f.f_stat AS f_low, TRUE AS sound,
        CASE WHEN g.lag = 2 THEN pow(1 + 2 * f.f_stat / f.df_denom, -f.df_denom / 2e0) END AS p_two
        FROM (SELECT series, lag, max(n) AS n FROM pairs CROSS JOIN (SELECT unnest(range(1, 13)) AS lag) GROUP BY 1, 2) g
        LEFT JOIN (({GRANGER_ONE}) UNION ALL ({granger_two()})) f ON f.series = g.series AND f.lag = g.lag""",
    keep="series sound",
    ints="lag df_denom",
    nums="f_low p_two",
    digits=5,
)
case(
    "k26_block_summary",
    lambda s, sf: lag.window_summary(lag.rolling_corr(c.spine(s, sf))),
    """SELECT series, avg(r) AS mean_r, min(r) AS min_r, max(r) AS max_r, count(r) AS n_blocks FROM corr_blocks GROUP BY 1""",
    keep="series",
    ints="n_blocks",
    nums="mean_r min_r max_r",
)


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of each metric over the seeds; the same from the stored figures of each seed."""
    per_seed = materialize(boosted.sweep_metrics(c.stored_features(spark, sf), SWEEP_SEEDS, t.HOLDOUT_START, t.SHOCK_START), "sweep")
    spread = seed_spread(per_seed, keys=[])
    names = ("rmse", "dir_acc", "clf_acc")
    inside = [F.col(f"{m}_mean").between(F.col(f"{m}_min") - 1e-9, F.col(f"{m}_max") + 1e-9) & (F.col(f"{m}_std") >= 0) for m in names]
    per_seed.createOrReplaceTempView("sweep_scores")
    again = spark.sql(
        "SELECT horizon AS h, count(DISTINCT seed) AS seeds, min(n) AS n_test, max(n) AS n_most, "
        + ", ".join(f"min({m}) AS a_{m}, max({m}) AS b_{m}, sum({m}) / count({m}) AS c_{m}, sqrt(avg({m} * {m}) - avg({m}) * avg({m})) AS d_{m}" for m in names)
        + " FROM sweep_scores GROUP BY horizon"
    )
    equal = [
        (F.col(f"a_{m}") == F.col(f"{m}_min")) & (F.col(f"b_{m}") == F.col(f"{m}_max"))
        & (F.abs(F.col(f"c_{m}") - F.col(f"{m}_mean")) < 1e-6) & (F.abs(F.coalesce(F.nanvl(f"d_{m}", F.lit(0.0)), F.lit(0.0)) - F.col(f"{m}_std")) < 1e-3)
        for m in names
    ]
    return spread.join(again, F.col("horizon") == F.col("h")).withColumns(
        {"ordered": reduce(Column.__and__, inside), "as_recomputed": reduce(Column.__and__, equal) & (F.col("n_test") == F.col("n_most"))}
    )


case(
    "k27_seed_sweep",
    sweep,
    f"""SELECT horizon, {SWEEP_SEEDS} AS n_seeds, {SWEEP_SEEDS} AS seeds, sum(n) AS n_test, TRUE AS ordered, TRUE AS as_recomputed
        FROM holdout_metrics WHERE bucket = 'preshock' GROUP BY 1""",
    keep="ordered as_recomputed",
    ints="horizon n_seeds seeds n_test",
)

# Farms -----------------------------------------------------------------------------

cte(
    "needs",
    f"""SELECT *, acres * coalesce({N_LBS}, 100) / (0.46e0 * 2204.6e0) AS total_urea_mt,
      acres * coalesce({N_LBS}, 100) / (0.46e0 * 2204.6e0) * (1e0 - pre_pct / 100e0) AS need FROM farms""",
)
case(
    "k28_exposure_table",
    lambda s, sf: farm.exposure_table(t.farms(s, sf), materialize(bands(c.forecast_rows(s, sf)), "bands")),
    """SELECT farm_id, series, horizon, total_urea_mt, need AS remaining_mt, need * round(p50, 1) AS cost_expected,
       need * round(p10, 1) AS cost_low, need * round(p90, 1) AS cost_high, need * round(current, 1) AS cost_now FROM needs JOIN bands USING (series)""",
    keep="series",
    ints="farm_id horizon",
    nums="total_urea_mt remaining_mt cost_expected cost_low cost_high cost_now",
    digits=3,
)


def hedges(spark: SparkSession, sf: str) -> DataFrame:
    prices = materialize(farm.hedge_prices(bands(c.forecast_rows(spark, sf))), "hedge_prices")
    return farm.hedge_split(t.farms(spark, sf), prices)


# The objective is evaluated per farm on the whole grid here.
cte(
    "hedge_best",
    """SELECT farm_id, series, horizon, risk, need, current, exp_price, p10_price, p90_price,
      arg_min(f, round(objective, 6) * 1000 + f) AS f_star FROM (
      SELECT farm_id, series, horizon, risk, need, current, exp_price, p10_price, p90_price, i / 200e0 AS f,
        need * ((1 - alpha) * (i / 200e0 * current + (1 - i / 200e0) * exp_price)
          + alpha * (i / 200e0 * current + (1 - i / 200e0) * p90_price)) AS objective
      FROM needs JOIN hedge_prices USING (series) CROSS JOIN risks CROSS JOIN (SELECT unnest(range(201)) AS i))
      GROUP BY ALL""",
)
case(
    "k29_hedge_split",
    hedges,
    """SELECT *, round(f_star * 100) AS pct_now, need * f_star AS mt_now, need * (1 - f_star) AS mt_wait,
         need * current AS cost_all_now, need * (f_star * current + (1 - f_star) * exp_price) AS exp_optimal,
         need * (f_star * current + (1 - f_star) * p10_price) AS p10_optimal,
         need * (f_star * current + (1 - f_star) * p90_price) AS p90_optimal, need * exp_price AS exp_wait,
         need * p10_price AS p10_wait, need * p90_price AS p90_wait,
         need * exp_price - need * (f_star * current + (1 - f_star) * exp_price) AS saving_vs_wait FROM hedge_best""",
    keep="series risk",
    ints="farm_id horizon pct_now",
    nums="f_star mt_now mt_wait cost_all_now exp_optimal p10_optimal p90_optimal exp_wait p10_wait p90_wait saving_vs_wait",
    digits=3,
)
cte(
    "timing",
    f"""WITH mc AS (SELECT * REPLACE (round(current, 1) AS current) FROM mc)
      SELECT series, 0 AS wait_days, current, current AS p10, current AS p50, current AS p90, NULL AS prob FROM mc
      UNION ALL SELECT series, 30, current, p10_t1, p50_t1, p90_t1, CASE WHEN sd <= 0 THEN CAST(p50_t1 > current AS DOUBLE)
        ELSE 0.5e0 * (1e0 - ({ERF})) END FROM (
        SELECT *, residual_std_t1 AS sd, (current - p50_t1) / nullif(residual_std_t1 * sqrt(2e0), 0) AS x FROM mc)
      UNION ALL SELECT series, 60, current, p10_t2, p50_t2, p90_t2, prob_rising_t2 FROM mc""",
)
case(
    "k30_timing_options",
    lambda s, sf: farm.timing_options(t.farms(s, sf), materialize(monte_carlo(c.forecast_rows(s, sf)), "mc")),
    """SELECT *, CASE WHEN wait_days = 0 THEN 'BASELINE' WHEN p50 < current THEN printf('SAVE %.1f%%', abs(delta_pct))
         ELSE printf('%.0f%% CHANCE HIGHER', prob * 100) END AS badge,
         CASE WHEN wait_days = 0 THEN 'baseline' WHEN p50 < current THEN 'save' WHEN prob * 100 < 70 THEN 'moderate'
           ELSE 'high' END AS badge_level
       FROM (SELECT farm_id, series, wait_days, current, p50, prob, need * p10 AS cost_p10, need * p50 AS cost_p50, need * p90 AS cost_p90,
         need * p50 - need * current AS delta,
         CASE WHEN need * current > 0 THEN (need * p50 - need * current) / (need * current) * 100 ELSE 0 END AS delta_pct,
         CASE WHEN wait_days = 0 THEN 0 ELSE (1 - prob) * 100 END AS prob_cheaper_pct FROM needs JOIN timing USING (series))""",
    keep="series badge badge_level",
    ints="farm_id wait_days",
    nums="cost_p10 cost_p50 cost_p90 delta delta_pct prob_cheaper_pct",
    digits=3,
)
case(
    "k31_state_exposure",
    lambda s, sf: exposure(s, sf, "urea_mt").orderBy(F.desc("urea_mt")),
    "SELECT * FROM state_costs",
    keep="state",
    nums="corn_acres wheat_acres soy_acres urea_mt current_cost_m forecast_cost_m impact_m",
    digits=4,
)


def acres_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 1e6 THEN printf('%.1fM ac', {x} / 1e6) ELSE printf('%.0fK ac', {x} / 1e3) END"


case(
    "k31_state_ranking",
    lambda s, sf: states.ranking_table(exposure(s, sf, "urea_mt")),
    f"""SELECT state, {acres_sql('corn_acres')} AS corn, {acres_sql('wheat_acres')} AS wheat, {acres_sql('soy_acres')} AS soy,
        format('{{:,.0f}}', urea_mt / 1000) || 'K mt' AS urea_needed, printf('$%.1fM', current_cost_m) AS current_cost,
        printf('$%.1fM', forecast_cost_m) AS forecast_cost, printf('▲$%.1fM', abs(impact_m)) AS impact FROM state_costs""",
    keep="state corn wheat soy urea_needed current_cost forecast_cost impact",
)
case(
    "k32_farm_summary",
    lambda s, sf: farm.farm_summary(crops(s, sf), F.lit(PRICE), F.lit(-0.083)),
    "SELECT *, 'Nat gas down 8% last 30 days' AS gas_alert FROM farm_totals JOIN crop_cards USING (user_id)",
    keep="top_crop top_n_crop gas_alert",
    ints="user_id n_crops",
    nums="fertilizer_used_lbs fertilizer_cost_usd total_acres cost_per_acre top_cost top_pct top_n_lbs",
)

# Borrowers -------------------------------------------------------------------------


def borrower_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bor.borrowers(t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


def pick_sql(u: str, table: dict[str, float]) -> str:
    total, parts = 0.0, []
    for name, weight in list(table.items())[:-1]:
        total += weight
        parts.append(f"WHEN {u} < {round(total, 12)!r}e0 THEN '{name}'")
    return f"CASE {' '.join(parts)} ELSE '{list(table)[-1]}' END"


def u(stream: int) -> str:
    return c.uniform("c_custkey", 42 + stream)


cte(
    "borrowers",
    f"""SELECT *, round(farm_area_acres * mult * rate, 2) AS fertilizer_used_tons FROM (
      SELECT *, CASE crop_type {' '.join(f"WHEN '{k}' THEN {v!r}e0" for k, v in bor.MULTIPLIER.items())} END AS mult FROM (
      SELECT c_custkey AS id, 'FARM-' || (c_custkey + 1000) AS borrower_id, {pick_sql('u1', bor.CROPS)} AS crop_type,
        round(50 + u2 * 1450, 2) AS farm_area_acres, {pick_sql('u3', bor.IRRIGATION)} AS irrigation_type,
        {pick_sql('u4', bor.SOIL)} AS soil_type, {pick_sql('u5', bor.SEASON)} AS season,
        round(list_sort(betas)[5] * 0.95e0, 2) AS current_ltv_ratio,
        CASE WHEN u8 < 0.7e0 THEN -1 ELSE CAST(least(floor(u9 * 47), 46) AS INTEGER) + 1 END AS months_since_delinquency,
        u6 * 0.10e0 + 0.05e0 AS rate
      FROM (SELECT c_custkey, {', '.join(f'{u(i)} AS u{i}' for i in (1, 2, 3, 4, 5, 6, 8, 9))},
        [{', '.join(c.uniform(f'(c_custkey * 6 + {i})', 49) for i in range(6))}] AS betas FROM customer)))""",
)
case(
    "k33_borrowers",
    borrower_rows,
    "SELECT * FROM borrowers",
    keep="borrower_id crop_type irrigation_type soil_type season",
    ints="id months_since_delinquency",
    nums="farm_area_acres current_ltv_ratio fertilizer_used_tons",
    digits=2,
)


def stress_of_accounts(spark: SparkSession, sf: str) -> DataFrame:
    accounts = bor.from_accounts(*[t.table(spark, sf, name) for name in ("customer", "orders", "events")])
    return bor.stress_score(accounts, F.col("drift"))


SEGMENT_SQL = " ".join(f"WHEN '{k}' THEN {bor.MULTIPLIER[v]!r}e0" for k, v in bor.SEGMENT_CROPS.items())
case(
    "k34_stress_score",
    stress_of_accounts,
    f"""SELECT *, CAST(stress_probability > 0.65 AS INTEGER) AS requires_intervention FROM (
        SELECT *, least(greatest(current_ltv_ratio * 0.4e0 + mult / 2e0 * 0.4e0
          + CASE WHEN months_since_delinquency <> -1 THEN 12e0 / (months_since_delinquency + 1) ELSE 0 END * 0.2e0
          + drift, 0), 1) AS stress_probability FROM (
          SELECT c_custkey AS id, CASE c_mktsegment {SEGMENT_SQL} END AS mult,
            least(greatest((10000e0 - c_acctbal) / 11000e0, 0), 1) AS current_ltv_ratio,
            coalesce(CAST(floor(date_diff('day', CAST(last_order AS DATE), newest) / 30) AS INTEGER), -1) AS months_since_delinquency,
            coalesce(errors, 0.2e0) - 0.2e0 AS drift
          FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) o ON o_custkey = c_custkey
          LEFT JOIN (SELECT user_id, avg(CAST(event_type = 'error' AS DOUBLE)) AS errors FROM events GROUP BY 1) e ON user_id = c_custkey
          CROSS JOIN (SELECT CAST(max(o_orderdate) AS DATE) AS newest FROM orders)))""",
    ints="id months_since_delinquency requires_intervention",
    nums="current_ltv_ratio stress_probability",
)
# The features are computed again over a spine whose last urea price is raised.
cte(
    "bumped_spine",
    """SELECT * REPLACE (CASE WHEN month = max(month) OVER (PARTITION BY series) THEN urea + 100 ELSE urea END AS urea)
      FROM spine""",
)
cte("plain_features", c.PROXY_FEATURES.format(source="spine"))
cte("bumped_features", c.PROXY_FEATURES.format(source="bumped_spine"))
PROBED = [x for x in FEATURE_COLS if x in c.FEATURE_SQL] + ["urea", "dap", "ng_spot"]
case(
    "k35_leakage_probe",
    lambda s, sf: quality.leakage_report(
        build_features, materialize(c.spine(s, sf), "spine"), "urea", 100.0, PROBED
    ).withColumnRenamed("column", "col_name"),
    "SELECT unnest(["
    + ", ".join(f"'{x}'" for x in PROBED)
    + "]) AS col_name, unnest(["
    + ", ".join(f"count(*) FILTER (a.{x} IS DISTINCT FROM b.{x})" for x in PROBED)
    + """]) AS diff_cells, unnest(["""
    + ", ".join("count(*)" for _ in PROBED)
    + """]) AS common FROM plain_features a JOIN bumped_features b USING (series, month)
       JOIN (SELECT series, max(month) AS last_month FROM spine GROUP BY 1) e USING (series) WHERE month < last_month""",
    keep="col_name",
    ints="diff_cells common",
)


def gate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    checks = check_results(spark, sf).select("name", "status")
    return quality.status_listing(checks.unionByName(freshness(spark, sf).select("name", "status")))


case(
    "k36_status_listing",
    gate_rollup,
    """SELECT name, status, CASE status WHEN 'pass' THEN 'ok' WHEN 'warn' THEN 'warn' ELSE 'bad' END AS status_class FROM (
       SELECT name, status FROM checks UNION ALL SELECT name, status FROM fresh)""",
    keep="name status status_class",
)

# Trees to bundle -----------------------------------------------------------------------


def tree_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle of the boosted trees: what follows from the tables, and whether bands and signal are sound."""
    f = c.feeds(spark, sf)
    p = materialize(spine_panel(f), "spine")
    feats = materialize(build_features(p, daily_features(f.daily)), "features")
    written = F.lit("2002-01-01 00:00:00Z").cast("timestamp")
    b = tree_bundle_from(p, feats, written, t.HOLDOUT_START, t.SHOCK_START, t.HISTORY_START)
    low, mean, high = (F.col(f"forecast.{x}") for x in ("low", "mean", "high"))
    ordered = F.forall(F.arrays_zip(low.alias("low"), mean.alias("mean"), high.alias("high")), lambda x: (x["low"] <= x["mean"]) & (x["mean"] <= x["high"]))
    return b.select(
        KEY, "generated_at", "as_of_date",
        F.element_at("forecast.labels", 1).alias("label_t1"),
        F.element_at("forecast.months", 3).alias("month_t3"),
        F.size("urea_history.labels").alias("n_history"),
        F.size("sim_t2_distribution").alias("n_sample"),
        "model_metadata.training_window_start", "model_metadata.training_window_end", "model_metadata.holdout_end",
        "model_metadata.n_test_preshock_t2", "model_metadata.n_test_shock_t1",
        ordered.alias("bands_ordered"),
        F.col("signal.signal").isin("BUY_NOW", "CONSIDER_BUYING", "WAIT", "NEUTRAL").alias("signal_known"),
        ((F.col("model_metadata.cv_residual_std_t2") > 0) & (F.col("model_metadata.residual_std_t2") > 0)).alias("spread"),
    )


case(
    "k19_tree_bundle",
    tree_bundle,
    f"""SELECT s.series, '2002-01-01T00:00:00Z' AS generated_at, strftime(s.month, '%Y-%m') AS as_of_date,
         strftime(s.month + INTERVAL 1 MONTH, '%b %Y') AS label_t1, strftime(s.month + INTERVAL 3 MONTH, '%Y-%m') AS month_t3,
         h.n AS n_history, 1000 AS n_sample, w.a AS training_window_start, '1999-12' AS training_window_end, w.b AS holdout_end,
         m.n AS n_test_preshock_t2, k.n AS n_test_shock_t1, TRUE AS bands_ordered, TRUE AS signal_known, TRUE AS spread
       FROM latest s
       JOIN (SELECT series, count(*) AS n FROM spine WHERE urea IS NOT NULL AND ng_spot IS NOT NULL
             AND month >= DATE '{t.HISTORY_START}' GROUP BY 1) h USING (series)
       JOIN (SELECT series, strftime(min(month), '%Y-%m') AS a, strftime(max(month), '%Y-%m') AS b
             FROM features WHERE {c.TRAINABLE} GROUP BY 1) w USING (series)
       JOIN holdout_metrics m ON m.series = s.series AND m.horizon = 2 AND m.bucket = 'preshock'
       JOIN holdout_metrics k ON k.series = s.series AND k.horizon = 1 AND k.bucket = 'shock'""",
    keep="series generated_at as_of_date label_t1 month_t3 training_window_start training_window_end holdout_end bands_ordered signal_known spread",
    ints="n_history n_sample n_test_preshock_t2 n_test_shock_t1",
)

# Refresh -----------------------------------------------------------------------------


class Stopped(RuntimeError):
    """Raised on purpose before a stage."""


def refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """A refresh that is stopped before its training and called again: how often each stage began, and the tables that readers see.

    Four of the five feeds come from one join of the raw tables, which runs once, when the first of them is landed.
    """
    feeds, root = cache(lambda: t.landed_feeds(spark, sf)), scratch_path(spark, "refresh")
    registry = {name: (lambda name=name: getattr(feeds(), name)) for name in job.FEED_TABLES}
    begun: list[str] = []

    def before(stage: str) -> None:
        begun.append(stage)
        if begun.count("train") == 1 and stage == "train":
            raise Stopped(stage)

    settings = (None, t.HOLDOUT_START, t.SHOCK_START, t.HISTORY_START, boosted.ITERATIONS, lambda _: None)
    try:
        job.refresh(spark, registry, root, *settings, before=before)
    except job.StepFailed as error:
        stopped = isinstance(error.__cause__, Stopped) and not job.published_runs(spark, root)
    job.refresh(spark, registry, root, *settings, before=before)
    run = job.published(spark, root)
    reads = {
        "land": {name: run.read(name) for name in job.FEED_TABLES},
        "stage": {name: run.read(name) for name in ("panel_rows", "panel")},
        "features": {"feature_store": run.read("feature_store")},
        "train": {"metrics": run.read("metrics"), "cv_residuals": run.read("cv_residuals"), "models": spark.read.parquet(f"{run.folder_of('models')}/trees")},
        "bundle": {"bundle": spark.read.text(run.folder_of("bundle"))},
    }
    lines = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(stage).alias("stage"), F.lit(begun.count(stage)).alias("begun"), F.lit(name).alias("table_name"),
            F.lit(run.tables()[name]).alias("version"), F.lit(stopped).alias("unseen_when_stopped"), "n_rows",
        )
        for stage, tables in reads.items() for name, df in tables.items()
    ]
    return quality.union_all(lines)


REFRESH_ROWS = {
    ("land", "daily"): "spot_daily", ("land", "backbone"): "backbone", ("land", "weekly_bcf"): "weekly",
    ("land", "storage_backbone"): "storage_backbone", ("land", "sheet"): "sheet", ("stage", "panel_rows"): "panel",
    ("stage", "panel"): "spine", ("features", "feature_store"): "features", ("train", "metrics"): "holdout_metrics",
    ("train", "cv_residuals"): f"(SELECT DISTINCT series, horizon FROM ({FOLD_ROWS}) WHERE fold_role = 'valid')",
    ("train", "models"): "range(600)", ("bundle", "bundle"): "latest",
}
case(
    "k37_refresh",
    refreshed,
    " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, {2 if stage == 'train' else 1} AS begun, '{name}' AS table_name, 1 AS version, TRUE AS unseen_when_stopped, count(*) AS n_rows FROM {source}"
        for (stage, name), source in REFRESH_ROWS.items()
    ),
    keep="stage table_name unseen_when_stopped",
    ints="begun version n_rows",
)
