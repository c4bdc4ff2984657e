"""Window functions and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.catalog import common as c
from nitrapanel.catalog.aggregates import PRICE, crops
from nitrapanel.catalog.base import case
from nitrapanel.catalog.sources_and_rows import limited, quoted
from nitrapanel.constants import FEATURE_COLS, HORIZONS, KEY, MONTH
from nitrapanel.functions import clean
from nitrapanel.functions import windows as win
from nitrapanel.functions.draws import normal
from nitrapanel.functions.stats import chance_above
from nitrapanel.models.splits import by_horizon, recency_weight, walk_forward
from nitrapanel.operators import farm, states
from nitrapanel.operators.bundle import history_payload
from nitrapanel.operators.features import (
    build_features,
    complete_rows,
    daily_averages,
    daily_features,
    latest_complete,
)
from nitrapanel.operators.legacy import filled_backbone, filled_sheet
from nitrapanel.operators.quality import status_class
from nitrapanel.operators.signal import generate_signal
from nitrapanel.operators.simulate import bands, monte_carlo
from nitrapanel.sources import tables as t


def over_spine(name: str, keys: list[str], made: Callable[[], list[Column]], digits: int = 6) -> None:
    """A query of window expressions over the spine, checked against the feature SQL."""
    sql = ", ".join(f"{c.FEATURE_SQL[k]} AS {k}" for k in keys)
    case(
        name,
        lambda s, sf: c.spine(s, sf).select(KEY, MONTH, *[v.alias(k) for k, v in zip(keys, made(), strict=True)]),
        f"SELECT series, month, {sql} FROM spine {c.WINDOWS}",
        keep="series month",
        nums=" ".join(keys),
        digits=digits,
    )


def ng() -> Column:
    return F.col("ng_spot")


def urea() -> Column:
    return F.col("urea")


LAGS, SPANS = (1, 2, 3, 4, 5, 6, 9, 12), (3, 6, 12)
over_spine("w01_lag", [f"ng_lag{k}" for k in LAGS], lambda: [F.lag(ng(), k).over(win.by_series()) for k in LAGS])
over_spine(
    "w02_lead_targets",
    [f"target_urea_t{h}" for h in HORIZONS],
    lambda: [F.lead(urea(), h).over(win.by_series()) for h in HORIZONS],
)
over_spine(
    "w03_rolling_mean",
    [f"ng_rolling_mean_{n}m" for n in SPANS],
    lambda: [win.rolling_mean(ng(), win.by_series(), n) for n in SPANS],
)
over_spine(
    "w04_rolling_std",
    [f"ng_rolling_std_{n}m" for n in SPANS],
    lambda: [win.rolling_std(ng(), win.by_series(), n) for n in SPANS],
)
over_spine(
    "w05_rolling_extremes",
    ["urea_vs_12m_high", "urea_vs_12m_low"],
    lambda: [clean.ratio(urea(), f(urea(), win.by_series(), 12)) for f in (win.rolling_max, win.rolling_min)],
)
over_spine(
    "w06_change",
    [*(f"ng_mom_{k}m" for k in (1, 3, 6)), "urea_mom_3m"],
    lambda: [*(win.change(ng(), win.by_series(), k) for k in (1, 3, 6)), win.change(urea(), win.by_series(), 3)],
)
over_spine(
    "w07_rolling_zscore",
    [f"urea_zscore_{n}m" for n in (12, 24)],
    lambda: [win.rolling_zscore(urea(), win.by_series(), n) for n in (12, 24)],
)
over_spine("w08_expanding_zscore", ["storage_zscore"], lambda: [win.expanding_zscore(F.col("storage_mmcf"), win.by_series())])
case(
    "w09_daily_averages",
    lambda s, sf: daily_averages(t.order_days(s, sf)),
    "SELECT * FROM daily_ma",
    keep="series period",
    nums="ma30 ma60 ma90",
)
case(
    "w10_cross_overs",
    lambda s, sf: daily_features(t.order_days(s, sf)),
    "SELECT * FROM daily_feats",
    keep="series month",
    nums="ng_ma_cross_30_60 ng_ma_cross_30_90 ng_daily_vol_1m",
)
MEAN3, MEAN6 = c.full("ng_spot", "avg", 3), c.full("ng_spot", "avg", 6)
case(
    "w11_daily_proxies",
    lambda s, sf: build_features(c.spine(s, sf)),
    f"""SELECT series, month, {MEAN3} AS ng_ma30_eom, {MEAN6} AS ng_ma60_eom, {MEAN6} AS ng_ma90_eom,
        ({MEAN3}) / nullif({MEAN6}, 0) - 1 AS ng_ma_cross_30_60, ({MEAN3}) / nullif({MEAN6}, 0) - 1 AS ng_ma_cross_30_90,
        {c.full('ng_spot', 'stddev_samp', 3)} AS ng_daily_vol_1m FROM spine {c.WINDOWS}""",
    keep="series month",
    nums="ng_ma30_eom ng_ma60_eom ng_ma90_eom ng_ma_cross_30_60 ng_ma_cross_30_90 ng_daily_vol_1m",
)
case(
    "w12_limited_fill",
    lambda s, sf: filled_sheet(quoted(s, sf), ["urea", "dap"]),
    f"SELECT series, month, {limited('urea')}, {limited('dap')} FROM quoted",
    keep="series month",
    nums="urea dap",
)
case(
    "w13_unlimited_fill",
    lambda s, sf: filled_backbone(quoted(s, sf).select(KEY, F.col(MONTH).alias("period"), F.col("dap").alias("value"))),
    """SELECT series, month, last_value(dap IGNORE NULLS) OVER (PARTITION BY series ORDER BY month
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM quoted""",
    keep="series month",
    nums="value",
)
case(
    "w14_latest_complete",
    lambda s, sf: latest_complete(c.features(s, sf)),
    "SELECT * FROM latest",
    keep="series month",
    nums=" ".join([*FEATURE_COLS, "storage_mmcf"]),
    digits=5,
)
case(
    "w15_recency_weight",
    lambda s, sf: recency_weight(c.split(s, sf).where("role = 'train'"), [KEY, "horizon"]),
    "SELECT * FROM train_rows",
    keep="series month",
    ints="horizon",
    nums="weight",
)
case(
    "w16_duplicate_label",
    lambda s, sf: farm.crop_labels(crops(s, sf)),
    """SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id, crop_name) > 1
       THEN crop_name || ' (' || season || ')' ELSE crop_name END AS display_label FROM crop_state""",
    keep="crop_name season display_label",
    ints="user_id year",
    nums="acres",
)
case(
    "w17_walk_forward_folds",
    lambda s, sf: walk_forward(c.split(s, sf).where("role = 'train'"), [KEY, "horizon"]),
    """SELECT series, horizon, month, fold, pos, CASE WHEN pos < n - (5 - fold) * (n // 6) - 1 THEN 'train' ELSE 'valid' END
         AS fold_role
       FROM (SELECT series, horizon, month, row_number() OVER (PARTITION BY series, horizon ORDER BY month) - 1 AS pos,
               count(*) OVER (PARTITION BY series, horizon) AS n FROM split WHERE role = 'train')
       CROSS JOIN (SELECT unnest(range(5)) AS fold)
       WHERE pos < n - (5 - fold) * (n // 6) - 1
          OR (pos >= n - (5 - fold) * (n // 6) AND pos < n - (4 - fold) * (n // 6))""",
    keep="series month fold_role",
    ints="horizon fold pos",
)
NATION_ACRES = """SELECT n_name AS state, CASE n_regionkey WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
      WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' END AS series,
    coalesce(sum(abs(c_acctbal) * 1000) FILTER (c_mktsegment = 'MACHINERY'), 0) AS corn_acres,
    coalesce(sum(abs(c_acctbal) * 1000) FILTER (c_mktsegment = 'BUILDING'), 0) AS wheat_acres,
    coalesce(sum(abs(c_acctbal) * 1000) FILTER (c_mktsegment = 'FURNITURE'), 0) AS soy_acres
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
c.cte("nation_acreage", NATION_ACRES)
case(
    "w18_share_of_group",
    lambda s, sf: states.share_of_max(t.nation_acreage(s, sf), F.col("corn_acres"), [KEY]),
    "SELECT state, series, corn_acres / max(corn_acres) OVER (PARTITION BY series) AS share FROM nation_acreage",
    keep="state series",
    nums="share",
)

# X: scalar functions ---------------------------------------------------------------


def dates(spark: SparkSession, sf: str) -> DataFrame:
    m = clean.month_start(t.day("o_orderdate"))
    return t.table(spark, sf, "orders").select(
        "o_orderkey",
        clean.month_label(m).alias("label"),
        clean.month_iso(m).alias("iso"),
        clean.months_after(m, 2).alias("ahead"),
        clean.months_after(t.day("o_orderdate"), -3).alias("behind"),
        clean.label_month(clean.month_label(m)).alias("parsed"),
    )


case(
    "x01_month_arithmetic",
    dates,
    """SELECT o_orderkey, strftime(o_orderdate, '%b %Y') AS label, strftime(o_orderdate, '%Y-%m') AS iso,
       CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH AS DATE) AS ahead,
       CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS behind,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS parsed FROM orders""",
    keep="label iso ahead behind parsed",
    ints="o_orderkey",
)
over_spine(
    "x02_quarter_dummies",
    [f"season_q{q}" for q in (1, 2, 3, 4)],
    lambda: [(F.quarter(MONTH) == q).cast("int") for q in (1, 2, 3, 4)],
)
case(
    "x03_clip",
    lambda s, sf: t.table(s, sf, "customer").select(
        "c_custkey", clean.clip(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")), 100, 2000).alias("clipped")
    ),
    """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal IS NOT NULL
       THEN least(greatest(c_acctbal, 100), 2000) END AS clipped FROM customer""",
    ints="c_custkey",
    nums="clipped",
)
case(
    "x04_sign_and_round",
    lambda s, sf: t.table(s, sf, "customer").select(
        "c_custkey",
        F.signum(F.col("c_acctbal")).alias("sign"),
        F.abs(F.col("c_acctbal")).alias("size"),
        F.sqrt(F.abs(F.col("c_acctbal"))).alias("root"),
        F.pow(F.col("c_acctbal") / 1013, F.lit(2.0)).alias("square"),
        *[F.round(F.col("c_acctbal") / 1013, d).alias(f"r{d}") for d in (0, 1, 2, 3, 4)],
    ),
    """SELECT c_custkey, sign(c_acctbal) AS sign, abs(c_acctbal) AS size, sqrt(abs(c_acctbal)) AS root,
       pow(c_acctbal / 1013, 2) AS square, """
    + ", ".join(f"round(c_acctbal / 1013, {d}) AS r{d}" for d in (0, 1, 2, 3, 4))
    + " FROM customer",
    ints="c_custkey",
    nums="sign size root square r0 r1 r2 r3 r4",
)
case(
    "x05_seeded_normal",
    lambda s, sf: t.table(s, sf, "orders").select("o_orderkey", normal(F.col("o_orderkey"), 42).alias("z")),
    f"SELECT o_orderkey, {c.normal('o_orderkey', 42)} AS z FROM orders",
    ints="o_orderkey",
    nums="z",
)
ERF_T = "(1e0 / (1e0 + 0.3275911e0 * abs(x)))"
ERF = f"""sign(x) * (1e0 - (0.254829592e0 * {ERF_T} - 0.284496736e0 * pow({ERF_T}, 2) + 1.421413741e0 * pow({ERF_T}, 3)
   - 1.453152027e0 * pow({ERF_T}, 4) + 1.061405429e0 * pow({ERF_T}, 5)) * exp(-x * x))"""
case(
    "x06_chance_above",
    lambda s, sf: t.table(s, sf, "customer").select(
        "c_custkey",
        # Every tenth nation has no spread: the probability is a step there.
        chance_above(F.lit(4500.0), F.col("c_acctbal"), (F.col("c_nationkey") % 10).cast("double") * 150).alias("p"),
    ),
    f"""SELECT c_custkey, CASE WHEN sd <= 0 THEN CAST(c_acctbal > 4500 AS DOUBLE) ELSE 0.5e0 * (1e0 - ({ERF})) END AS p
        FROM (SELECT c_custkey, c_acctbal, (c_nationkey % 10) * 150e0 AS sd,
          (4500e0 - c_acctbal) / nullif((c_nationkey % 10) * 150e0 * sqrt(2e0), 0) AS x FROM customer)""",
    ints="c_custkey",
    nums="p",
)
case(
    "x07_fraction_grid",
    lambda s, sf: t.table(s, sf, "supplier").select(
        "s_suppkey",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: i / F.lit(200.0))).alias("step", "f"),
    ),
    "SELECT s_suppkey, i AS step, i / 200e0 AS f FROM supplier CROSS JOIN (SELECT unnest(range(201)) AS i)",
    ints="s_suppkey step",
    nums="f",
)
case(
    "x08_text",
    lambda s, sf: t.table(s, sf, "orders").select(
        "o_orderkey",
        F.lower("o_orderpriority").alias("low"),
        F.initcap(F.replace(F.lower(F.concat(F.lit("ORDER_"), F.col("o_orderstatus"))), F.lit("_"), F.lit(" "))).alias("title"),
        F.trim(F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" "))).alias("trimmed"),
    ),
    """SELECT o_orderkey, lower(o_orderpriority) AS low, 'Order ' || upper(o_orderstatus) AS title,
       trim('  ' || o_orderstatus || ' ') AS trimmed FROM orders""",
    keep="low title trimmed",
    ints="o_orderkey",
)
TEXTS = "key_driver forecast_summary recommendation rationale"
PCT = "(t2 - current) / current"
SIGNAL_SQL = f"CASE WHEN {PCT} > 0.08 AND prob_rising_t2 > 0.65 THEN 'BUY_NOW' WHEN {PCT} > 0.04 OR prob_rising_t2 > 0.55 " \
    f"THEN 'CONSIDER_BUYING' WHEN {PCT} < -0.04 AND prob_rising_t2 < 0.40 THEN 'WAIT' ELSE 'NEUTRAL' END"
c.cte(
    "signals",
    f"""SELECT *, CASE signal WHEN 'BUY_NOW' THEN 'HIGH' WHEN 'CONSIDER_BUYING' THEN 'MODERATE' ELSE 'LOW' END AS urgency,
      CASE signal WHEN 'BUY_NOW' THEN 'Buy Now' WHEN 'CONSIDER_BUYING' THEN 'Consider Buying' WHEN 'WAIT' THEN 'Wait'
        ELSE 'Neutral' END AS recommendation,
      CASE signal
        WHEN 'BUY_NOW' THEN printf('Urea prices are forecast to rise %.0f%% over the next 60 days with %.0f%% probability. Consider purchasing inputs soon.', pct * 100, prob_rising_t2 * 100)
        WHEN 'CONSIDER_BUYING' THEN printf('Prices lean upward (%+.0f%% forecast at 60 days) but uncertainty is moderate. Partial pre-purchase may make sense.', pct * 100)
        WHEN 'WAIT' THEN printf('Prices are forecast to soften (%.0f%% over 60 days). Waiting may reduce your input costs.', pct * 100)
        ELSE 'No strong price signal. Urea prices expected to remain stable. Monitor weekly and act if nat gas moves more than 10% in either direction.'
      END AS rationale,
      printf('Nat gas %s %.0f%% in 30 days', CASE WHEN ng_mom_1m >= 0 THEN 'up' ELSE 'down' END, abs(ng_mom_1m) * 100) AS key_driver,
      printf('Urea forecast: $%.0f/mt in 60 days (%+.0f%%) — 80%% range: $%.0f–$%.0f', p50_t2, pct * 100, p10_t2, p90_t2) AS forecast_summary,
      round(CASE WHEN signal = 'WAIT' THEN 1 - prob_rising_t2 ELSE prob_rising_t2 END, 2) AS confidence,
      round(current, 1) AS current_price,
      CASE WHEN p50_t1 <= p50_t2 AND p50_t1 <= p50_t3 THEN 'Next month' WHEN p50_t2 <= p50_t3 THEN 'In 2 months'
        ELSE 'In 3 months' END AS best_month,
      round(least(p50_t1, p50_t2, p50_t3), 0) AS best_price,
      round(p50_t1, 1) AS forecast_t1, round(p50_t2, 1) AS forecast_t2, round(p50_t3, 1) AS forecast_t3,
      round(prob_rising_t2, 2) AS prob_rising, round(ng_spot, 2) AS ng_current, round(ng_mom_1m, 4) AS ng_change_30d
      FROM (SELECT *, {PCT} AS pct, {SIGNAL_SQL} AS signal FROM mc)""",
)
case(
    "x09_signal_texts",
    lambda s, sf: generate_signal(monte_carlo(c.forecast_rows(s, sf))),
    "SELECT * FROM signals",
    keep="series " + TEXTS,
)
case(
    "x10_json",
    lambda s, sf: t.table(s, sf, "events").select(
        "event_id",
        F.from_json("props", "k int")["k"].alias("k"),
        F.get_json_object(F.to_json(F.struct(F.struct("user_id", "event_type").alias("who"))), "$.who.event_type").alias("kind"),
    ),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type AS kind FROM events",
    keep="kind",
    ints="event_id k",
)


def history_arrays(spark: SparkSession, sf: str) -> DataFrame:
    h = history_payload(c.spine(spark, sf), t.HISTORY_START)
    pairs = F.arrays_zip(F.col("urea_history.labels").alias("label"), F.col("urea_history.values").alias("value"))
    return h.select(KEY, F.posexplode(pairs).alias("pos", "p")).select(KEY, "pos", "p.label", "p.value")


case(
    "x11_ordered_arrays",
    history_arrays,
    f"""SELECT series, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS pos, strftime(month, '%b %Y') AS label,
        round(urea, 2) AS value FROM spine WHERE urea IS NOT NULL AND ng_spot IS NOT NULL AND month >= DATE '{t.HISTORY_START}'""",
    keep="series label",
    ints="pos",
    nums="value",
)
WORDS = ["Pass", "success", "WARN", "fail", "Runtime Error"]
case(
    "x12_status_class",
    lambda s, sf: t.table(s, sf, "events")
    .select("event_id", F.try_element_at(F.array(*[F.lit(x) for x in WORDS]), (F.col("user_id") % 7 + 1).cast("int")).alias("status"))
    .select("event_id", "status", status_class(F.col("status")).alias("status_class")),
    """SELECT event_id, status, CASE WHEN lower(status) IN ('pass', 'success') THEN 'ok' WHEN lower(status) = 'warn' THEN 'warn'
       WHEN lower(status) IN ('fail', 'error', 'runtime error') THEN 'bad' ELSE 'unknown' END AS status_class
       FROM (SELECT event_id, ['Pass', 'success', 'WARN', 'fail', 'Runtime Error'][user_id % 7 + 1] AS status FROM events)""",
    keep="status status_class",
    ints="event_id",
)
case(
    "x13_direction_label",
    lambda s, sf: by_horizon(complete_rows(c.features(s, sf), True), ["urea"]),
    "SELECT * FROM by_horizon",
    keep="series month target_month",
    ints="horizon label",
    nums="target",
)


def exposure(spark: SparkSession, sf: str, by: str) -> DataFrame:
    return states.state_exposure(t.nation_acreage(spark, sf), F.lit(PRICE), F.lit(PRICE * 1.07), by=by)


def encoded(by: str, floor: str) -> str:
    value = "urea_mt" if by == "urea_mt" else "abs(impact_m)"
    return f"""SELECT *, greatest({value} / max({value}) OVER () * 500000e0, {floor}) AS elevation,
      CAST(trunc({value} / max({value}) OVER () * 255) AS INTEGER) AS color_r,
      CAST(trunc(least(greatest(255e0 - {value} / max({value}) OVER () * 200, 0), 255)) AS INTEGER) AS color_g,
      30 AS color_b, 210 AS color_a, '{by}' AS mode FROM state_costs"""


c.cte(
    "state_costs",
    f"""SELECT *, urea_mt * {PRICE}e0 / 1e6 AS current_cost_m, urea_mt * ({PRICE}e0 * 1.07e0) / 1e6 AS forecast_cost_m,
      urea_mt * ({PRICE}e0 * 1.07e0) / 1e6 - urea_mt * {PRICE}e0 / 1e6 AS impact_m FROM (
      SELECT *, (corn_acres * 150 + wheat_acres * 90 + soy_acres * 60) / (0.46e0 * 2204.6e0) AS urea_mt FROM nation_acreage)""",
)
case(
    "x14_map_encoding",
    lambda s, sf: exposure(s, sf, "urea_mt")
    .withColumn("mode", F.lit("urea_mt"))
    .unionByName(exposure(s, sf, "impact_m").withColumn("mode", F.lit("impact_m"))),
    f"{encoded('urea_mt', '0e0')} UNION ALL {encoded('impact_m', '1000e0')}",
    keep="state mode",
    ints="color_r color_g color_b color_a",
    nums="elevation",
    digits=3,
)
case(
    "f07_season_and_year",
    lambda s, sf: farm.select_crops(crops(s, sf), ["Spring"], 2024),
    "SELECT * FROM crop_state WHERE season IN ('Spring') AND year = 2024",
    keep="crop_name season",
    ints="user_id year",
    nums="acres",
)
c.cte("risks", "SELECT unnest(['Conservative', 'Balanced', 'Aggressive']) AS risk, unnest([0.75e0, 0.45e0, 0.15e0]) AS alpha")
c.cte(
    "hedge_prices",
    """SELECT series, horizon, round(current, 1) AS current, avg(p) AS exp_price, quantile_cont(p, 0.1) AS p10_price, quantile_cont(p, 0.9) AS p90_price
      FROM (SELECT b.series, b.horizon, b.current, least(greatest(b.p50 + b.residual_std * d.z, 50e0), 2000e0) AS p
            FROM bands b JOIN draws d ON d.stream = 1) GROUP BY 1, 2, 3""",
)


def _split_grid(spark: SparkSession, sf: str) -> DataFrame:
    return farm.objective_curve(farm.hedge_prices(bands(c.forecast_rows(spark, sf))))


case(
    "j09_split_grid",
    lambda s, sf: _split_grid(s, sf),
    """SELECT series, horizon, risk, i / 200e0 AS fraction,
         (1 - alpha) * (i / 200e0 * current + (1 - i / 200e0) * exp_price)
         + alpha * (i / 200e0 * current + (1 - i / 200e0) * p90_price) AS objective
       FROM hedge_prices CROSS JOIN risks CROSS JOIN (SELECT unnest(range(201)) AS i)""",
    keep="series risk",
    ints="horizon",
    nums="fraction objective",
    digits=5,
)
