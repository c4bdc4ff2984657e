"""Sources, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.catalog import common as c
from nitrapanel.catalog.base import case
from nitrapanel.constants import FEATURE_COLS, KEY, MEASURES, MONTH, TARGET_COLS
from nitrapanel.functions.clean import month_start, ratio, to_date, to_double
from nitrapanel.operators import farm, legacy, quality, staging
from nitrapanel.operators.features import complete_rows, daily_features
from nitrapanel.operators.lag import aligned, lagged_pairs
from nitrapanel.operators.simulate import simulate_paths
from nitrapanel.operators.spine import reindex_months
from nitrapanel.operators.states import share_of_max
from nitrapanel.session import materialize, scratch_path
from nitrapanel.sources import feeds as readers
from nitrapanel.sources import landing
from nitrapanel.sources import tables as t
from nitrapanel.sources.resolve import known_rows, publish, resolve
from nitrapanel.sources.versions import read_version

NUM_PANEL = " ".join(MEASURES)


# C: sources and sinks ---------------------------------------------------------


def api_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a one-row response page on a line of JSON files, read through the page reader."""
    k = F.get_json_object("props", "$.k")
    row = F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("period"),
        # Ten keys stand for rows whose value is not reported.
        F.when(k.cast("int") >= 10, F.col("value").cast("string")).alias("value"),
        F.concat(F.lit("K"), k).alias("series"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("duoarea"),
        F.col("event_type").alias("process"),
    )
    page = F.to_json(F.struct(F.struct(F.array(row).alias("data")).alias("response")))
    path = scratch_path(spark, "pages")
    t.table(spark, sf, "events").select(page.alias("page")).write.text(path)
    return readers.read_api_pages(spark, path, {"process": "purchase"}, one_file_each=False)


case(
    "c01_api_pages",
    api_pages,
    """SELECT 'K' || json_extract_string(props, '$.k') AS series, 'U' || user_id AS duoarea, event_type AS process,
       CAST(ts AS DATE) AS period, value FROM events
       WHERE event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 10 AND value IS NOT NULL""",
    keep="series duoarea process period",
    nums="value",
)


def quoted(spark: SparkSession, sf: str) -> DataFrame:
    return t.quoted_sheet_of(t.ship_days(spark, sf))


def csv_file(df: DataFrame, name: str) -> str:
    """``df`` written as a delimited sheet with a header; returns its path."""
    path = f"{scratch_path(df.sparkSession, 'sheet')}/{name}"
    df.write.option("header", True).csv(path)
    return path


def csv_text(spark: SparkSession, sf: str) -> DataFrame:
    price = F.coalesce(F.col("urea").cast("string"), F.lit(".."))
    return quoted(spark, sf).select(KEY, F.date_format(MONTH, "yyyy-MM").alias("Month"), price.alias("Price"))


def sheet_text(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet text with the period code; months without urea carry an unreadable code."""
    code = F.when(F.col("urea").isNull(), "n/a").otherwise(F.date_format(MONTH, "yyyy'M'MM"))
    price = [F.coalesce(F.col(x).cast("string"), F.lit("..")) for x in ("urea", "dap")]
    return quoted(spark, sf).select(KEY, code.alias("period"), price[0].alias("Urea "), price[1].alias("DAP"))


def price_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Two vintages of the sheet; the older one has other prices and must not be picked."""
    now = sheet_text(spark, sf)
    old = now.withColumn("DAP", F.lit("1.0")).withColumn("Urea ", F.lit("2.0"))
    return readers.read_price_sheet(spark, [csv_file(now, "prices-2002-02"), csv_file(old, "prices-2001-11")])


case(
    "c02_monthly_csv",
    lambda s, sf: readers.read_monthly_csv(s, csv_file(csv_text(s, sf), "monthly")),
    "SELECT series, month AS period, urea AS value FROM quoted WHERE urea IS NOT NULL",
    keep="series period",
    nums="value",
)
case(
    "c03_monthly_csv_filled",
    lambda s, sf: legacy.filled_backbone(readers.read_monthly_csv(s, csv_file(csv_text(s, sf), "monthly"), keep_missing=True)),
    """SELECT series, month, last_value(urea IGNORE NULLS) OVER (PARTITION BY series ORDER BY month
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM quoted""",
    keep="series month",
    nums="value",
)
case(
    "c04_price_sheet",
    price_sheet,
    "SELECT series, month AS period, urea, dap FROM quoted WHERE urea IS NOT NULL",
    keep="series period",
    nums="urea dap",
)


def limited(c_: str) -> str:
    return f"""coalesce({c_}, last_value({c_} IGNORE NULLS) OVER (PARTITION BY series ORDER BY month
       ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS {c_}"""


case(
    "c05_price_sheet_filled",
    lambda s, sf: legacy.filled_sheet(quoted(s, sf), ["urea", "dap"]),
    f"SELECT series, month, {limited('urea')}, {limited('dap')} FROM quoted",
    keep="series month",
    nums="urea dap",
)


def storage_text(spark: SparkSession, sf: str) -> DataFrame:
    b = t.storage_backbone_of(t.ship_days(spark, sf))
    return b.select(
        KEY,
        F.col("period").cast("string").alias("Date"),
        F.lit("0").alias("Base Gas (MMcf)"),
        F.col("value").cast("string").alias("U.S. Working Gas (MMcf)"),
    )


def daily_text(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sheet text; Sundays carry an unreadable price."""
    price = F.when(F.dayofweek("period") == 1, "..").otherwise(F.col("value").cast("string"))
    return t.order_days(spark, sf).select(KEY, F.col("period").cast("string").alias("Date"), price.alias("Price"))


case(
    "c06_storage_sheet",
    lambda s, sf: readers.read_storage_sheet(s, csv_file(storage_text(s, sf), "storage")),
    "SELECT series, period, value FROM storage_backbone",
    keep="series period",
    nums="value",
)
case(
    "c07_daily_sheet",
    lambda s, sf: readers.read_daily_sheet(s, csv_file(daily_text(s, sf), "daily")),
    "SELECT series, period, value FROM spot_daily WHERE dayofweek(period) <> 0",
    keep="series period",
    nums="value",
)


RECENT = "1996-01-01"


def land_report(spark: SparkSession, sf: str) -> DataFrame:
    """Two landings of three tables, the second of recent rows only; the first is still read after the second."""
    f = t.landed_feeds(spark, sf)
    named = {"daily": f.daily, "backbone": f.backbone, "weekly": f.weekly_bcf}
    root = scratch_path(spark, "raw")
    before = {name: landing.land_raw(df, root, name) for name, df in named.items()}
    for name, df in named.items():
        landing.land_raw(df.where(F.col("period") >= F.lit(RECENT).cast("date")), root, name)
    after = {name: read_version(spark, root, name) for name in named}
    lines = [landing.report(name, df).withColumn("version", F.lit(v)) for v, landed in ((1, before), (2, after)) for name, df in landed.items()]
    return quality.union_all(lines)


def report_sql(names: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, min(period) AS first_period, max(period) AS last_period FROM {x}"
        for n, x in names.items()
    )


case(
    "c08_land_report",
    land_report,
    f"""SELECT 1 AS version, * FROM ({report_sql({"daily": "spot_daily", "backbone": "backbone", "weekly": "weekly"})})
        UNION ALL SELECT 2, * FROM ({report_sql({n: f"(SELECT * FROM {x} WHERE period >= DATE '{RECENT}')" for n, x in (("daily", "spot_daily"), ("backbone", "backbone"), ("weekly", "weekly"))})})""",
    keep="table_name first_period last_period",
    ints="version n_rows",
)


def land_subset(spark: SparkSession, sf: str) -> DataFrame:
    f = t.lazy_feeds(spark, sf)
    registry = {"daily": lambda: f.daily, "backbone": lambda: f.backbone, "weekly": lambda: f.weekly_bcf}
    stamps = {"daily": {"series_id": "live", "source": "orders"}}
    return landing.land_all(registry, scratch_path(spark, "raw"), only={"daily"}, provenance=stamps)


case(
    "c09_land_subset",
    land_subset,
    report_sql({"daily": "spot_daily"}),
    keep="table_name first_period last_period",
    ints="n_rows",
)
case(
    "c10_table_scan",
    lambda s, sf: landing.scan(s, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_totalprice"]),
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders",
    keep="o_orderpriority",
    ints="o_orderkey",
    nums="o_totalprice",
)


def feature_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "feature_store")
    landing.write_feature_store(c.features(spark, sf), path)
    return landing.read_feature_store(spark, path)


case(
    "c11_feature_store",
    feature_store,
    "SELECT * FROM features",
    keep="series month",
    nums=" ".join([*FEATURE_COLS, "storage_mmcf", *TARGET_COLS]),
    digits=5,
)


def both_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Once the first source is missing, once it is there with half the prices."""
    path = scratch_path(spark, "mart")
    sources = {"mart": lambda: spark.read.parquet(path), "local": lambda: t.order_days(spark, sf)}
    missing = materialize(resolve("auto", sources, say=lambda _: None), "fallback")
    missing.withColumn("value", F.col("value") / 2).write.parquet(path)
    present = resolve("auto", sources, say=lambda _: None)
    return missing.withColumn("picked", F.lit("local")).unionByName(present.withColumn("picked", F.lit("mart")))


case(
    "c12_source_fallback",
    both_branches,
    """SELECT series, period, value, 'local' AS picked FROM spot_daily
       UNION ALL SELECT series, period, value / 2, 'mart' FROM spot_daily""",
    keep="series period picked",
    nums="value",
)

def both_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """A model published as a view and as a table; of the table the catalog knows the rows.

    The table is published twice, first with half of the prices: the name shows the later version.
    """
    days, root = materialize(t.order_days(spark, sf), "order_days"), scratch_path(spark, "published")
    table = f"spot_daily_{root[-8:]}"
    publish(days.where("value > 100"), table, root)
    made = {"view": publish(days, "spot_daily_view"), "table": publish(days, table, root)}
    known = {"view": None, "table": known_rows(spark, table)}
    return quality.union_all(
        [df.withColumn("kind", F.lit(kind)).withColumn("known", F.lit(known[kind]).cast("long")) for kind, df in made.items()]
    )


case(
    "c13_published_view",
    both_kinds,
    """SELECT kind, series, period, value, CASE WHEN kind = 'table' THEN n END AS known FROM spot_daily
       CROSS JOIN (SELECT count(*) AS n FROM spot_daily) CROSS JOIN (SELECT unnest(['view', 'table']) AS kind)""",
    keep="kind series period",
    ints="known",
    nums="value",
)

# F: filters and projections ----------------------------------------------------

case(
    "f01_not_null_rows",
    lambda s, sf: staging.observed(t.sheet_of(t.ship_days(s, sf)), "period", "urea"),
    "SELECT series, period, urea FROM sheet WHERE period IS NOT NULL AND urea IS NOT NULL",
    keep="series period",
    nums="urea",
)
case(
    "f02_month_snap",
    lambda s, sf: t.table(s, sf, "orders").select("o_orderkey", month_start(t.day("o_orderdate")).alias("month")),
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders",
    keep="month",
    ints="o_orderkey",
)
case(
    "f03_lenient_casts",
    lambda s, sf: t.table(s, sf, "events").select(
        "event_id",
        to_double(F.col("event_type")).alias("word"),
        to_double(F.get_json_object("props", "$.k")).alias("k"),
        to_date(F.col("event_type")).alias("bad_date"),
        to_date(F.col("ts").cast("string")).alias("good_date"),
    ),
    """SELECT event_id, try_cast(event_type AS DOUBLE) AS word, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       try_cast(event_type AS DATE) AS bad_date, CAST(ts AS DATE) AS good_date FROM events""",
    keep="bad_date good_date",
    ints="event_id",
    nums="word k",
)
case(
    "f04_unit_scale",
    lambda s, sf: t.weekly_of(t.ship_days(s, sf)).withColumn("storage_mmcf", F.col("value") * F.lit(1000.0)),
    "SELECT series, period, value * 1000e0 AS storage_mmcf FROM weekly",
    keep="series period",
    nums="storage_mmcf",
)
case(
    "f05_priority_tag",
    lambda s, sf: staging.tagged(staging.monthly_mean(t.order_days(s, sf)), staging.LIVE),
    "SELECT series, month, value, 1 AS source_priority FROM live_ng",
    keep="series month",
    ints="source_priority",
    nums="value",
)
case(
    "f06_date_range",
    lambda s, sf: t.table(s, sf, "orders")
    .where(F.col("o_orderdate").between("1998-01-01", "1999-12-31"))
    .select("o_orderkey", t.day("o_orderdate").alias("period"), "o_totalprice"),
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS period, o_totalprice FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31'""",
    keep="period",
    ints="o_orderkey",
    nums="o_totalprice",
)
case(
    "f08_complete_rows",
    lambda s, sf: complete_rows(c.features(s, sf), True),
    f"SELECT series, month, urea, target_urea_t3 FROM features WHERE {c.TRAINABLE}",
    keep="series month",
    nums="urea target_urea_t3",
)
case(
    "f09_guarded_ratio",
    lambda s, sf: t.table(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", ratio(F.col("l_extendedprice"), F.col("l_discount")).alias("r")
    ),
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_discount, 0) AS r FROM lineitem",
    ints="l_orderkey l_linenumber l_partkey",
    nums="r",
    digits=3,
)
case(
    "f10_rename",
    lambda s, sf: t.table(s, sf, "orders")
    .withColumnsRenamed({"o_orderkey": "order_key", "o_totalprice": "total_price", "o_orderstatus": "order_status"})
    .drop("o_orderdate", "o_custkey", "o_orderpriority"),
    "SELECT o_orderkey AS order_key, o_orderstatus AS order_status, o_totalprice AS total_price FROM orders",
    keep="order_status",
    ints="order_key",
    nums="total_price",
)

# J: joins ------------------------------------------------------------------------

case("j01_panel", c.panel, "SELECT * FROM panel", keep="series month", nums=NUM_PANEL)
case(
    "j02_daily_join",
    lambda s, sf: _daily_join(s, sf),
    "SELECT * FROM spine LEFT JOIN daily_feats USING (series, month)",
    keep="series month",
    nums="ng_spot ng_ma30_eom ng_ma60_eom ng_ma90_eom ng_daily_vol_1m",
)


def _daily_join(spark: SparkSession, sf: str) -> DataFrame:
    f = c.feeds(spark, sf)
    return c.spine_panel(f).join(daily_features(f.daily), [KEY, MONTH], "left")


def both_spines(spark: SparkSession, sf: str) -> DataFrame:
    """Gap-free quoted sheet under both end rules."""
    sheet = quoted(spark, sf)
    any_ = reindex_months(sheet, end_rule="any", shared=True).withColumn("rule", F.lit("any"))
    shortest = reindex_months(sheet, end_rule="shortest").withColumn("rule", F.lit("shortest"))
    return any_.unionByName(shortest)


case(
    "j03_month_spine",
    both_spines,
    """SELECT k.rule, k.series, k.month, urea, dap FROM (
         SELECT 'any' AS rule, series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
         FROM (SELECT DISTINCT series FROM quoted),
           (SELECT min(month) AS lo, max(month) FILTER (urea IS NOT NULL OR dap IS NOT NULL) AS hi FROM quoted)
         UNION ALL
         SELECT 'shortest', series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE)
         FROM (SELECT series, min(month) AS lo, least(max(month) FILTER (urea IS NOT NULL), max(month) FILTER (dap IS NOT NULL)) AS hi
               FROM quoted GROUP BY series)) k
       LEFT JOIN quoted q ON q.series = k.series AND q.month = k.month""",
    keep="rule series month",
    nums="urea dap",
)
case(
    "j04_both_present",
    lambda s, sf: _live(s, sf)
    .withColumnRenamed("value", "live")
    .join(_local(s, sf).withColumnRenamed("value", "local"), [KEY, MONTH]),
    "SELECT a.series, a.month, a.value AS live, b.value AS local FROM live_ng a "
    "JOIN backbone b ON a.series = b.series AND a.month = b.period",
    keep="series month",
    nums="live local",
)


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return staging.monthly_mean(t.order_days(spark, sf))


def _local(spark: SparkSession, sf: str) -> DataFrame:
    return t.backbone_of(t.ship_days(spark, sf)).withColumnRenamed("period", MONTH)


def one_sided(spark: SparkSession, sf: str) -> DataFrame:
    live, local = materialize(_live(spark, sf), "live"), materialize(_local(spark, sf), "local")
    a = quality.rows_only_in(live, local, [KEY, MONTH]).withColumn("side", F.lit("live"))
    return a.unionByName(quality.rows_only_in(local, live, [KEY, MONTH]).withColumn("side", F.lit("local")))


ONE_SIDED = """SELECT series, month, 'live' AS side, value FROM live_ng a WHERE NOT EXISTS (
    SELECT 1 FROM backbone b WHERE b.series = a.series AND b.period = a.month)
  UNION ALL
  SELECT series, period, 'local', value FROM backbone b WHERE NOT EXISTS (
    SELECT 1 FROM live_ng a WHERE b.series = a.series AND b.period = a.month)"""
case("j05_one_sided_rows", one_sided, ONE_SIDED, keep="series month side", nums="value")


def overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted urea as a backbone with holes, live gas prices over it."""
    holes = quoted(spark, sf).where(F.col("urea").isNotNull())
    return legacy.overlay_live(holes.select(KEY, MONTH, F.col("urea").alias("value")), _live(spark, sf))


case(
    "j06_overlay_live",
    overlay,
    """SELECT b.series, b.month, coalesce(l.value, b.value) AS value
       FROM (SELECT series, month, urea AS value FROM quoted WHERE urea IS NOT NULL) b
       LEFT JOIN live_ng l USING (series, month)
       UNION ALL
       SELECT l.series, l.month, l.value FROM live_ng l JOIN (SELECT series, max(month) AS m FROM quoted
         WHERE urea IS NOT NULL GROUP BY 1) e ON e.series = l.series AND l.month > e.m""",
    keep="series month",
    nums="value",
)
N_LBS = "CASE crop_name WHEN 'Corn' THEN 150 WHEN 'Wheat' THEN 90 WHEN 'Cotton' THEN 120 WHEN 'Sorghum' THEN 80 " \
    "WHEN 'Soybeans' THEN 60 WHEN 'Hay' THEN 50 END"
case(
    "j07_crop_lookup",
    lambda s, sf: t.farms(s, sf).select(
        "farm_id",
        "crop_name",
        farm.n_intensity(F.col("crop_name")).alias("cost_lbs"),
        farm.n_intensity(F.col("crop_name"), 0).alias("card_lbs"),
    ),
    f"SELECT farm_id, crop_name, coalesce({N_LBS}, 100) AS cost_lbs, coalesce({N_LBS}, 0) AS card_lbs FROM farms",
    keep="crop_name",
    ints="farm_id",
    nums="cost_lbs card_lbs",
)
case(
    "j08_path_grid",
    lambda s, sf: simulate_paths(c.forecast_rows(s, sf))
    .groupBy(KEY, "horizon")
    .agg(F.count("*").alias("n"), F.min("sim").alias("lo"), F.max("sim").alias("hi"), F.avg("sim").alias("mean")),
    """SELECT series, horizon, count(*) AS n, min(sim) AS lo, max(sim) AS hi, avg(sim) AS mean
       FROM paths GROUP BY 1, 2""",
    keep="series",
    ints="horizon n",
    nums="lo hi mean",
    digits=5,
)
case(
    "j10_lagged_pairs",
    lambda s, sf: lagged_pairs(aligned(c.spine(s, sf))),
    """SELECT a.series, a.month, a.urea, k AS lag, b.ng_spot AS ng FROM pairs a
       CROSS JOIN (SELECT unnest(range(13)) AS k)
       JOIN pairs b ON b.series = a.series AND b.pos = a.pos - k""",
    keep="series month",
    ints="lag",
    nums="urea ng",
)
case(
    "j11_group_max",
    lambda s, sf: share_of_max(
        t.table(s, sf, "customer").select("c_custkey", "c_nationkey", F.abs("c_acctbal").alias("bal")),
        F.col("bal"),
        ["c_nationkey"],
    ),
    """SELECT c_custkey, c_nationkey, abs(c_acctbal) AS bal,
       abs(c_acctbal) / max(abs(c_acctbal)) OVER (PARTITION BY c_nationkey) AS share FROM customer""",
    ints="c_custkey c_nationkey",
    nums="bal share",
)

# S: sorts, limits, set operations --------------------------------------------------

case(
    "s01_ordered_panel",
    lambda s, sf: c.panel(s, sf).orderBy(KEY, MONTH),
    "SELECT * FROM panel",
    keep="series month",
    nums="ng_spot urea",
)
case(
    "s02_top_exposure",
    lambda s, sf: t.farms(s, sf)
    .select("farm_id", farm.urea_mt(F.col("acres") * farm.n_intensity(F.col("crop_name"))).alias("urea_mt"))
    .orderBy(F.desc("urea_mt"), "farm_id")
    .limit(25),
    f"""SELECT farm_id, acres * coalesce({N_LBS}, 100) / (0.46e0 * 2204.6e0) AS urea_mt FROM farms
        ORDER BY urea_mt DESC, farm_id LIMIT 25""",
    ints="farm_id",
    nums="urea_mt",
)
case(
    "s03_every_tenth_path",
    lambda s, sf: simulate_paths(c.forecast_rows(s, sf).where("horizon = 2")).where(F.col("path_id") % 10 == 0),
    "SELECT series, path_id, sim FROM paths WHERE horizon = 2 AND path_id % 10 = 0",
    keep="series",
    ints="path_id",
    nums="sim",
    digits=5,
)
case(
    "s04_diff_preview",
    lambda s, sf: quality.parity_preview(
        _live(s, sf).withColumnRenamed("value", "ng_spot"), _local(s, sf).withColumnRenamed("value", "ng_spot"), ["ng_spot"]
    ),
    """SELECT * FROM (SELECT a.series, a.month, 'ng_spot' AS "column", a.value AS left_value, b.value AS right_value,
         row_number() OVER (ORDER BY a.series, a.month) AS rn FROM live_ng a
         JOIN backbone b ON a.series = b.series AND a.month = b.period WHERE abs(a.value - b.value) > 1e-6) WHERE rn <= 10""",
    keep="series month",
    ints="rn",
    nums="left_value right_value",
)
case(
    "s05_month_set",
    lambda s, sf: staging.month_set(_live(s, sf), _local(s, sf)),
    "SELECT series, month FROM live_ng UNION SELECT series, period FROM backbone",
    keep="series month",
)
case(
    "s06_prioritised_union",
    lambda s, sf: staging.tagged(_live(s, sf), 1).unionByName(staging.tagged(_local(s, sf), 2)),
    """SELECT series, month, value, 1 AS source_priority FROM live_ng
       UNION ALL SELECT series, period, value, 2 FROM backbone""",
    keep="series month",
    ints="source_priority",
    nums="value",
)


def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _live(spark, sf).select(KEY, MONTH), _local(spark, sf).select(KEY, MONTH)
    parts = {"both": a.intersect(b), "live_only": a.exceptAll(b), "local_only": b.exceptAll(a)}
    return quality.union_all([df.withColumn("part", F.lit(name)) for name, df in parts.items()])


case(
    "s07_set_overlap",
    set_overlap,
    """SELECT series, month, 'both' AS part FROM (SELECT series, month FROM live_ng INTERSECT SELECT series, period FROM backbone)
       UNION ALL SELECT series, month, 'live_only' FROM
         (SELECT series, month FROM live_ng EXCEPT ALL SELECT series, period FROM backbone)
       UNION ALL SELECT series, period, 'local_only' FROM
         (SELECT series, period FROM backbone EXCEPT ALL SELECT series, month FROM live_ng)""",
    keep="series month part",
)
