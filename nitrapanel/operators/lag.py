"""Lead-lag analysis of gas and urea per series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, MONTH
from nitrapanel.functions.stats import correlation, strength
from nitrapanel.functions.windows import by_series
from nitrapanel.session import ship_package

MAX_LAG = 12
WINDOW, STEP = 36, 12
COVERED_LAGS = 4


def aligned(panel: DataFrame) -> DataFrame:
    """Months where both series hold a value."""
    return panel.select(KEY, MONTH, "urea", "ng_spot").dropna(subset=["urea", "ng_spot"])


def positioned(pairs: DataFrame) -> DataFrame:
    k = Window.partitionBy(KEY)
    return pairs.withColumn("pos", F.row_number().over(k.orderBy(MONTH)) - 1).withColumn("n", F.count("*").over(k))


def lagged_pairs(pairs: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Long form: urea at t with gas at t - lag, by position."""
    w = by_series()
    lags = F.array(
        *[F.struct(F.lit(k).alias("lag"), F.lag("ng_spot", k).over(w).alias("ng")) for k in range(max_lag + 1)]
    )
    wide = pairs.select(KEY, MONTH, "urea", lags.alias("lags"))
    long = wide.select(KEY, MONTH, "urea", F.explode("lags").alias("x"))
    return long.select(KEY, MONTH, "urea", "x.lag", "x.ng").where(F.col("ng").isNotNull())


def cross_correlation(pairs: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Correlation per lag; all lags come from one window and one aggregation."""
    w = by_series()
    wide = pairs.select(KEY, "urea", *[F.lag("ng_spot", k).over(w).alias(f"ng{k}") for k in range(max_lag + 1)])
    per_lag = wide.groupBy(KEY).agg(
        *[correlation(F.col("urea"), F.col(f"ng{k}")).alias(f"r{k}") for k in range(max_lag + 1)]
    )
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(max_lag + 1)])
    return per_lag.select(KEY, F.explode(entries).alias("x")).select(KEY, "x.lag", "x.r")


def peak_lag(correlations: DataFrame) -> DataFrame:
    """Lag with the highest signed correlation, the lowest lag on a tie."""
    order = F.when(F.col("r").isNotNull(), F.struct(F.col("r"), -F.col("lag")))
    best = correlations.groupBy(KEY).agg(F.max_by(F.struct("lag", "r"), order).alias("b"))
    return best.select(KEY, F.col("b.lag").alias("peak_lag"), F.col("b.r").alias("peak_r"))


def lag_scan(panel: DataFrame, max_lag: int = MAX_LAG, covered: int = COVERED_LAGS) -> DataFrame:
    """Peak lag per series and whether lags up to ``covered`` reach it."""
    peak = F.col("peak_lag")
    verdict = F.when(peak <= covered, "covered").when(peak.isNotNull(), F.format_string("add lags %d..%d", F.lit(covered + 1), peak))
    return peak_lag(cross_correlation(aligned(panel), max_lag)).withColumn("verdict", verdict)


def window_correlation(pairs: DataFrame, peak: DataFrame) -> DataFrame:
    """Correlation in 36-row blocks starting every 12 rows, gas shifted by the peak lag."""
    numbered = positioned(pairs)
    shifted = numbered.join(peak.select(KEY, "peak_lag"), KEY).select(
        KEY, (F.col("pos") + F.col("peak_lag")).alias("pos"), F.col("ng_spot").alias("ng")
    )
    rows = numbered.join(shifted, [KEY, "pos"], "left")
    pos, n = F.col("pos"), F.col("n")
    # Block starts 0, 12, 24, ... below n - 36 whose block covers this row.
    first = F.greatest(F.ceil((pos - (WINDOW - 1)) / STEP), F.lit(0).cast("bigint"))
    last = F.least(F.floor(pos / STEP), F.floor((n - WINDOW - 1) / STEP))
    starts = F.when((n > WINDOW) & (first <= last), F.transform(F.sequence(first, last), lambda b: b * STEP))
    return (
        rows.withColumn("start", F.explode(starts))
        .groupBy(KEY, "start")
        .agg(
            correlation(F.col("urea"), F.col("ng")).alias("r"),
            F.min(F.when(F.col("pos") == F.col("start"), F.year(MONTH))).alias("start_year"),
        )
        .withColumn("strength", strength(F.col("r")))
    )


def window_summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(KEY).agg(
        F.avg("r").alias("mean_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.count("r").alias("n_blocks")
    )


def rolling_corr(panel: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    pairs = aligned(panel)
    return window_correlation(pairs, peak_lag(cross_correlation(pairs, max_lag)))


# Granger ---------------------------------------------------------------------

GRANGER_SCHEMA = "series string, lag int, f_stat double, p_value double, df_num int, df_denom int"


def lag_sums(pairs: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Per series: sums of products of the centred series with themselves and each other at every lag.

    One window and one aggregation.  ``yy[d]`` is the sum of y(t) y(t - d), likewise ``xx``,
    ``yx`` (y leads x) and ``xy``; ``head`` and ``tail`` hold the ``max_lag`` first and last
    (position, y, x), by which a sum over fewer months differs.  What comes out is bounded by
    the number of lags, whatever the number of months.
    """
    ordered, whole = by_series(), Window.partitionBy(KEY)
    rows = pairs.select(
        KEY,
        (F.col("urea") - F.avg("urea").over(whole)).alias("y"),
        (F.col("ng_spot") - F.avg("ng_spot").over(whole)).alias("x"),
        (F.row_number().over(ordered) - 1).alias("pos"),
        F.count("*").over(whole).alias("n"),
        *[(F.lag(c, d).over(ordered) - F.avg(c).over(whole)).alias(f"{z}{d}") for d in range(max_lag + 1) for c, z in (("urea", "y"), ("ng_spot", "x"))],
    )
    edge = F.struct("pos", "y", "x")
    return rows.groupBy(KEY).agg(
        F.max("n").alias("n"),
        F.sum("y").alias("y_sum"),
        F.sum("x").alias("x_sum"),
        *[F.array(*[F.coalesce(F.sum(F.col(a) * F.col(f"{b}{d}")), F.lit(0.0)) for d in range(max_lag + 1)]).alias(a + b) for a in "yx" for b in "yx"],
        F.sort_array(F.collect_list(F.when(F.col("pos") < max_lag, edge))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("pos") >= F.col("n") - max_lag, edge))).alias("tail"),
    )


def granger(panel: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """F-test per series and lag: do past gas prices help to predict urea?

    Spark reduces each series to its lag sums; Python sees these alone and solves one small
    system for each lag.
    """
    ship_package(panel.sparkSession)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row[KEY], k, *granger_f(row, k)) for row in batch.to_pylist() for k in range(1, max_lag + 1)]
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32())
            series, lags, f, p, denom = (pa.array(c, k) for c, k in zip(columns, kinds))
            yield pa.RecordBatch.from_arrays([series, lags, f, p, lags, denom], ["series", "lag", "f_stat", "p_value", "df_num", "df_denom"])

    tested = lag_sums(aligned(panel), max_lag).mapInArrow(solve, GRANGER_SCHEMA)
    return tested.withColumn("verdict", verdict(F.col("p_value")))


def verdict(p: Column) -> Column:
    return F.when(p < 0.05, "YES").when(p < 0.10, "marginal").when(p.isNotNull(), "no")


def gram(sums: dict, k: int) -> np.ndarray:
    """Products of (1, y lags 1..k, x lags 1..k, y) over the months from position k on, from the lag sums."""
    n = sums["n"]
    known = {e["pos"]: (e["y"], e["x"]) for e in [*sums["head"], *sums["tail"]]}
    names = [None, *[("y", i) for i in range(1, k + 1)], *[("x", i) for i in range(1, k + 1)], ("y", 0)]

    def value(name: str, pos: int) -> float:
        return known[pos]["yx".index(name)]

    def product(a: tuple | None, b: tuple | None) -> float:
        if a is None and b is None:
            return n - k
        if a is None or b is None:
            name, i = a or b
            edges = [*range(k - i), *range(n - i, n)]
            return sums[f"{name}_sum"] - sum(value(name, s) for s in edges)
        if a[1] > b[1]:
            a, b = b, a
        (one, i), (other, j) = a, b
        d = j - i
        edges = [*range(d, k - i), *range(n - i, n)]
        return sums[one + other][d] - sum(value(one, s) * value(other, s - d) for s in edges)

    return np.array([[product(a, b) for b in names] for a in names])


def residual_squares(products: np.ndarray, columns: list[int]) -> float:
    """Sum of squares that is left of the last column after the others in ``columns`` are taken out."""
    scale = np.sqrt(np.maximum(np.diag(products), 1e-300))
    unit = products / np.outer(scale, scale)
    g, b = unit[np.ix_(columns, columns)], unit[columns, -1]
    return float((1.0 - b @ np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ b) * scale[-1] ** 2)


def granger_f(sums: dict, k: int) -> tuple[float | None, float | None, int]:
    """F statistic and p-value of k lags of x beyond k lags of y."""
    denom = sums["n"] - k - 2 * k - 1
    if denom <= 0:
        return None, None, denom
    products = gram(sums, k)
    spread = products[-1, -1] - products[0, -1] ** 2 / products[0, 0]
    own, both = (residual_squares(products, list(range(m))) for m in (k + 1, 2 * k + 1))
    if both <= 1e-12 * max(products[-1, -1], 0.0) or spread <= 0:
        return None, None, denom
    f = max(own - both, 0.0) / k / (both / denom)
    return f, f_tail(f, k, denom), denom


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F(d1, d2) > f) by the regularised incomplete beta function."""
    if f <= 0:
        return 1.0
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction, evaluated from the convergent side."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Backward recurrence of the fraction 1/(1 + d1/(1 + d2/(1 + ...))).
    value = 1.0
    for m in range(300, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1.0 + odd / (1.0 + even / value)
    return front / value
