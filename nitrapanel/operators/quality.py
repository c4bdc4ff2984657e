"""Checks on tables: freshness, null and uniqueness tests, parity, leakage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, MONTH

TOLERANCE = 1e-6
PREVIEW = 10

# Status words per class.
OK_WORDS = ("pass", "success")
WARN_WORDS = ("warn",)
BAD_WORDS = ("fail", "error", "runtime error")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Freshness -----------------------------------------------------------------


def freshness(df: DataFrame, table: str, period: str, as_of: Column, warn_days: int, error_days: int) -> DataFrame:
    """Age in days of the newest period against the two thresholds."""
    age = F.datediff(as_of, F.col("max_period"))
    return (
        df.agg(F.max(F.col(period).cast("date")).alias("max_period"))
        .select(
            F.lit(table).alias("name"),
            "max_period",
            age.alias("age_days"),
            F.lit(warn_days).alias("warn_after"),
            F.lit(error_days).alias("error_after"),
        )
        .withColumn(
            "status",
            F.when(F.col("age_days").isNull(), "runtime error")
            .when(F.col("age_days") > error_days, "error")
            .when(F.col("age_days") > warn_days, "warn")
            .otherwise("pass"),
        )
    )


def freshness_report(
    tables: dict[str, tuple[DataFrame, str]], thresholds: dict[str, tuple[int, int]], as_of: Column
) -> DataFrame:
    """One row per table that has thresholds; the others are skipped."""
    rows = [
        freshness(df, name, period, as_of, *thresholds[name])
        for name, (df, period) in tables.items()
        if name in thresholds
    ]
    if not rows:
        raise ValueError("no table has freshness thresholds")
    return union_all(rows)


def bundle_age_seconds(written: Column, as_of: Column) -> Column:
    """Whole seconds since the bundle was written."""
    return F.unix_timestamp(as_of) - F.unix_timestamp(written)


# Null and uniqueness checks --------------------------------------------------


def _result(df: DataFrame, check: str) -> DataFrame:
    status = F.when(F.col("failures") > 0, "fail").otherwise("pass")
    return df.select(F.lit(check).alias("name"), F.col("failures").cast("bigint").alias("failures"), status.alias("status"))


def not_null(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """One result row per column, counted in a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f"not_null_{table}_{c}").alias("name"), F.col(c).alias("failures")) for c in cols])
    )
    status = F.when(F.col("failures") > 0, "fail").otherwise("pass")
    return counts.select(pairs.alias("p")).select("p.*").select("name", "failures", status.alias("status"))


def unique(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """Number of keys that occur more than once."""
    doubled = df.dropna(subset=cols).groupBy(*cols).count().where(F.col("count") > 1)
    return _result(doubled.agg(F.count("*").alias("failures")), f"unique_{table}_{'_'.join(cols)}")


# Status rollup ---------------------------------------------------------------


def status_class(status: Column) -> Column:
    word = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(word.isin(*OK_WORDS), "ok")
        .when(word.isin(*WARN_WORDS), "warn")
        .when(word.isin(*BAD_WORDS), "bad")
        .otherwise("unknown")
    )


def status_rollup(results: DataFrame) -> DataFrame:
    """One row with the number of results per class."""
    cls = status_class(F.col("status"))
    return results.agg(*[F.count_if(cls == c).alias(f"n_{c}") for c in ("ok", "warn", "bad", "unknown")])


def status_listing(results: DataFrame) -> DataFrame:
    """Results with their class, failures first and then by name."""
    cls = results.withColumn("status_class", status_class(F.col("status")))
    return cls.orderBy(F.col("status_class") != "bad", "name")


# Parity ----------------------------------------------------------------------


def rows_only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def paired(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Full outer match of two tables with a side marker and both values."""
    a = left.select(*keys, *[F.col(c).cast("double").alias(f"l_{c}") for c in cols], F.lit(True).alias("in_l"))
    b = right.select(*keys, *[F.col(c).cast("double").alias(f"r_{c}") for c in cols], F.lit(True).alias("in_r"))
    side = F.when(F.col("in_r").isNull(), "left").when(F.col("in_l").isNull(), "right").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("side", side).drop("in_l", "in_r")


def differs(c: str, tol: float = TOLERANCE) -> Column:
    """NULL equals NULL; NULL against a value, or a gap above tol, differs."""
    a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
    return F.when(a.isNull() & b.isNull(), F.lit(False)).otherwise(
        F.coalesce(F.abs(a - b) > tol, F.lit(True))
    )


def parity(left: DataFrame, right: DataFrame, cols: list[str], tol: float = TOLERANCE, keys: list[str] | None = None) -> DataFrame:
    """Per-column comparison of two panels, all columns in one aggregation."""
    keys = keys or [KEY, MONTH]
    both = F.col("side") == "both"
    aggs = [
        F.count_if(both).alias("common"),
        F.count_if(F.col("side") == "left").alias("only_left"),
        F.count_if(F.col("side") == "right").alias("only_right"),
    ]
    for c in cols:
        bad = both & differs(c, tol)
        aggs += [
            F.count_if(bad).alias(f"n_{c}"),
            F.max(F.when(bad, F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")))).alias(f"m_{c}"),
            F.min(F.when(bad, F.col(keys[-1]))).alias(f"f_{c}"),
            F.max(F.when(bad, F.col(keys[-1]))).alias(f"t_{c}"),
        ]
    wide = paired(left, right, keys, cols).agg(*aggs)
    per_column = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n_{c}").alias("diff_cells"),
                (F.col("common") - F.col(f"n_{c}")).alias("matching_cells"),
                F.col(f"m_{c}").alias("max_abs_diff"),
                F.col(f"f_{c}").alias("first_month"),
                F.col(f"t_{c}").alias("last_month"),
            )
            for c in cols
        ]
    )
    total = reduce(Column.__add__, [F.col(f"n_{c}") for c in cols])
    verdict = F.when(total + F.col("only_left") + F.col("only_right") == 0, "PARITY OK").otherwise("MISMATCH PRESENT")
    return wide.select(
        F.explode(per_column).alias("p"), "common", "only_left", "only_right", verdict.alias("verdict")
    ).select("p.*", "common", "only_left", "only_right", "verdict")


def parity_preview(left: DataFrame, right: DataFrame, cols: list[str], tol: float = TOLERANCE, n: int = PREVIEW) -> DataFrame:
    """The first n differing rows per column, by key order."""
    keys = [KEY, MONTH]
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"l_{c}").alias("left_value"),
                    F.col(f"r_{c}").alias("right_value"),
                    differs(c, tol).alias("differs"),
                )
                for c in cols
            ]
        )
    )
    long = paired(left, right, keys, cols).where(F.col("side") == "both").select(*keys, cells.alias("x"))
    return first_n(long.where("x.differs").select(*keys, "x.column", "x.left_value", "x.right_value"), "column", keys, n)


def first_n(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """First n rows per group; partitions are cut to n rows before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def parity_classified(
    left: DataFrame,
    right: DataFrame,
    cols: list[str],
    expected: dict[str, str],
    max_expected: dict[str, float] | None = None,
    tol: float = TOLERANCE,
) -> DataFrame:
    """Parity with every differing column tagged EXPECTED or UNEXPLAINED.

    ``expected`` maps a column to the first month from which a difference is no
    longer explained; ``max_expected`` maps a column to the largest shift that extra
    rows on the right side explain.
    """
    rules = F.lit(None).cast("boolean")
    for c, before in expected.items():
        hit = (F.col("column") == c) & (F.col("last_month") < F.lit(before).cast("date"))
        rules = F.coalesce(F.when(hit, F.lit(True)), rules)
    for c, limit in (max_expected or {}).items():
        hit = (F.col("column") == c) & (F.col("only_right") > 0) & (F.col("max_abs_diff") < limit)
        rules = F.coalesce(F.when(hit, F.lit(True)), rules)
    tag = F.when(F.col("diff_cells") == 0, "OK").when(rules, "EXPECTED").otherwise("UNEXPLAINED")
    return parity(left, right, cols, tol).withColumn("tag", tag)


def extra_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, judged: a new row without urea and dap is expected."""
    keys = [KEY, MONTH]
    gas_only = F.col("urea").isNull() & F.col("dap").isNull()
    fresh = rows_only_in(right, left, keys).select(
        *keys, F.lit("right").alias("side"), F.when(gas_only, "EXPECTED").otherwise("UNEXPECTED").alias("verdict")
    )
    gone = rows_only_in(left, right, keys).select(*keys, F.lit("left").alias("side"), F.lit("UNEXPECTED").alias("verdict"))
    return gone.unionByName(fresh)


def column_parity(left: DataFrame, right: DataFrame) -> dict[str, object]:
    """Whether names and order agree, and what either side lacks."""
    a, b = left.columns, right.columns
    return {
        "identical": a == b,
        "missing_right": [c for c in a if c not in b],
        "missing_left": [c for c in b if c not in a],
    }


def column_list(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each column of either side with its place on both and whether it is the same, moved or missing."""
    a, b = left.columns, right.columns
    rows = []
    for name in [*a, *[c for c in b if c not in a]]:
        at = [side.index(name) + 1 if name in side else None for side in (a, b)]
        status = "missing on the left" if at[0] is None else "missing on the right" if at[1] is None else "same" if at[0] == at[1] else "moved"
        rows.append((name, *at, status))
    return left.sparkSession.createDataFrame(rows, "col_name string, left_at int, right_at int, status string")


def parity_gate(
    left: DataFrame,
    right: DataFrame,
    cols: list[str],
    expected: dict[str, str],
    max_expected: dict[str, float] | None = None,
    tol: float = TOLERANCE,
) -> DataFrame:
    """One row: do the columns agree, how many columns are unexplained and rows unexpected, and the verdict.

    Values are not compared where names or order of the columns differ.
    """
    agree = left.columns == right.columns
    rows = extra_rows(left, right).agg(F.count_if(F.col("verdict") == "UNEXPECTED").alias("n_unexpected"))
    if not agree:
        return rows.select(
            F.lit(False).alias("columns_agree"), F.lit(None).cast("long").alias("n_unexplained"), "n_unexpected",
            F.lit("COLUMNS DIFFER").alias("verdict"),
        )
    tagged = parity_classified(left, right, cols, expected, max_expected, tol)
    # Two tables of one row each, laid over each other.
    counts = tagged.agg(F.count_if(F.col("tag") == "UNEXPLAINED").alias("n_unexplained")).withColumn("n_unexpected", F.lit(0).cast("long"))
    both = counts.unionByName(rows.withColumn("n_unexplained", F.lit(0).cast("long"))).agg(
        F.sum("n_unexplained").alias("n_unexplained"), F.sum("n_unexpected").alias("n_unexpected")
    )
    passed = F.col("n_unexplained") + F.col("n_unexpected") == 0
    return both.select(
        F.lit(True).alias("columns_agree"), "n_unexplained", "n_unexpected", F.when(passed, "PASS").otherwise("UNEXPLAINED").alias("verdict")
    )


# Leakage ---------------------------------------------------------------------


def perturb_last(panel: DataFrame, col: str, delta: float) -> DataFrame:
    """The panel with ``delta`` added to the last month of each series."""
    last = panel.groupBy(KEY).agg(F.max(MONTH).alias("last_month"))
    moved = F.when(F.col(MONTH) == F.col("last_month"), F.col(col) + delta).otherwise(F.col(col))
    return panel.join(last, KEY).withColumn(col, moved).drop("last_month").select(*panel.columns)


def leakage_report(
    fn: Callable[[DataFrame], DataFrame], panel: DataFrame, col: str, delta: float, cols: list[str]
) -> DataFrame:
    """Per column of ``fn(panel)``: earlier rows that react to a change of the last one."""
    last = panel.groupBy(KEY).agg(F.max(MONTH).alias("last_month"))

    def earlier(df: DataFrame) -> DataFrame:
        return df.join(last, KEY).where(F.col(MONTH) < F.col("last_month")).drop("last_month")

    return parity(earlier(fn(panel)), earlier(fn(perturb_last(panel, col, delta))), cols, tol=0.0)


def leakage_probe(
    fn: Callable[[DataFrame], DataFrame], panel: DataFrame, col: str, delta: float, cols: list[str]
) -> DataFrame:
    """Only the columns that leak."""
    return leakage_report(fn, panel, col, delta, cols).where(F.col("diff_cells") > 0)
