"""Contiguous month spine per series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, MONTH

END_RULES = ("any", "shortest", "rows")


def _last_month(measures: list[str], rule: str) -> Column:
    if rule == "rows":
        return F.max(MONTH)
    if rule == "any":
        seen = reduce(Column.__or__, [F.col(m).isNotNull() for m in measures])
        return F.max(F.when(seen, F.col(MONTH)))
    ends = [F.max(F.when(F.col(m).isNotNull(), F.col(MONTH))) for m in measures]
    if len(ends) == 1:
        return ends[0]
    # A measure without any value leaves no common end at all.
    missing = reduce(Column.__or__, [e.isNull() for e in ends])
    return F.when(~missing, F.least(*ends))


def reindex_months(
    panel: DataFrame,
    start: str | None = None,
    end: str | None = None,
    end_rule: str = "any",
    shared: bool = False,
    measures: list[str] | None = None,
) -> DataFrame:
    """Every month from start to end for every series; gaps become NULL rows.

    ``end_rule`` picks the end where none is given: ``any`` is the last month with
    some value, ``shortest`` the last month every measure still reaches, ``rows`` the
    last month present at all. With ``shared`` one range serves all series,
    otherwise each series has its own.
    """
    if end_rule not in END_RULES:
        raise ValueError(f"unknown end_rule {end_rule!r}; use one of {END_RULES}")
    measures = measures or [c for c in panel.columns if c not in (KEY, MONTH)]
    first = F.lit(start).cast("date") if start else F.min(MONTH)
    last = F.lit(end).cast("date") if end else _last_month(measures, end_rule)
    if shared:
        span = panel.agg(F.struct(first.alias("first"), last.alias("last")).alias("span")).scalar()
        keys = panel.select(KEY).distinct().withColumn("span", span)
    else:
        keys = panel.groupBy(KEY).agg(F.struct(first.alias("first"), last.alias("last")).alias("span"))
    span = F.col("span")
    has_range = span["first"].isNotNull() & (span["first"] <= span["last"])
    spine = keys.where(has_range).select(
        KEY, F.explode(F.sequence(span["first"], span["last"], F.expr("interval 1 month"))).alias(MONTH)
    )
    return spine.join(panel, [KEY, MONTH], "left").select(KEY, MONTH, *measures)


