"""Window expressions. Every window here is keyed; frames are ROWS only."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from nitrapanel.constants import KEY, MONTH
from nitrapanel.functions.clean import ratio


def by_series(order: str = MONTH, key: str | list[str] = KEY) -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(c: Column, agg: Column, w: WindowSpec, n: int, at_least: int | None = None) -> Column:
    """``agg`` over the last n rows, NULL unless enough of them hold a value."""
    frame = last_rows(w, n)
    need = n if at_least is None else at_least
    return F.when(F.count(c).over(frame) >= need, agg.over(frame))


def rolling_mean(c: Column, w: WindowSpec, n: int, at_least: int | None = None) -> Column:
    return full(c, F.avg(c), w, n, at_least)


def rolling_std(c: Column, w: WindowSpec, n: int) -> Column:
    return full(c, F.stddev_samp(c), w, n)


def rolling_max(c: Column, w: WindowSpec, n: int) -> Column:
    return full(c, F.max(c), w, n)


def rolling_min(c: Column, w: WindowSpec, n: int) -> Column:
    return full(c, F.min(c), w, n)


def change(c: Column, w: WindowSpec, k: int) -> Column:
    """Relative change over k rows, without padding interior gaps."""
    return ratio(c, F.lag(c, k).over(w)) - 1


def rolling_zscore(c: Column, w: WindowSpec, n: int) -> Column:
    return ratio(c - rolling_mean(c, w, n), rolling_std(c, w, n))


def expanding_zscore(c: Column, w: WindowSpec) -> Column:
    seen = so_far(w)
    return ratio(c - F.avg(c).over(seen), F.stddev_samp(c).over(seen))


def fill_forward(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(so_far(w))


def fill_forward_limit(c: Column, w: WindowSpec, limit: int) -> Column:
    """Carry a value over at most ``limit`` consecutive missing rows."""
    return F.coalesce(c, F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)))
