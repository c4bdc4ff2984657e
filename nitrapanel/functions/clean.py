"""Lenient casts and month arithmetic. NULL is the only missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    """Text or number to double; unreadable text and NaN become NULL."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def to_date(c: Column) -> Column:
    """Text or timestamp to date; unreadable text becomes NULL."""
    return c.try_cast("date")


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_text(c: Column) -> Column:
    """``yyyy-MM`` text to the first day of that month."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(t, "yyyy-MM"))


def period_code(c: Column) -> Column:
    """Sheet period such as ``1960M01`` to its month; anything else is NULL."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}M(0?[1-9]|1[0-2])$"), F.to_date(F.replace(t, F.lit("M"), F.lit("-")), "yyyy-M"))


def ratio(num: Column, den: Column) -> Column:
    """Division whose zero denominator gives NULL."""
    return F.try_divide(num, den)


def months_after(c: Column, n: int | Column) -> Column:
    return F.add_months(c, n).cast("date")


def month_label(c: Column) -> Column:
    return F.date_format(c, "MMM yyyy")


def month_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def label_month(c: Column) -> Column:
    """``Jan 2020`` back to its month."""
    return F.to_date(c, "MMM yyyy")


def iso_utc(ts: Column) -> Column:
    """Timestamp as ISO text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` held between the bounds; a missing value stays missing."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))
