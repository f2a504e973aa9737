"""Service calendars as column expressions and small parsers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The week in order.
WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def feed_date(text: Column) -> Column:
    """The date of a ``YYYYMMDD`` text; null if it isn't one."""
    return F.when(F.trim(text).rlike(r"^\d{8}$"), F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd")).cast("date"))


def service_date(value: str | dt.date | None) -> dt.date | None:
    """A date, or one written ``YYYY-MM-DD`` or ``YYYYMMDD``; raises ``ValueError`` for anything else."""
    if value is None or isinstance(value, dt.date):
        return value.date() if isinstance(value, dt.datetime) else value
    text = str(value).strip()
    for form in ("%Y-%m-%d", "%Y%m%d"):
        try:
            return dt.datetime.strptime(text, form).date()
        except ValueError:
            continue
    raise ValueError(f"not a date of the form YYYY-MM-DD or YYYYMMDD: {value!r}")


def day_type(weekday: Column, weekend: Column) -> Column:
    """``weekday``, ``weekend``, ``weekday_and_weekend`` or null, from two flags whose nulls count as false."""
    a, b = F.coalesce(weekday, F.lit(False)), F.coalesce(weekend, F.lit(False))
    return F.when(a & b, "weekday_and_weekend").when(a, "weekday").when(b, "weekend")


def ordered_days(days: Column) -> Column:
    """The days of an array in the week's order, joined by ``|``; null if there are none."""
    inside = F.array_intersect(F.array(*map(F.lit, WEEK)), days)
    return F.when(F.size(inside) > 0, F.array_join(inside, "|"))
