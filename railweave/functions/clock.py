"""Clock texts of timetables, whose hours may pass 24, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """Seconds after midnight (double) of ``H:MM:SS``; null unless there are exactly three whole numbers.

    Hours from 24 on are kept and minutes and seconds aren't checked against 60, as in the timetable format.
    """
    parts = F.split(F.trim(text), ":")
    number = [F.trim(F.try_element_at(parts, F.lit(i))).try_cast("bigint") for i in (1, 2, 3)]
    return F.when(F.size(parts) == 3, (number[0] * 3600 + number[1] * 60 + number[2]).cast("double"))


def valid_clock(text: Column, last_hour: int = 47) -> Column:
    """Whether ``text`` is a clock that can be: hours 0 to ``last_hour``, minutes and seconds under 60, blanks around allowed."""
    return F.trim(text).rlike(r"^\s*\d{1,2}\s*:\s*[0-5]?\d\s*:\s*[0-5]?\d\s*$") & (F.regexp_extract(text, r"(\d+)", 1).try_cast("int") <= last_hour)


def clock_text(seconds: Column) -> Column:
    """``HH:MM:SS`` of seconds, rounded half to even; hours may pass 24; null and negative give null."""
    s = F.bround(seconds).cast("bigint")
    return F.when(s >= 0, F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60, s % 60))


def hour_band(seconds: Column, size: int = 1) -> Column:
    """The label ``HH-HH`` of the band of ``size`` hours of the day that holds ``seconds``."""
    hour = F.pmod(F.floor(seconds / 3600).cast("int"), F.lit(24))
    start = F.floor(hour / size).cast("int") * size
    return F.when(seconds.isNotNull(), F.format_string("%02d-%02d", start, start + size))


#: The default periods of the day, in hours [from, to).
PERIODS = {"peak_am": (7, 9), "peak_pm": (17, 20)}
REST = "rest_of_day"


def period(seconds: Column, periods: dict[str, tuple[int, int]] | None = None) -> Column:
    """The first period, in the given order, that holds the hour; else ``rest_of_day``; null for null."""
    hour = F.pmod(F.floor(seconds / 3600).cast("int"), F.lit(24))
    case = None
    for name, (a, b) in (PERIODS if periods is None else periods).items():
        inside = (hour >= a) & (hour < b)
        case = F.when(inside, name) if case is None else case.when(inside, name)
    return F.when(seconds.isNotNull(), F.lit(REST) if case is None else case.otherwise(REST))
