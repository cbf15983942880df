"""Calendar helpers: periods, weekday, day and second differences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _date_lit(d: str | dt.date) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else F.lit(d)


def period_start(d: str | Column, anchor: str | dt.date, days: int = 7) -> Column:
    """First day of the ``days``-long period that contains ``d``; periods are
    counted from ``anchor``.  ``pmod`` keeps dates before the anchor in the right
    period (a plain remainder keeps the sign and would shift them forward)."""
    d = _col(d)
    return F.date_sub(d, F.pmod(F.datediff(d, _date_lit(anchor)), F.lit(days)))


def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole days end - start, as an integer (date - date)."""
    return F.datediff(_col(end), _col(start))


def seconds_between(end: str | Column, start: str | Column) -> Column:
    """end - start in whole seconds (timestamp - timestamp)."""
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def time_between(end: str | Column, start: str | Column) -> Column:
    """end - start as Spark's day-time interval (exact to the microsecond)."""
    return _col(end) - _col(start)


def mean_time(interval: str | Column, weight: str | Column | None = None) -> Column:
    """Aggregate: the mean interval, summed exactly and rounded once, half-up, to the microsecond.

    ``weight`` counts a row that often; rows without an interval count nothing."""
    iv = _col(interval)
    if weight is None:
        return F.sum(iv) / F.count(iv)
    return F.sum(iv * _col(weight)) / F.sum(F.when(iv.isNotNull(), _col(weight)))


def interval_microseconds(interval: str | Column) -> Column:
    """A day-time interval as whole microseconds."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, zero + _col(interval))


def minute_field(seconds: str | Column) -> Column:
    """Minute field (0-59) of a duration given in seconds, as the ``minutes``
    part of an interval: whole hours are cut off."""
    return F.pmod(F.floor(_col(seconds) / 60), F.lit(60)).cast("bigint")


def total_minutes(seconds: str | Column) -> Column:
    return F.floor(_col(seconds) / 60).cast("bigint")


def weekday_number(ts: str | Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(_col(ts)) - 1).cast("bigint")


def weekday_name(ts: str | Column, padded: bool = False) -> Column:
    """Full English day name; ``padded=True`` blank-pads it to 9 characters
    ('Friday   '), as a 'Day' picture in to_char does."""
    name = F.date_format(_col(ts), "EEEE")
    return F.rpad(name, 9, " ") if padded else name


def month_start(d: str | Column) -> Column:
    return F.trunc(_col(d), "month")


def period_index(days: str | Column, width: int = 30) -> Column:
    """(days - 1) div width, cut toward zero, so day 0 and day ``width`` both fall
    in period 0 and period k covers days k*width+1 .. (k+1)*width."""
    return F.call_function("div", _col(days) - 1, F.lit(width)).cast("bigint")


def period_label(index: str | Column, width: int = 30) -> Column:
    """'0-30 days', '31-60 days', ... for the period index of ``period_index``."""
    i = _col(index)
    lo = (i * width + 1).cast("string")
    hi = ((i + 1) * width).cast("string")
    return F.when(i == 0, F.lit(f"0-{width} days")).otherwise(F.concat(lo, F.lit("-"), hi, F.lit(" days")))
