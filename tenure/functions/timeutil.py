"""Date / time column expressions with pandas' semantics.

All expressions work on TIMESTAMP_NTZ and never depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_days(start, end) -> Column:
    """Whole elapsed 24 h periods from ``start`` to ``end``, floored.

    pandas' ``Timedelta.days``: −1.5 days → −2.  ``datediff`` counts
    midnights and ``timestampdiff(DAY)`` truncates towards zero, so both are
    wrong for times of day or negative spans.  Integer arithmetic only.
    """
    us = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return ((us - F.pmod(us, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("long")


def minus_days(ts, days: int) -> Column:
    """``ts − days`` as a day-time interval (exact 24 h units)."""
    return _c(ts) - F.make_dt_interval(F.lit(days))


def plus_days(ts, days: int) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(days))


def month_start(ts) -> Column:
    """Year-month key (pandas ``to_period('M')``) as a DATE (first of month)."""
    return F.trunc(_c(ts).cast("date"), "MM")


def month_index(ts) -> Column:
    """Months since year 0: ``year*12 + month − 1``; differences give periods."""
    return (F.year(_c(ts)) * 12 + F.month(_c(ts)) - 1).cast("long")


def month_name(month) -> Column:
    """English name of a calendar month 1..12."""
    return F.date_format(F.make_date(F.lit(2000), _c(month).cast("int"), F.lit(1)), "MMMM")
