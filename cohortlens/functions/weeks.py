"""Week arithmetic.

* cohort / activity weeks are ISO Mondays as ``DATE`` (``trunc(c, 'week')``)
* ``weeks_after`` keeps the reference's literal formula: calendar-year
  difference times 52 plus ISO-week difference, from the raw
  registration date (so a cohort straddling New Year can get two values).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of(c) -> Column:
    """Monday of the ISO week of a date or timestamp, as a DATE."""
    return F.trunc(F.col(c) if isinstance(c, str) else c, "week")


def weeks_after(activity_week: Column, year: Column, week: Column) -> Column:
    """Weeks from a registration (its calendar year and ISO week) to an activity week."""
    return ((F.year(activity_week) - year) * 52 + F.weekofyear(activity_week) - week).cast("bigint")


def spine_weeks_col(start, last_week: dt.date) -> Column:
    """Array of Mondays from ``start`` (a column or date) up to ``last_week``.

    Exploding this per row replaces a cross join with the spine: the
    generator runs inside the scan's codegen stage and never shuffles.
    An empty array when ``start`` is past the spine.
    """
    s = start if isinstance(start, Column) else F.lit(start)
    end = F.lit(last_week)
    return F.when(s <= end, F.sequence(s, end, F.expr("interval 1 week"))).otherwise(
        F.array().cast("array<date>"))


def in_spine(week: Column, start: dt.date, last_week: dt.date) -> Column:
    """True when a Monday lies on the spine (start is validated to be a Monday)."""
    return week.between(F.lit(start), F.lit(last_week))
