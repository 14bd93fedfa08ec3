"""Differences that count boundaries crossed, shifts by whole units, and ages by calendar date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch(t: Column) -> Column:
    """Whole seconds since 1970; session time zone UTC makes this neutral for times without a zone."""
    return F.unix_seconds(t.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries between a and b: fractions are cut off before, not after, the subtraction."""
    return _epoch(b) - _epoch(a)


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from a to b, for comparing distances."""
    return F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))


def minutes_between(a: Column, b: Column) -> Column:
    """Minute boundaries between a and b; 08:00:50 to 08:01:10 is one."""
    return (F.floor(_epoch(b) / 60) - F.floor(_epoch(a) / 60)).cast("long")


def days_between(a: Column, b: Column) -> Column:
    """Calendar days from a to b."""
    return F.datediff(b.cast("date"), a.cast("date")).cast("long")


def plus(t: Column, minutes: Column | int = 0, hours: Column | int = 0, days: Column | int = 0) -> Column:
    """t shifted by whole units."""
    n = [x if isinstance(x, Column) else F.lit(x) for x in (days, hours, minutes)]
    return t + F.make_dt_interval(n[0], n[1], n[2])


def completed_years(birth: Column, at: Column) -> Column:
    """Birthdays reached; one on 29 February is reached on 1 March of other years."""
    number = lambda d: F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)
    return F.floor((number(at) - number(birth)) / 10000).cast("long")


def completed_months(birth: Column, at: Column) -> Column:
    """Months completed by day of the month."""
    whole = (F.year(at) - F.year(birth)) * 12 + F.month(at) - F.month(birth)
    return (whole - F.when(F.dayofmonth(at) < F.dayofmonth(birth), 1).otherwise(0)).cast("long")
