"""Date, time and interval functions as Columns (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_L = "bigint"


def date(d: Column) -> Column:
    return F.to_date(d)


def current_date() -> Column:
    return F.current_date()


def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def current_timestamp() -> Column:
    return F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")


now = current_timestamp


def makedate(year: Column, day: Column) -> Column:
    """The day-th day of a year; null for a day the year does not have."""
    first = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    made = F.date_add(first, (day - 1).cast("int"))
    return F.when((day >= 1) & (F.year(made) == year), made)


def maketime(h: Column, m: Column, s: Column) -> Column:
    return F.format_string("%d:%02d:%02d", h.cast(_L), m.cast(_L), s.cast(_L))


def day(d: Column) -> Column:
    return F.dayofmonth(d).cast(_L)


def dayname(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def monthname(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def hour(t: Column) -> Column:
    return F.hour(t).cast(_L)


def minute(t: Column) -> Column:
    return F.minute(t).cast(_L)


def dayofweek(d: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(d).cast(_L)


def dayofyear(d: Column) -> Column:
    return F.dayofyear(d).cast(_L)


def weekofyear(d: Column) -> Column:
    """Not the ISO week: whole weeks since 1 January, the first one short unless it starts on a Monday."""
    shift = F.when(F.weekday(F.trunc(d, "YEAR")) == 0, 0).otherwise(1)
    return (F.floor((F.dayofyear(d) - 1 + shift) / 7) + 1).cast(_L)


def quarter(d: Column) -> Column:
    return F.quarter(d).cast(_L)


def year(d: Column) -> Column:
    return F.year(d).cast(_L)


def month(d: Column) -> Column:
    return F.month(d).cast(_L)


def weekday(d: Column) -> Column:
    """0 is Monday."""
    return F.weekday(d).cast(_L)


def to_days(d: Column) -> Column:
    before = F.year(d).cast(_L) - 1
    leaps = F.floor(before / 4) - F.floor(before / 100) + F.floor(before / 400)
    return ((before + 1 - leaps) * 365 + leaps * 366 + F.dayofyear(d) - 1).cast(_L)


def last_day(d: Column) -> Column:
    return F.last_day(d)


def yearweek(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), weekofyear(d).cast("string"))
