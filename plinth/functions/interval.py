"""Intervals: a struct of six fields that are never carried into one another."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("years", "months", "days", "hours", "minutes", "seconds")
TYPE = T.StructType([T.StructField(f, T.DoubleType() if f == "seconds" else T.LongType()) for f in FIELDS])
#: Bound of each field.
LIMIT = 170_000_000
#: Unit names and what they stand for.
UNITS = {
    "millennium": ("years", 1000), "millenniums": ("years", 1000), "century": ("years", 100), "centuries": ("years", 100), "decade": ("years", 10), "decades": ("years", 10), "y": ("years", 1), "year": ("years", 1), "years": ("years", 1),
    "m": ("months", 1), "mon": ("months", 1), "mons": ("months", 1), "month": ("months", 1), "months": ("months", 1), "w": ("weeks", 7), "week": ("weeks", 7), "weeks": ("weeks", 7), "d": ("days", 1), "day": ("days", 1), "days": ("days", 1),
    "h": ("hours", 1), "hour": ("hours", 1), "hours": ("hours", 1), "minute": ("minutes", 1), "minutes": ("minutes", 1), "s": ("seconds", 1), "second": ("seconds", 1), "seconds": ("seconds", 1),
}


class IntervalError(ValueError):
    pass


def parse(text: str) -> dict[str, int | float]:
    """Fields of a literal such as ``1 year 2 mons 3 days 04:05:06.789 ago``; each unit once."""
    words = text.split()
    if not words:
        raise IntervalError("an interval needs at least one field")
    out: dict[str, int | float] = dict.fromkeys(FIELDS, 0) | {"seconds": 0.0}
    seen: set[str] = set()
    ago = False

    def once(unit: str) -> None:
        if unit in seen:
            raise IntervalError(f"{unit} may be given once")
        seen.add(unit)

    k = 0
    while k < len(words):
        w = words[k]
        k += 1
        if w == "ago":
            once("ago")
            ago = True
            continue
        clock = re.fullmatch(r"([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", w)
        if clock:
            for unit in ("hours", "minutes", "seconds"):
                once(unit)
            sign = -1 if clock[1] == "-" else 1
            out["hours"] += sign * int(clock[2])
            out["minutes"] += sign * int(clock[3])
            out["seconds"] += sign * float(clock[4] or 0)
            continue
        if not re.fullmatch(r"[+-]?\d+(?:\.\d+)?", w):
            raise IntervalError(f"unexpected {w!r} in an interval")
        if k >= len(words):
            raise IntervalError(f"{w} stands without a unit")
        name = words[k]
        k += 1
        if name not in UNITS:
            raise IntervalError(f"unknown interval unit {name!r}")
        field, factor = UNITS[name]
        once(name.rstrip("s") if factor in (1000, 100, 10) else field)
        if "." in w and field != "seconds":
            raise IntervalError("only seconds may have a fraction")
        number = float(w) if field == "seconds" else int(w)
        out["days" if field == "weeks" else field] += number * factor
    for f in FIELDS:
        if abs(out[f]) > LIMIT:
            raise IntervalError(f"interval field {f} is out of range")
        if ago:
            out[f] = -out[f]
    return out


def literal(text: str) -> Column:
    return make(**parse(text))


def make(**fields) -> Column:
    return F.struct(*(F.lit(float(fields.get(f, 0)) if f == "seconds" else int(fields.get(f, 0))).cast("double" if f == "seconds" else "bigint").alias(f) for f in FIELDS))


def _fieldwise(op, a: Column, b: Column | None = None) -> Column:
    built = F.struct(*(op(a[f], b[f] if b is not None else None, f).cast("double" if f == "seconds" else "bigint").alias(f) for f in FIELDS))
    ok = a.isNotNull() if b is None else a.isNotNull() & b.isNotNull()
    return F.when(ok, built)


def add(a: Column, b: Column) -> Column:
    return _fieldwise(lambda x, y, _: x + y, a, b)


def sub(a: Column, b: Column) -> Column:
    return _fieldwise(lambda x, y, _: x - y, a, b)


def mul(a: Column, n: Column) -> Column:
    return F.when(n.isNotNull(), _fieldwise(lambda x, _, __: x * n, a))


def div(a: Column, n: Column) -> Column:
    """Field by field, truncated; only seconds keep a fraction."""
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when(n.isNotNull(), _fieldwise(lambda x, _, f: x / n if f == "seconds" else whole(x / n), a))


def to_seconds(a: Column) -> Column:
    """For ordering: years of 365.25 days, months of 30 days."""
    days = a["years"] * 365.25 + a["months"] * 30 + a["days"]
    return days * 86400.0 + a["hours"] * 3600 + a["minutes"] * 60 + a["seconds"]


def justify_days(a: Column) -> Column:
    d = a["days"]
    up = F.when(d >= 30, F.floor(d / 30)).otherwise(0)
    return F.when(a.isNotNull(), F.struct(a["years"].alias("years"), (a["months"] + up).cast("bigint").alias("months"), (d - up * 30).cast("bigint").alias("days"), a["hours"].alias("hours"), a["minutes"].alias("minutes"), a["seconds"].alias("seconds")))


def justify_hours(a: Column) -> Column:
    h = a["hours"]
    up = F.when(h >= 24, F.floor(h / 24)).otherwise(0)
    return F.when(a.isNotNull(), F.struct(a["years"].alias("years"), a["months"].alias("months"), (a["days"] + up).cast("bigint").alias("days"), (h - up * 24).cast("bigint").alias("hours"), a["minutes"].alias("minutes"), a["seconds"].alias("seconds")))


def show(a: Column) -> Column:
    """Text form: parts that are not zero, then the clock."""
    part = lambda f, w: F.when(a[f] != 0, F.concat(a[f].cast("string"), F.lit(f" {w}"), F.when(a[f] > 1, "s").otherwise("")))
    minus = (a["hours"] < 0) | (a["minutes"] < 0) | (a["seconds"] < 0)
    sec = F.abs(a["seconds"])
    sec_text = F.when(sec == F.floor(sec), F.lpad(F.floor(sec).cast("string"), 2, "0")).otherwise(sec.cast("string"))
    two = lambda f: F.when(F.abs(a[f]) < 10, F.lpad(F.abs(a[f]).cast("string"), 2, "0")).otherwise(F.abs(a[f]).cast("string"))
    clock = F.when((a["hours"] != 0) | (a["minutes"] != 0) | (a["seconds"] != 0), F.concat(F.when(minus, "-").otherwise(""), two("hours"), F.lit(":"), two("minutes"), F.lit(":"), sec_text))
    text = F.concat_ws(" ", part("years", "year"), part("months", "month"), part("days", "day"), clock)
    return F.when(a.isNull(), None).when(text == "", "0 seconds").otherwise(text)
