"""Aggregate functions as Columns, for groups and for windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.text import shown

max_, min_, bit_and, bit_or, bit_xor = F.max, F.min, F.bit_and, F.bit_or, F.bit_xor


def sum_(x: Column) -> Column:
    """0 if there is no value."""
    return F.coalesce(F.sum(x), F.lit(0))


def avg_int(n: Column) -> Column:
    """Truncated average of whole numbers, null if there is none."""
    s = F.sum(n)
    c = F.count(n)
    return F.when(c > 0, (s - s % F.when(c > 0, c)) / c).cast("bigint")


def avg(x: Column) -> Column:
    return F.avg(x)


def count(*_: Column) -> Column:
    """Rows, nulls included."""
    return F.count(F.lit(1))


def group_concat(*parts: Column, order: Column | None = None) -> Column:
    """All values joined without a separator, in ascending order of ``order`` (or of the text itself)."""
    text = F.concat(*map(shown, parts))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((text if order is None else order).alias("o"), text.alias("t")))), lambda x: x["t"]), "")


def bool_and(b: Column) -> Column:
    return F.coalesce(F.bool_and(b), F.lit(True))


def bool_or(b: Column) -> Column:
    return F.coalesce(F.bool_or(b), F.lit(False))


def array_agg(x: Column, order: Column | None = None) -> Column:
    """All values, nulls included, in ascending order of ``order`` (or of the values)."""
    if order is None:
        return F.transform(F.array_sort(F.collect_list(F.struct(x.alias("v")))), lambda s: s["v"])
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("v")))), lambda s: s["v"])
