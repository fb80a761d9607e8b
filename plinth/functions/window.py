"""Window functions over whole partitions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def whole(spec: WindowSpec) -> WindowSpec:
    """The frame is the whole partition, also with an order."""
    return spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def first_value(x: Column, spec: WindowSpec) -> Column:
    return F.first(x).over(whole(spec))


def last_value(x: Column, spec: WindowSpec) -> Column:
    return F.last(x).over(whole(spec))


def nth_value(x: Column, n: int, spec: WindowSpec) -> Column:
    """1-based; null out of range."""
    return F.nth_value(x, n).over(whole(spec)) if n > 0 else F.lit(None)


def row_number(spec: WindowSpec) -> Column:
    return F.row_number().over(spec).cast("bigint")
