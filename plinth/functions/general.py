"""General functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

isnull, greatest, least = F.isnull, F.greatest, F.least


def uuid() -> Column:
    return F.expr("uuid()")


def if_(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)
