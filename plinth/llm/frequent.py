"""Most frequent items among billions (problem 4).

Method: exact spillable aggregation.  ``groupBy`` combines on the map side, so a value that holds a
third of the rows crosses the shuffle once per map task; the hash partitions of the aggregation
spill to disk (Tungsten falls back to sort-based aggregation), so memory is bounded whatever the
number of distinct values; ``orderBy(..).limit(k)`` is planned as TakeOrderedAndProject: a local
top-k in every partition and one final ordered limit over ``k`` rows per partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(f"`{column}`").cast("string").alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_items(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values with exact counts: ``value, n``.

    Ties are broken by the value in ascending order.  Nulls are never items, the empty string is
    one; repeated rows count as stored; an empty table gives an empty result.
    """
    return _counts(df, column).orderBy(F.col("n").desc(), F.col("value").asc()).limit(k)


def heavy_items(df: DataFrame, column: str, share: float, least: int = 1) -> DataFrame:
    """Every value with at least ``share`` of the non-null rows and ``least`` rows: ``value, n, total``.

    No more than ``1 / share`` values can qualify, so the ordered limit of that many rows drops none.
    The total is one number, counted from the column's metadata and values in a scan of its own.
    """
    counts = _counts(df, column)
    top = counts.orderBy(F.col("n").desc(), F.col("value").asc()).limit(math.ceil(1 / share) + 1)
    total = df.agg(F.count(F.col(f"`{column}`"))).first()[0]
    return top.where(F.col("n") >= max(least, total * share)).withColumn("total", F.lit(total).cast("bigint"))
