"""Ranks and running sums over ordered rows without a single-task window.

A window over one key sorts all rows of the key in one task.  Here rows are spread over buckets
that follow the order, each bucket is ranked on its own, and the (few) bucket totals are summed
ahead of it, so a key that holds a third of all rows still uses every core.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.lineage import cut


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before this row.

    The order is (``bucket``, ``order``); ``bucket`` must be a column with bounded rows per value.
    Nulls in ``value`` count as 0.  An empty input gives an empty output.
    """
    v = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(v).alias("__total"))
    totals = totals.withColumn("__ahead", F.coalesce(F.sum("__total").over(ahead), F.lit(0))).drop("__total")
    inside = df.withColumn("__inside", F.coalesce(F.sum(v).over(inner), F.lit(0)))
    joined = inside.alias("a").join(totals.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, bucket]])
    return joined.select("a.*", (F.col("b.__ahead") + F.col("a.__inside")).alias(out)).drop("__inside")


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... over all rows in ``order`` (Columns), without a task that holds them all.

    A range sort puts the rows in order over all partitions; each is numbered by its place and the
    partitions' counts (one row a partition) are added up ahead of it.
    """
    ordered = df.orderBy(*order) if order else df
    placed = cut(ordered.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.col("__place") - F.shiftleft(part, 33)
    return placed.withColumn("__part", part).join(ahead, "__part").withColumn(out, (F.col("__ahead") + within + 1).cast("bigint")).drop("__part", "__place", "__ahead")
