"""Equi-joins in which a few keys hold most rows of one side.

A key with a third of the rows of the large side would be one task of a hash join.  The keys above
``1 / shares`` of all rows, of which there can be no more than ``shares``, are found by a counting
aggregation (combined on the map side); they are the only thing broadcast.  Their rows on the large side
get one of ``salts`` numbers by a hash, their rows on the other side are repeated for each number.  No
other row is repeated, and no task gets more than its share of a key, whatever the engine's own skew
handling does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, keys: list[str], shares: int = 10_000, least: int = 100_000) -> DataFrame | None:
    """Keys with more than ``1 / shares`` of all rows and more than ``least``; ``counts`` is ``keys, n``, one row a key.  None if there are none."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    bound = max(least, (total or 0) / shares)
    return counts.where(F.col("n") > bound).select(*keys) if (most or 0) > bound else None


def hot_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, salts: int = 64, shares: int = 10_000, least: int = 100_000) -> DataFrame:
    """``large`` joined with ``small`` on ``keys``, the rows of hot keys of ``large`` spread over ``salts`` tasks.

    ``how`` is inner, left, left_semi or left_anti, as seen from ``large``.  ``counts`` (``keys, n``) saves
    the count where it is known.  Null keys match nothing; columns keep their order, keys first.
    """
    if counts is None:
        counts = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, keys, shares, least)
    if hot is None:
        return large.join(small, keys, how)
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    rest = [c for c in large.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in rest)) if rest else F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    spread = large.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop("__hot")
    repeated = small.join(hot, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return spread.join(repeated, [*keys, "__salt"], how).drop("__salt")
