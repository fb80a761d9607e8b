"""Enough input partitions for CPU-heavy Python stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, per_core: int = 2) -> DataFrame:
    """``scan`` with at least ``per_core`` partitions for each core.

    Large inputs already have more splits than cores and are left as they are: no shuffle.  Only an
    input of too few splits (one small file) is spread, round-robin, before the expensive stage.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores * per_core)
