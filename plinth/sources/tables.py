"""Parquet table access: one place that knows where a named table lives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
