"""Structured Streaming over the events table (an extension; the dialect itself is bounded).

The same windowed aggregation serves a batch and a stream: watermark, tumbling or sliding windows,
sessions, and a stateful running total by ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, in the schema it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _stamped(events: DataFrame, late: str | None) -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late and events.isStreaming else out


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Events and their value by window and type; rows later than ``late`` are left out of a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = _stamped(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    grouped = _stamped(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """Number and value of a user's events so far, after each batch (update mode)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n += len(f)
            total += float(f["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)
