"""Windowed queries on the events table (extensions beyond the dialect) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.sources.tables import table
from plinth.streaming import events as ev


def x01_tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ev.windowed_counts(table(spark, sf, "events"), "1 hour")


def x02_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ev.windowed_counts(table(spark, sf, "events"), "1 hour", "30 minutes").drop("total")


def x03_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.sessions(table(spark, sf, "events"), "30 minutes")


def x04_ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderstatus")).cast("bigint").alias("r"), F.lag("o_totalprice").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


QUERIES = {f.__name__: f for f in (x01_tumbling_windows, x02_sliding_windows, x03_sessions, x04_ranks)}
SQL = {
    "x01_tumbling_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3",
    "x02_sliding_windows": "WITH b AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS s, event_type FROM events), w AS (SELECT s AS start, event_type FROM b UNION ALL SELECT s - INTERVAL '30 minutes', event_type FROM b) SELECT start, start + INTERVAL '1 hour' AS \"end\", event_type, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2, 3",
    "x03_sessions": "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, k",
    "x04_ranks": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS r, lag(o_totalprice) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
}
