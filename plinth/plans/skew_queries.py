"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.skew import key_stats
from plinth.sources.tables import table


def p5_author_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, parents and first/last commit of each author name, every row of ``commits``."""
    s = key_stats(table(spark, sf, "commits"), "author_name", "parents_count", "datetime", "commit_id")
    return s.select(F.col("key").alias("author_name"), "n", F.col("total").alias("parents"), "first_id", "first_at", "last_id", "last_at")


def p5_path_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, insertions and first/last commit of each path, every row of ``diffs_changes``.

    The date comes from ``commits``, reduced to one row per commit before the join, so neither side
    of the join repeats a key more often than a commit has changes.
    """
    dated = table(spark, sf, "commits").where(F.col("commit_id").isNotNull()).groupBy("commit_id").agg(F.min("datetime").alias("at"))
    rows = table(spark, sf, "diffs_changes").select("commit_id", "path", "insertions").join(dated, "commit_id", "left")
    s = key_stats(rows, "path", "insertions", "at", "commit_id")
    return s.select(F.col("key").alias("path"), "n", F.col("n_values").alias("n_counted"), F.col("total").alias("insertions"), "largest", "first_id", "first_at", "last_id", "last_at")


QUERIES = {"p5_author_stats": p5_author_stats, "p5_path_stats": p5_path_stats}

SQL = {
    "p5_author_stats": """
        WITH t AS (SELECT *, CASE WHEN datetime IS NULL THEN NULL ELSE commit_id END AS i FROM commits),
        f AS (SELECT author_name, i, datetime, row_number() OVER (PARTITION BY author_name ORDER BY datetime, i) AS a,
                row_number() OVER (PARTITION BY author_name ORDER BY datetime DESC, i DESC) AS z FROM t WHERE i IS NOT NULL)
        SELECT g.author_name, g.n, g.parents, a.i AS first_id, a.datetime AS first_at, z.i AS last_id, z.datetime AS last_at
        FROM (SELECT author_name, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(parents_count), 0) AS BIGINT) AS parents FROM commits GROUP BY author_name) g
        LEFT JOIN f a ON a.author_name IS NOT DISTINCT FROM g.author_name AND a.a = 1
        LEFT JOIN f z ON z.author_name IS NOT DISTINCT FROM g.author_name AND z.z = 1""",
    "p5_path_stats": """
        WITH d AS (SELECT commit_id, min(datetime) AS ts FROM commits WHERE commit_id IS NOT NULL GROUP BY commit_id),
        t AS (SELECT c.*, d.ts FROM diffs_changes c LEFT JOIN d ON d.commit_id = c.commit_id),
        f AS (SELECT path, commit_id, ts, row_number() OVER (PARTITION BY path ORDER BY ts, commit_id) AS a,
                row_number() OVER (PARTITION BY path ORDER BY ts DESC, commit_id DESC) AS z FROM t WHERE ts IS NOT NULL AND commit_id IS NOT NULL)
        SELECT g.path, g.n, g.n_counted, g.insertions, g.largest, a.commit_id AS first_id, a.ts AS first_at, z.commit_id AS last_id, z.ts AS last_at
        FROM (SELECT path, CAST(count(*) AS BIGINT) AS n, CAST(count(insertions) AS BIGINT) AS n_counted, CAST(coalesce(sum(insertions), 0) AS BIGINT) AS insertions,
                max(insertions) AS largest FROM t GROUP BY path) g
        LEFT JOIN f a ON a.path IS NOT DISTINCT FROM g.path AND a.a = 1
        LEFT JOIN f z ON z.path IS NOT DISTINCT FROM g.path AND z.z = 1""",
}
