"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import frequent, handwritten, leakage, mixing, people, pii, repetition, secrets, tokenizers
from plinth.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return people.pairs_of(people.persons(table(spark, sf, "author_identities")))


def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    """The person or organisation of every identity that has one."""
    return people.persons(table(spark, sf, "author_identities")).select(F.col("id").alias("identity_id"), F.col("component").alias("person_id"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal(table(spark, sf, "commits"), ["message", "author_email"])
    return found.select("commit_id", "field", F.explode("kinds").alias("kind")).distinct()


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every message and address with personal items replaced by placeholders."""
    return pii.personal(table(spark, sf, "commits"), ["message", "author_email"]).select("commit_id", "field", "redacted")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.credentials(table(spark, sf, "diffs").select("commit_id", "repo", "diff_changes"))
    return found.select("commit_id", "location", "line_no").distinct()


def p3_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Every content that holds a credential, with only the values masked."""
    diffs = table(spark, sf, "diffs").select("commit_id", "repo", "diff_changes")
    return secrets.masked(diffs, secrets.credentials(diffs))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    def one(name: str, column: str) -> DataFrame:
        heavy = frequent.heavy_items(table(spark, sf, name), column, 0.008, 10)
        return heavy.select(F.lit(f"{name}.{column}").alias("field"), "value")

    return one("diffs_changes", "path").unionByName(one("commits", "author_email"))


def p4_top_paths(spark: SparkSession, sf: str) -> DataFrame:
    return frequent.top_items(table(spark, sf, "diffs_changes"), "path", 100)


def p4_top_emails(spark: SparkSession, sf: str) -> DataFrame:
    return frequent.top_items(table(spark, sf, "commits"), "author_email", 100)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "diffs_changes").select("commit_id", "path", "repo", "mode", "insertions", "removals")
    labelled = handwritten.labels(changes, table(spark, sf, "diffs").select("repo", "diff_changes"))
    return handwritten.touched(changes.select("commit_id", "path", "repo"), labelled).select("commit_id", "path").distinct()


def p6_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label of every file."""
    return handwritten.labels(table(spark, sf, "diffs_changes"), table(spark, sf, "diffs").select("repo", "diff_changes"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks and, with ``words`` false, documents that hold an item with other parameters."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), templates=True)


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), tokenizers.vocabulary(), tokenizers.pattern())


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every document used, with its number of copies."""
    return _mixed(spark, sf)[1]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares really reached, one row per source of ``mix_targets``; a source without documents has zeros."""
    counted, mixed = _mixed(spark, sf)
    have = counted.groupBy("source").agg(F.sum("tokens").alias("available"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("documents"))
    total = used.agg(F.sum("used")).first()[0]
    want = table(spark, sf, "mix_targets").select(mixing.clean_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = want.join(have, "source", "left").join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select("source", "target_share", "max_repeats", zero("available"), zero("used"), zero("most_copies"), zero("documents"), F.round(F.coalesce(F.col("used"), F.lit(0)) / F.lit(float(total or 1)), 6).alias("actual_share"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition(table(spark, sf, "documents")).where("repetitive").select("doc_id").distinct()


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of repeated content of every document."""
    return repetition.repetition(table(spark, sf, "documents")).select("doc_id", F.round("share", 6).alias("share"), "stratum", "repetitive")


QUERIES = {f.__name__: f for f in (p1_found, p1_members, p2_found, p2_redacted, p3_found, p3_masked, p4_found, p4_top_paths, p4_top_emails, p6_found, p6_labels, p7_found, p7_templates, p8_shares, p8_mix, p9_found, p9_shares)}

SQL = {
    "p4_found": """
        SELECT 'diffs_changes.path' AS field, path AS value FROM diffs_changes WHERE path IS NOT NULL GROUP BY path
        HAVING count(*) >= 10 AND count(*) >= 0.008 * (SELECT count(path) FROM diffs_changes)
        UNION ALL
        SELECT 'commits.author_email', author_email FROM commits WHERE author_email IS NOT NULL GROUP BY author_email
        HAVING count(*) >= 10 AND count(*) >= 0.008 * (SELECT count(author_email) FROM commits)""",
    "p4_top_paths": "SELECT path AS value, CAST(count(*) AS BIGINT) AS n FROM diffs_changes WHERE path IS NOT NULL GROUP BY path ORDER BY n DESC, value LIMIT 100",
    "p4_top_emails": "SELECT author_email AS value, CAST(count(*) AS BIGINT) AS n FROM commits WHERE author_email IS NOT NULL GROUP BY author_email ORDER BY n DESC, value LIMIT 100",
}
