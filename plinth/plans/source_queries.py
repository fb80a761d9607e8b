"""Queries of sources, sinks and functions without a fixed value, with their SQL.

Git repositories and text files are made from the tables in a folder of this machine, which is where
git and a single-file sink work; they are as small as the tables they are made from (25 nations).
"""

from __future__ import annotations

import atexit
import datetime as dt
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import Session
from plinth.sources import git, sinks
from plinth.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _folder() -> str:
    own = tempfile.mkdtemp(prefix="plinth-text-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def _query(name: str, sql: str):
    def put(run):
        run.__name__ = name
        QUERIES[name] = run
        SQL[name] = sql
        return run

    return put


# ---------------------------------------------------------------- git


def _repository(spark: SparkSession, sf: str) -> str:
    """A commit for each nation, in order of its key; a tag for each region."""
    repo = _folder()
    git_ = lambda *a, **env: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, env=os.environ | env)
    git_("init", "-q", "-b", "main")
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():
        os.makedirs(f"{repo}/r{r.n_regionkey}", exist_ok=True)
        with open(f"{repo}/r{r.n_regionkey}/é {r.n_name}.txt", "w", encoding="utf-8") as f:
            f.write(f"{r.n_name}\n" * (r.n_regionkey + 1))
        git_("add", ".")
        at = (dt.datetime(2020, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=int(r.n_nationkey))).isoformat()
        who = {"NAME": r.n_name, "EMAIL": f"{r.n_nationkey}@nation.test", "DATE": at}
        git_("commit", "-qm", f"feat: {r.n_name}\n\nregion {r.n_regionkey}", **{f"GIT_{p}_{k}": v for p in ("AUTHOR", "COMMITTER") for k, v in who.items()})
    for r in table(spark, sf, "region").collect():
        git_("tag", f"t{r.r_regionkey}")
    return repo


def _git(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = Session(spark)
        git.register(s, [_repository(spark, sf)])
        return s.query(text)

    return run


_query("g01_git_commits", "SELECT 'feat: ' || n_name AS title, 'feat: ' || n_name || chr(10) || chr(10) || 'region ' || n_regionkey || chr(10) AS message, n_name AS author_name, n_nationkey || '@nation.test' AS author_email, CAST(n_nationkey > 0 AS BIGINT) AS parents_count, TIMESTAMP '2020-01-01' + to_days(CAST(n_nationkey AS INT)) AS datetime, 'feat' AS kind FROM nation")(_git("SELECT title, message, author_name, author_email, parents_count, datetime, commit_conventional(title) AS kind FROM commits"))
_query("g02_git_changes", "SELECT 'r' || n_regionkey || '/é ' || n_name || '.txt' AS path, 'A' AS mode, CAST(n_regionkey + 1 AS BIGINT) AS insertions, CAST(0 AS BIGINT) AS removals FROM nation WHERE n_nationkey > 0")(_git("SELECT path, mode, insertions, removals FROM diffs_changes"))
_query("g03_git_diffs", "SELECT n_name AS author_name, CASE WHEN n_nationkey > 0 THEN CAST(n_regionkey + 1 AS BIGINT) ELSE 0 END AS insertions, CAST(n_nationkey > 0 AS BIGINT) AS files_changed, CASE WHEN n_nationkey > 0 THEN repeat(n_name || chr(10), CAST(n_regionkey + 1 AS INT)) ELSE '' END AS added FROM nation")(_git("SELECT author_name, insertions, files_changed, diff_added_content(diff_changes) AS added FROM diffs"))
_query("g04_git_refs", "SELECT 't' || r_regionkey AS name, 'refs/tags/t' || r_regionkey AS full_name, 'tag' AS type FROM region UNION ALL SELECT 'main', 'refs/heads/main', 'branch'")(_git("SELECT name, full_name, type FROM refs"))
_query("g05_git_branches", "SELECT 'refs/heads/main' AS name, CAST(count(*) AS BIGINT) AS commit_count, TRUE AS is_head, FALSE AS is_remote, TIMESTAMP '2020-01-01' + to_days(CAST(max(n_nationkey) AS INT)) AS updated FROM nation")(_git("SELECT name, commit_count, is_head, is_remote, updated FROM branches"))
_query("g06_git_tags", "SELECT 't' || r_regionkey AS name FROM region")(_git("SELECT name FROM tags"))


@_query("g07_two_repositories", "SELECT n_name AS author_name, CAST(2 AS BIGINT) AS n FROM nation")
def _two(spark: SparkSession, sf: str) -> DataFrame:
    s = Session(spark)
    git.register(s, [_repository(spark, sf), _repository(spark, sf)])
    return s.query("SELECT author_name, COUNT() AS n FROM commits GROUP BY author_name")


# ---------------------------------------------------------------- sinks

_NATION = "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"


def _into(spark: SparkSession, sf: str, tail: str, tables: str = "nation", select: str = _NATION) -> str:
    path = f"{_folder()}/out.txt"
    Session(spark).register_parquet(sf, *tables.split()).sql(f"{select} {tail.format(path=path)}")
    return "file://" + path


def _printed(spark: SparkSession, sf: str, how: Callable) -> str:
    path = f"{_folder()}/out.txt"
    with open(path, "w", encoding="utf-8") as f:
        f.write(how(Session(spark).register_parquet(sf, "nation").query(_NATION)))
    return "file://" + path


@_query("s01_into_outfile", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def _outfile(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.csv(_into(spark, sf, "INTO OUTFILE '{path}' FIELDS TERMINATED BY ';' ENCLOSED '\"'", "customer", "SELECT c_custkey, c_name FROM customer"), sep=";", header=True)


@_query("s02_into_dumpfile", "SELECT 'n_nationkeyn_name' || string_agg(n_nationkey || n_name, '' ORDER BY n_nationkey) AS value FROM nation")
def _dumpfile(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.text(_into(spark, sf, "INTO DUMPFILE '{path}'"), wholetext=True)


@_query("s03_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.csv(_printed(spark, sf, sinks.csv_text), header=True)


@_query("s04_json", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _json(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema("n_nationkey string, n_name string").json(_printed(spark, sf, sinks.json_text), multiLine=True)


@_query("s05_yaml", """SELECT '- n_nationkey: "' || n_nationkey || '"' AS value FROM nation UNION ALL SELECT '  n_name: "' || n_name || '"' FROM nation""")
def _yaml(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.text(_printed(spark, sf, sinks.yaml_text))


@_query("s06_table", "SELECT '│ ' || rpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || ' ┆ ' || rpad(n_name, (SELECT CAST(greatest(6, max(length(n_name))) AS INTEGER) FROM nation), ' ') || ' │' AS value FROM nation")
def _table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.text(_printed(spark, sf, sinks.table_text)).where(F.col("value").rlike("^│ [0-9]"))


@_query("s07_distributed", "SELECT c_custkey || ',' || c_name AS value FROM customer")
def _wide(spark: SparkSession, sf: str) -> DataFrame:
    path = "file://" + _folder() + "/out"
    sinks.write_distributed(Session(spark).register_parquet(sf, "customer").query("SELECT c_custkey, c_name FROM customer"), None, path)
    return spark.read.text(path)


# ---------------------------------------------------------------- functions without a fixed value: what must hold of them


def _dialect(name: str, tables: str, text: str, sql: str) -> None:
    _query(name, sql)(lambda spark, sf: Session(spark).register_parquet(sf, *tables.split()).query(text))


_dialect(
    "q61_clock_and_chance", "customer",
    "SELECT c_custkey, year(current_date()) >= 2024 AS d, now() >= '2024-01-01 00:00:00'::datetime AS n, current_timestamp() >= '2024-01-01 00:00:00'::datetime AS ts, typeof(current_time()) = 'Time' AS t, rand() >= 0.0 AND rand() < 1.0 AS r, len(uuid()) AS u, uuid() REGEXP '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}' AS ur FROM customer",
    "SELECT c_custkey, TRUE AS d, TRUE AS n, TRUE AS ts, TRUE AS t, TRUE AS r, CAST(36 AS BIGINT) AS u, TRUE AS ur FROM customer",
)
_dialect("q62_assignment_inside", "nation", "SELECT n_nationkey, @step := 3 AS s, n_nationkey * @step AS m FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(3 AS BIGINT) AS s, CAST(n_nationkey * 3 AS BIGINT) AS m FROM nation")


@_query("q63_composite_member", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS label, CAST(n_regionkey + 1 AS BIGINT) AS next FROM nation WHERE n_regionkey >= 2")
def _member(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("label"), F.col("n_regionkey").alias("region")).alias("c"))
    return Session(spark).register_table("pairs", pairs).query("SELECT n_nationkey, (c).label AS label, (c).region + 1 AS next FROM pairs WHERE (c).region >= 2")


@_query("q64_whole_table_windows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, CAST(count(*) OVER () AS BIGINT) AS n, max(o_totalprice) OVER () AS top FROM orders")
def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return Session(spark).register_parquet(sf, "orders").query("SELECT o_orderkey, row_number() OVER(ORDER BY o_totalprice DESC, o_orderkey) AS place, COUNT(o_orderkey) OVER() AS n, MAX(o_totalprice) OVER() AS top FROM orders")


#: Contents as DuckDB shows binary values, without what it escapes.
_SHOWN = "coalesce((SELECT string_agg(regexp_replace(CAST(e.x.content AS VARCHAR), '\\\\x[0-9A-F]{{2}}', '', 'g'), '' ORDER BY e.i) FROM (SELECT unnest(diff_changes) AS x, generate_subscripts(diff_changes, 1) AS i) e WHERE e.x.content IS NOT NULL{}), '')"


@_query("q65_diff_contents", "SELECT commit_id, repo, " + ", ".join(f"md5({_SHOWN.format(k)}) AS {n}" for n, k in (("whole", ""), ("added", " AND e.x.kind = 'A'"), ("deleted", " AND e.x.kind = 'D'"), ("modified", " AND e.x.kind = 'M'"))) + " FROM diffs")
def _contents(spark: SparkSession, sf: str) -> DataFrame:
    df = Session(spark).register_parquet(sf, "diffs").query("SELECT commit_id, repo, diff_content(diff_changes) AS whole, diff_added_content(diff_changes) AS added, diff_deleted_content(diff_changes) AS deleted, diff_modified_content(diff_changes) AS modified FROM diffs")
    # Both sides without quotes, backslashes and everything beyond printable ASCII.
    shown = lambda c: F.md5(F.regexp_replace(F.col(c), "[^ -~]|[\\\\'\"]", "").cast("binary")).alias(c)
    return df.select("commit_id", "repo", *(shown(c) for c in ("whole", "added", "deleted", "modified")))


_dialect("q66_powers", "lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber ^ 20 AS p, (0 - l_linenumber) ^ 21 AS q FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(list_reduce(list_transform(range(20), lambda i: CAST(l_linenumber AS HUGEINT)), lambda a, b: a * b) AS BIGINT) AS p, CAST(-list_reduce(list_transform(range(21), lambda i: CAST(l_linenumber AS HUGEINT)), lambda a, b: a * b) AS BIGINT) AS q FROM lineitem")
_dialect("q67_arrays_by_row", "orders lineitem", "SELECT l_orderkey, l_linenumber, [l_partkey, l_suppkey, l_linenumber] @> l_linenumber AS c, [l_partkey, l_suppkey] || [l_orderkey, l_linenumber] AS ov, l_partkey = ANY [l_suppkey, l_orderkey] AS an, l_quantity >= ALL [10.0, 20.0] AS al, [l_partkey, l_suppkey, l_orderkey][2:3] AS s FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, list_contains([l_partkey, l_suppkey, l_linenumber], l_linenumber) AS c, list_has_any([l_partkey, l_suppkey], [l_orderkey, l_linenumber]) AS ov, l_partkey IN (l_suppkey, l_orderkey) AS an, l_quantity >= 20 AS al, ([l_partkey, l_suppkey, l_orderkey]::BIGINT[])[2:3] AS s FROM lineitem")
_dialect("q68_ranges_by_row", "lineitem", "SELECT l_orderkey, l_linenumber, int4range(l_linenumber, l_suppkey) @> 5 AS c, int4range(0, l_linenumber) && int4range(l_suppkey, 100) AS ov, isempty(int4range(l_linenumber, 3)) AS e, daterange('1995-01-01', '1996-01-01') @> date(l_shipdate) AS d FROM lineitem WHERE l_linenumber <= l_suppkey AND l_linenumber <= 3 AND l_suppkey <= 100", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 5 >= l_linenumber AND 5 < l_suppkey AS c, l_suppkey < l_linenumber AND l_suppkey < 100 AS ov, l_linenumber = 3 AS e, CAST(l_shipdate AS DATE) >= DATE '1995-01-01' AND CAST(l_shipdate AS DATE) < DATE '1996-01-01' AS d FROM lineitem WHERE l_linenumber <= l_suppkey AND l_linenumber <= 3 AND l_suppkey <= 100")
_dialect("q69_places_of_the_whole_table", "orders", "SELECT o_orderkey, first_value(o_orderkey) OVER(ORDER BY o_totalprice DESC, o_orderkey) AS f, last_value(o_orderkey) OVER(ORDER BY o_totalprice DESC, o_orderkey) AS l, nth_value(o_orderkey, 5) OVER(ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 5) OVER w AS n FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
