"""Tables over git repositories: a Python data source, partitioned by ranges of commits.

``spark.dataSource.register(GitSource)``, then ``spark.read.format("git").option("table", "commits")
.option("repos", "/a;/b").load()``.  Only git's own commands are used; their output is read as a stream of
NUL-terminated fields, by position, so no path or name can be taken for anything else.  The option
``columns`` names the columns a query uses: others are null, changes are compared only if a column
needs them, and contents are read (by one ``cat-file`` process a task) only for ``diff_changes``.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_CHANGES = "array<struct<location string, content binary, insertions int, removals int, kind string>>"
SCHEMAS = {
    "refs": "name string, full_name string, type string, repo string",
    "commits": "commit_id string, title string, message string, author_name string, author_email string, committer_name string, committer_email string, datetime timestamp_ntz, parents_count bigint, repo string",
    "branches": "name string, commit_count bigint, is_head boolean, is_remote boolean, updated timestamp_ntz, repo string",
    "diffs": f"commit_id string, author_name string, author_email string, insertions bigint, removals bigint, files_changed bigint, diff_changes {_CHANGES}, datetime timestamp_ntz, repo string",
    "diffs_changes": "commit_id string, insertions bigint, removals bigint, mode string, path string, repo string",
    "tags": "name string, repo string",
}


class NotARepository(ValueError):
    pass


def _git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, "-c", "safe.directory=*", *args], capture_output=True, check=False)
    if done.returncode:
        raise NotARepository(f"git {args[0]} failed in {repo}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def _fields(repo: str, *args: str) -> Iterator[str]:
    """NUL-terminated fields of a command's output, as they come."""
    with subprocess.Popen(["git", "-C", repo, "-c", "safe.directory=*", *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        rest = b""
        while chunk := run.stdout.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\0")
            for f in whole:
                yield f.decode("utf-8", "replace")
    if run.returncode:
        raise NotARepository(f"git {args[0]} failed in {repo}")


class _Blobs:
    """Contents by id from one ``cat-file --batch`` process."""

    def __init__(self, repo: str) -> None:
        self.repo, self.run = repo, None

    def __enter__(self) -> _Blobs:
        return self

    def __exit__(self, *_) -> None:
        if self.run:
            self.run.stdin.close()
            self.run.stdout.close()
            self.run.wait()

    def read(self, blob: str) -> bytes | None:
        if not self.run:
            self.run = subprocess.Popen(["git", "-C", self.repo, "-c", "safe.directory=*", "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.run.stdin.write(blob.encode() + b"\n")
        self.run.stdin.flush()
        head = self.run.stdout.readline().split()
        if len(head) < 3 or head[1] != b"blob":  # a submodule's commit is no blob of this repository
            if len(head) == 3:
                self.run.stdout.read(int(head[2]) + 1)
            return None
        content = self.run.stdout.read(int(head[2]))
        self.run.stdout.read(1)
        return content


def _lines(repo: str, *args: str) -> list[str]:
    return _git(repo, *args).decode("utf-8", "replace").splitlines()


def _time(seconds: str) -> dt.datetime:
    return dt.datetime.fromtimestamp(int(seconds), dt.UTC).replace(tzinfo=None)


def _has_head(repo: str) -> bool:
    return subprocess.run(["git", "-C", repo, "-c", "safe.directory=*", "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, check=False).returncode == 0


def _kind(full: str) -> str:
    return "branch" if full.startswith("refs/heads/") else "remote" if full.startswith("refs/remotes/") else "tag" if full.startswith("refs/tags/") else "note" if full.startswith("refs/notes/") else "other"


#: Commits of a partition.
RANGE = 2000


@dataclass
class Part(InputPartition):
    """``skip`` and ``most`` cut the history of HEAD; most 0 is a table that is not cut."""

    path: str
    skip: int = 0
    most: int = 0


def _range(part: Part) -> list[str]:
    return [f"--skip={part.skip}", f"--max-count={part.most}"]


def refs(part: Part, columns: set[str]) -> Iterator[tuple]:
    for line in _lines(part.path, "for-each-ref", "--format=%(refname)%00%(refname:short)"):
        full, short = line.split("\0")
        yield short, full, _kind(full), part.path


def tags(part: Part, columns: set[str]) -> Iterator[tuple]:
    for name in _lines(part.path, "for-each-ref", "--format=%(refname:short)", "refs/tags"):
        yield name, part.path


def commits(part: Part, columns: set[str]) -> Iterator[tuple]:
    fields = _fields(part.path, "log", "-z", "--format=%H%x00%s%x00%B%x00%an%x00%ae%x00%cn%x00%ce%x00%ct%x00%P", *_range(part), "HEAD")
    for f in zip(*[fields] * 9, strict=True):
        yield *f[:7], _time(f[7]), len(f[8].split()), part.path


def branches(part: Part, columns: set[str]) -> Iterator[tuple]:
    repo = part.path
    head = _lines(repo, "symbolic-ref", "-q", "HEAD")[:1] if _has_head(repo) else []
    for line in _lines(repo, "for-each-ref", "--format=%(refname)%00%(committerdate:unix)", "refs/heads", "refs/remotes"):
        full, when = line.split("\0")
        count = int(_lines(repo, "rev-list", "--count", full)[0]) if "commit_count" in columns else None
        yield full, count, [full] == head, full.startswith("refs/remotes/"), _time(when) if when else None, repo


_COUNTS = re.compile(r"(\d+|-)\t(\d+|-)\t(.*)", re.DOTALL)


def _compared(part: Part, compare: bool) -> Iterator[tuple[str, str, str, dt.datetime, bool, list]]:
    """Each commit against its first parent: (id, name, address, date, has parent, changes).

    A change is [path, blob, insertions, removals, kind]; without ``compare`` there are none.
    """
    how = ["--diff-merges=first-parent", "--raw", "--numstat", "--no-abbrev", "-M", "-C"] if compare else ["-s"]
    fields = _fields(part.path, "log", "-z", "--format=%H%x00%an%x00%ae%x00%ct%x00%P%x00", *how, *_range(part), "HEAD")
    f = next(fields, None)
    while f:
        commit, name, address, when, parents = f, *(next(fields) for _ in range(4))
        changes: list[list] = []
        counted = 0
        f = next(fields, None)
        if f == "":  # ends the header
            f = next(fields, None)
        while f is not None:
            f = f.removeprefix("\n")
            if f.startswith(":"):
                _, _, _, blob, kind = f.split(" ")
                path = next(fields)
                if kind[0] in "RC":  # the new path follows the old one
                    path = next(fields)
                changes.append([path, blob, 0, 0, kind[0]])
            elif m := _COUNTS.fullmatch(f):
                if not m[3]:
                    next(fields), next(fields)
                # Counts come in the order of the changes.
                changes[counted][2:4] = [int(x) if x.isdigit() else 0 for x in (m[1], m[2])]
                counted += 1
            else:
                break
            f = next(fields, None)
        yield commit, name, address, _time(when), bool(parents.strip()), changes


def diffs(part: Part, columns: set[str]) -> Iterator[tuple]:
    compare = bool(columns & {"insertions", "removals", "files_changed", "diff_changes"})
    with _Blobs(part.path) as blobs:
        for commit, name, address, when, has_parent, changes in _compared(part, compare):
            changes = changes if has_parent else []
            rows = None
            if "diff_changes" in columns:
                rows = [(path, None if set(blob) == {"0"} else blobs.read(blob), a, r, kind) for path, blob, a, r, kind in changes]
            counts = (sum(c[2] for c in changes), sum(c[3] for c in changes), len(changes)) if compare else (None, None, None)
            yield commit, name, address, *counts, rows, when, part.path


def diffs_changes(part: Part, columns: set[str]) -> Iterator[tuple]:
    """One row per changed path; a first commit has none."""
    for commit, _, _, _, has_parent, changes in _compared(part, True):
        for path, _, a, r, kind in changes if has_parent else []:
            yield commit, a, r, kind, path, part.path


READERS = {"refs": refs, "commits": commits, "branches": branches, "diffs": diffs, "diffs_changes": diffs_changes, "tags": tags}
_OF_COMMITS = {"commits", "diffs", "diffs_changes"}


class _Reader(DataSourceReader):
    def __init__(self, table: str, repos: list[str], columns: set[str]) -> None:
        self.table, self.repos, self.columns = table, repos, columns

    def partitions(self):
        out = []
        for r in self.repos:
            if self.table not in _OF_COMMITS:
                out.append(Part(r))
            elif _has_head(r):
                n = int(_lines(r, "rev-list", "--count", "HEAD")[0])
                out += [Part(r, k, RANGE) for k in range(0, n, RANGE)]
        return out or [Part("")]

    def read(self, partition):
        if partition.path:
            yield from READERS[self.table](partition, self.columns)


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        columns = self.options.get("columns")
        wanted = set(schema.names) if columns is None else set(columns.split(";"))
        return _Reader(self.options["table"], [r for r in self.options["repos"].split(";") if r], wanted)


def register(session, repos: list[str]) -> None:
    """All tables of some repositories in a session; a table is read when a query uses it."""
    spark: SparkSession = session.spark
    for r in repos:
        _git(r, "rev-parse", "--git-dir")
    spark.dataSource.register(GitSource)

    def reader(t: str, columns: set[str] | None = None):
        read = spark.read.format("git").option("table", t).option("repos", ";".join(repos))
        return (read if columns is None else read.option("columns", ";".join(sorted(columns)))).load()

    for t in SCHEMAS:
        session.register_table(t, functools.partial(reader, t))
