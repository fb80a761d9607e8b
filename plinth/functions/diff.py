"""Functions of a commit's changes: array<struct<location, content, insertions, removals, kind>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _content(changes: Column, kind: str | None = None) -> Column:
    some = changes if kind is None else F.filter(changes, lambda c: c["kind"] == kind)
    return F.when(changes.isNotNull(), F.array_join(F.transform(some, lambda c: F.coalesce(c["content"].cast("string"), F.lit(""))), ""))


def content(changes: Column) -> Column:
    return _content(changes)


def added_content(changes: Column) -> Column:
    return _content(changes, "A")


def deleted_content(changes: Column) -> Column:
    return _content(changes, "D")


def modified_content(changes: Column) -> Column:
    return _content(changes, "M")


def content_contains(changes: Column, text: Column) -> Column:
    return F.contains(_content(changes), text)


def added_content_contains(changes: Column, text: Column) -> Column:
    return F.contains(_content(changes, "A"), text)


def deleted_content_contains(changes: Column, text: Column) -> Column:
    return F.contains(_content(changes, "D"), text)


def modified_content_contains(changes: Column, text: Column) -> Column:
    return F.contains(_content(changes, "M"), text)


def changed_files(changes: Column) -> Column:
    """Paths in order, repeats included."""
    return F.transform(changes, lambda c: c["location"])


def files_count(changes: Column) -> Column:
    return F.array_size(F.array_distinct(changed_files(changes))).cast("bigint")


def has_file(changes: Column, path: Column) -> Column:
    return F.exists(changes, lambda c: c["location"] == path)
