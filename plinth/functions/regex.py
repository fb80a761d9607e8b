"""Regular expression functions as Columns (Java syntax)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regexp_instr(s: Column, pattern: Column) -> Column:
    """1-based place of the first match, -1 if there is none."""
    at = F.regexp_instr(s, pattern)
    return F.when(at == 0, -1).otherwise(at).cast("bigint")


def regexp_like(s: Column, pattern: Column) -> Column:
    return F.regexp_like(s, pattern)


def regexp_replace(s: Column, pattern: Column, new: Column) -> Column:
    return F.regexp_replace(s, pattern, new)


def regexp_substr(s: Column, pattern: Column) -> Column:
    """First match, or the empty text."""
    return F.when(s.isNotNull() & pattern.isNotNull(), F.coalesce(F.regexp_substr(s, pattern), F.lit("")))


def like(s: Column, pattern: Column) -> Column:
    """Case-insensitive LIKE."""
    return F.ilike(s, pattern)


def glob(s: Column, pattern: Column) -> Column:
    """Whole-text match of a pattern with ``*``, ``?`` and ``[..]``."""
    p = F.regexp_replace(pattern, r"([.\\^$+(){}|])", r"\\$1")
    p = F.replace(F.replace(p, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.regexp_like(s, F.concat(F.lit("(?s)^(?:"), p, F.lit(")$")))


def regexp(s: Column, pattern: Column) -> Column:
    """Case-insensitive match of the whole text."""
    return F.regexp_like(s, F.concat(F.lit("(?i)^(?:"), pattern, F.lit(")$")))
