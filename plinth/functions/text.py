"""Text functions as Columns.  Nulls give nulls unless stated; results that are Int are bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_L = "bigint"


def bin_(n: Column) -> Column:
    return F.bin(n)


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def reverse(s: Column) -> Column:
    return F.reverse(s)


def replicate(s: Column, n: Column) -> Column:
    return F.repeat(s, n.cast("int"))


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), n.cast("int"))


def trim(s: Column) -> Column:
    """Strips all Unicode white space, not only U+0020."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def len_(s: Column) -> Column:
    """Bytes of UTF-8."""
    return F.octet_length(s).cast(_L)


def ascii_(s: Column) -> Column:
    """Code point of the first character, 0 for the empty text."""
    return F.ascii(s).cast(_L)


def left(s: Column, n: Column) -> Column:
    return F.left(s, n.cast("int"))


def right(s: Column, n: Column) -> Column:
    return F.right(s, n.cast("int"))


def char(n: Column) -> Column:
    """The character of a code point; empty text if there is none."""
    valid = ((n >= 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    return F.when(n.isNull(), None).when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")


def charindex(needle: Column, hay: Column) -> Column:
    """1-based position of the first occurrence, case-insensitive; 0 if absent."""
    return F.instr(F.lower(hay), F.lower(needle)).cast(_L)


def replace(s: Column, old: Column, new: Column) -> Column:
    """Replaces every occurrence, case-insensitive; an empty ``old`` changes nothing."""
    pattern = F.concat(F.lit("(?i)\\Q"), F.replace(old, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    quoted = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(old == "", s).otherwise(F.regexp_replace(s, pattern, quoted))


def substring(s: Column, start: Column, count: Column) -> Column:
    """1-based; the whole text when start or count exceed it, empty for a negative count."""
    n = F.length(s)
    return F.when(count < 0, "").when((start > n) | (count > n), s).otherwise(F.substr(s, F.greatest(start, F.lit(1)).cast("int"), count.cast("int")))


def stuff(s: Column, start: Column, count: Column, new: Column) -> Column:
    """Deletes ``count`` characters at ``start`` and puts ``new`` there; unchanged if out of range."""
    n = F.length(s)
    ok = (start >= 1) & (start <= n) & (count >= 0) & (count <= n)
    changed = F.concat(F.substr(s, F.lit(1), (start - 1).cast("int")), new, F.substr(s, (start + count).cast("int")))
    return F.when(s.isNull() | start.isNull() | count.isNull() | new.isNull(), None).when(ok, changed).otherwise(s)


def translate(s: Column, source: Column, target: Column) -> Column:
    """Characters are replaced one after another, so results may be replaced again; empty if the lists differ in length."""
    pairs = F.arrays_zip(F.split(source, "").alias("a"), F.split(target, "").alias("b"))
    chained = F.aggregate(pairs, s, lambda acc, p: F.when(p["a"] == "", acc).otherwise(F.replace(acc, p["a"], p["b"])))
    return F.when(s.isNull() | source.isNull() | target.isNull(), None).when(F.length(source) != F.length(target), "").otherwise(chained)


def soundex(s: Column) -> Column:
    """First character as typed, a digit for each further coded letter (repeats stay), padded to four."""
    rest = F.regexp_replace(F.upper(F.substr(s, F.lit(2))), "[AEIOUHWY]", "")
    coded = F.translate(F.regexp_replace(rest, "[^BFPVCGJKQSXZDTLMNR]", "0"), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    return F.when(s == "", "").otherwise(F.concat(F.left(s, F.lit(1)), F.rpad(F.substring(coded, 1, 3), 3, "0")))


def shown(c: Column) -> Column:
    """Text form of any value; a null shows as ``Null``."""
    return F.coalesce(c.cast("string"), F.lit("Null"))


def concat(*parts: Column) -> Column:
    return F.concat(*map(shown, parts))


def concat_ws(separator: Column, *parts: Column) -> Column:
    out = shown(parts[0])
    for p in parts[1:]:
        out = F.concat(out, separator, shown(p))
    return out


def unicode_(s: Column) -> Column:
    return F.ascii(s).cast(_L)


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1).cast(_L)


def quotename(s: Column, quote: Column | None = None) -> Column:
    """One quote character stands at both ends, two at either end; other quotes give null."""
    q = F.lit("[]") if quote is None else quote
    n = F.length(q)
    return F.when(n == 1, F.concat(q, s, q)).when(n == 2, F.concat(F.left(q, F.lit(1)), s, F.right(q, F.lit(1))))


def str_(x: Column, length: Column | None = None, decimals: int = 0) -> Column:
    """Fixed number of decimals; cut or filled with blanks on the right to ``length`` if given."""
    text = F.format_string(f"%.{decimals}f", x.cast("double"))
    return text if length is None else F.rpad(text, length.cast("int"), F.lit(" "))


def to_hex(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


def commit_conventional(title: Column) -> Column:
    """What stands before the first colon, empty without one."""
    return F.when(F.instr(title, ":") > 0, F.substring_index(title, ":", 1)).when(title.isNotNull(), "")
