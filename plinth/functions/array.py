"""Array functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_L = "bigint"
array_append, array_remove, array_cat, array_shuffle, contains = F.array_append, F.array_remove, F.concat, F.shuffle, F.array_contains


def array_prepend(element: Column, arr: Column) -> Column:
    return F.array_prepend(arr, element)


def array_length(arr: Column) -> Column:
    return F.array_size(arr).cast(_L)


def array_position(arr: Column, element: Column) -> Column:
    """1-based first place, null if absent."""
    return F.nullif(F.array_position(arr, element), F.lit(0).cast(_L))


def array_positions(arr: Column, element: Column) -> Column:
    return F.filter(F.transform(arr, lambda x, i: F.when(x == element, (i + 1).cast(_L))), lambda x: x.isNotNull())


def array_replace(arr: Column, old: Column, new: Column) -> Column:
    return F.transform(arr, lambda x: F.when(x == old, new).otherwise(x))


def trim_array(arr: Column, n: Column) -> Column:
    """Without the last n elements."""
    return F.slice(arr, F.lit(1), F.greatest(F.array_size(arr) - n, F.lit(0)).cast("int"))


def cardinality(arr: Column, rank: int = 1) -> Column:
    """Number of leaves: the length times that of the first element, rank by rank."""
    out = F.array_size(arr).cast(_L)
    inner = arr
    for _ in range(rank - 1):
        inner = F.get(inner, 0)
        out = out * F.coalesce(F.array_size(inner), F.lit(0))
    return F.when(arr.isNotNull(), out).cast(_L)


def element(arr: Column, i: Column) -> Column:
    """1-based; an index out of range is an error."""
    return F.element_at(arr, i.cast("int"))


def slice_(arr: Column, start: Column | None, end: Column | None) -> Column:
    """Elements start to end, both inclusive and 1-based; an open end reaches the border."""
    s = F.lit(1) if start is None else start
    e = F.array_size(arr) if end is None else end
    return F.slice(arr, F.greatest(s, F.lit(1)).cast("int"), F.greatest(e - F.greatest(s, F.lit(1)) + 1, F.lit(0)).cast("int"))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.when(a.isNotNull() & b.isNotNull(), False))


def any_(arr: Column, test) -> Column:
    return F.exists(arr, test)


def all_(arr: Column, test) -> Column:
    return F.forall(arr, test)
