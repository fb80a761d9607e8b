"""Ranges: a struct of lower (inclusive) and upper (exclusive) bound; a null bound is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column) -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"))


int4range = daterange = tsrange = make


def isempty(r: Column) -> Column:
    return r["lower"] == r["upper"]


def contains(r: Column, v: Column) -> Column:
    return (r["lower"].isNull() | (v >= r["lower"])) & (r["upper"].isNull() | (v < r["upper"]))


def contains_range(r: Column, other: Column) -> Column:
    low = r["lower"].isNull() | (other["lower"].isNotNull() & (other["lower"] >= r["lower"]))
    high = r["upper"].isNull() | (other["upper"].isNotNull() & (other["upper"] <= r["upper"]))
    return low & high


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(a["lower"], b["lower"]) < F.least(a["upper"], b["upper"])
