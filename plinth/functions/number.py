"""Numeric functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_L = "bigint"
abs_, pi, sin, asin, cos, acos, tan, atan, atn2 = F.abs, F.pi, F.sin, F.asin, F.cos, F.acos, F.tan, F.atan, F.atan2


def floor(x: Column) -> Column:
    return F.floor(x).cast(_L)


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, digits)


def square(n: Column) -> Column:
    return n * n


def sign(x: Column) -> Column:
    return F.signum(x).cast(_L)


def mod(a: Column, b: Column) -> Column:
    """Truncated remainder, null for a zero divisor."""
    return F.when(b != 0, a % F.when(b != 0, b))


def rand(seed: int | None = None) -> Column:
    return F.rand() if seed is None else F.rand(seed)


def int_div(a: Column, b: Column) -> Column:
    """Truncating division of whole numbers; a zero divisor is an error."""
    return _div(a, b)


def _div(a: Column, b: Column) -> Column:
    # The truncated remainder makes the division exact, without a detour over doubles.
    q = (a - a % b).cast("decimal(38,0)") / b.cast("decimal(38,0)")
    return q.cast(_L)


def float_div(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN instead of an error."""
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def power(a: Column, b: Column) -> Column:
    """Whole powers, exact; a negative exponent or a result beyond 64 bits is an error."""
    wrong = lambda text: F.raise_error(F.lit(text)).cast(_L)
    about = F.pow(a.cast("double"), b.cast("double"))
    # No power of a base but -1, 0 and 1 with an exponent of 64 or more fits.
    times = F.when((F.abs(a.cast("double")) > 1) & b.between(0, 63) & (F.abs(about) <= 2.0**63), b).otherwise(0).cast("int")
    product = F.aggregate(F.array_repeat(a, times), F.lit(1).cast(_L), lambda out, x: out * x)
    trivial = F.when(b == 0, 1).when(b == 1, a).when(a == -1, F.when(b % 2 == 0, 1).otherwise(-1)).otherwise(a).cast(_L)
    fits = (about >= -(2.0**63)) & (about < 2.0**63)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast(_L))
        .when(b < 0, wrong("a whole power has no negative exponent"))
        .when(a.between(-1, 1) | (b <= 1), trivial)
        .when(fits, product)
        .otherwise(wrong("a power is beyond 64 bits"))
    )
