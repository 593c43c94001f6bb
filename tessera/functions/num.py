"""Arithmetic at six decimals.

Weights are doubles rounded to six places after each step.  Halves round up, towards
positive infinity, so `F.round` (halves away from zero) is not a substitute.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISION = 6
UNIT = 10.0**PRECISION


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def r6(x) -> Column:
    """Rounded to six decimals.  The argument stands once in the result, so nested steps stay small.

    For finite numbers; `or_nan` keeps NaN where a column may hold it.
    """
    return F.floor(col(x) * UNIT + 0.5) / UNIT


def or_nan(x, step) -> Column:
    """step(x), or NaN where x is NaN: Spark's comparisons take NaN for the largest number."""
    x = col(x)
    return F.when(F.isnan(x), x).otherwise(step(x))


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    """Held to [low, high], then rounded; null stays null, which Spark's extremes would skip."""
    x = col(x)
    return F.when(x.isNotNull(), r6(F.least(F.lit(high), F.greatest(F.lit(low), x))))


def add(a, b) -> Column:
    return r6(col(a) + col(b))


def subtract(a, b) -> Column:
    return r6(col(a) - col(b))


def multiply(a, b) -> Column:
    return r6(col(a) * col(b))


def divide(a, b, strict: bool = True) -> Column:
    """Rounded quotient; a zero divisor raises, or gives null where `strict` is off."""
    a, b = col(a), col(b)
    zero = F.raise_error(F.lit("division by zero")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(b == 0, zero).otherwise(r6(a / F.when(b != 0, b)))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def py_r6(x: float) -> float:
    """The driver's twin of `r6`."""
    import math

    return math.floor(x * UNIT + 0.5) / UNIT


def sql_r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def sql_clamp(x: str, low: str = "0", high: str = "1") -> str:
    return sql_r6(f"least({high}, greatest({low}, {x}))")
