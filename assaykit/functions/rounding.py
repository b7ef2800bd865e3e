"""Decimal rounding of binary doubles by the exact value, as fixed-point formatting does it.

Spark's round() works on the shortest decimal text of a double, so 0.15 gives 0.2 although the double lies below the tie.
Here the product with the power of ten is taken with its exact error (the double is split in two halves), and only a true
tie or more rounds up. The expressions are plain arithmetic on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0


def bound(value: Column, body) -> Column:
    """body(value) with value written once: keeps long expressions, and the code generated for them, small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_fixed(x: Column, digits: int) -> Column:
    """x rounded to `digits` (6 at most) decimals; ties go away from zero. Null stays null."""
    c = F.lit(10.0**digits)

    def rounded(x: Column) -> Column:
        y = F.abs(x)
        p = y * c
        high = y * SPLIT - (y * SPLIT - y)
        error = (high * c - p) + (y - high) * c
        whole = F.floor(p).cast("double")
        part = p - whole
        up = F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(x < 0, -1.0).otherwise(1.0) * ((whole + up) / c)

    return bound(x.cast("double"), rounded)


def to_fixed_sql(x: str, digits: int) -> str:
    """The same as SQL text."""
    c, y = f"{10.0**digits}::DOUBLE", f"abs(({x})::DOUBLE)"
    s = f"({SPLIT}::DOUBLE)"
    high = f"({y} * {s} - ({y} * {s} - {y}))"
    part = f"({y} * {c} - floor({y} * {c}))"
    error = f"(({high} * {c} - {y} * {c}) + ({y} - {high}) * {c})"
    up = f"(CASE WHEN {part} > 0.5::DOUBLE OR ({part} = 0.5::DOUBLE AND {error} >= 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"((CASE WHEN ({x}) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * ((floor({y} * {c}) + {up}) / {c}))"


def round_half_up(x: Column, digits: int = 1) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the other rule, used for separation reports and adjudication shares."""
    c = F.lit(10.0**digits)
    return F.floor(x * c + F.lit(0.5)).cast("double") / c


def estimate_cost(tokens: Column, price_per_million: Column) -> Column:
    """Cost of tokens; null without a price."""
    return tokens.cast("double") / F.lit(1e6) * price_per_million


def clamp(x: Column, low: float, high: float, digits: int = 1) -> Column:
    return to_fixed(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)), digits)
