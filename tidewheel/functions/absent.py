"""Typed absence and IEEE arithmetic as Column expressions.

A value is a nullable double; where it is null, a reason says why. NaN is a value, not an absence.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WARMING_UP = "WarmingUp"
INVALID_CONFIG = "InvalidConfig"
DIVIDE_BY_ZERO = "DivideByZero"
DOMAIN_ERROR = "DomainError"
ZERO_TIME_DELTA = "ZeroTimeDelta"
FILTERED_OUT = "FilteredOut"
UPSTREAM_ABSENT = "UpstreamAbsent"
REASONS = (WARMING_UP, INVALID_CONFIG, DIVIDE_BY_ZERO, DOMAIN_ERROR, ZERO_TIME_DELTA, FILTERED_OUT, UPSTREAM_ABSENT)

INF = float("inf")
NAN = float("nan")


def label(reason: str) -> str:
    """A reason in words: `WarmingUp` is `warming up`."""
    return "".join(f" {c.lower()}" if c.isupper() else c for c in reason).strip()


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def no_nan(c: Column) -> Column:
    """NaN becomes null, so that aggregates and extremes ignore it."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def divide(n: Column, d: Column) -> Column:
    """IEEE division: x/0 is an infinity of x's sign, 0/0 and NaN/0 are NaN; null if either is null."""
    at_zero = F.when(F.isnan(n) | (n == 0), F.lit(NAN)).otherwise(F.signum(n) * F.lit(INF))
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.try_divide(n, d), at_zero))


def less(a: Column, b: Column) -> Column:
    """a < b by IEEE: false where either is NaN."""
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def at_most(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(a) & ~F.isnan(b)


def first_reason(*reasons: Column) -> Column:
    """The left operand's reason wins."""
    return F.coalesce(*reasons)
