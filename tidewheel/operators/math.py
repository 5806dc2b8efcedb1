"""Scalar functions of a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import absent as A
from ..plans.series import Series


def abs(x: Series) -> Series:  # noqa: A001
    return x.expr(F.abs)


def exp(x: Series) -> Series:
    return x.expr(F.exp)


def floor(x: Series) -> Series:
    """As a double; beyond 2^53 a double is whole already."""
    return x.expr(lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v))


def ceil(x: Series) -> Series:
    return x.expr(lambda v: F.when(F.abs(v) < 2.0**53, F.ceil(v).cast("double")).otherwise(v))


def round(x: Series) -> Series:  # noqa: A001
    """Half away from zero."""
    return x.expr(lambda v: F.round(v))


def pow(x: Series, e: float) -> Series:  # noqa: A001
    return x.expr(lambda v: F.pow(v, F.lit(float(e))))


def clamp(x: Series, low: float, high: float) -> Series:
    if low > high:
        raise ValueError("clamp: low is above high")
    return x.expr(lambda v: F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))))


def _domain(f, ok):
    return lambda x: x.expr(lambda v: F.when(ok(v) | F.isnan(v), f(v)), nullable=True, reason=lambda v: F.lit(A.DOMAIN_ERROR))


sqrt = _domain(F.sqrt, lambda v: v >= 0)
ln = _domain(F.ln, lambda v: v > 0)
log10 = _domain(F.log10, lambda v: v > 0)
log2 = _domain(F.log2, lambda v: v > 0)

for _n, _f in (("abs", abs), ("exp", exp), ("floor", floor), ("ceil", ceil), ("round", round), ("pow", pow), ("clamp", clamp), ("sqrt", sqrt), ("ln", ln), ("log10", log10), ("log2", log2)):
    setattr(Series, _n, _f)
