"""Bands, scores and conditioning made of windows and trackers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import absent as A
from ..plans.series import Series
from .windows import _frame, sliding


def deviation_band(x: Series, window, k: float) -> tuple[Series, Series, Series]:
    """middle, upper, lower: the mean, and k population deviations around it."""
    middle, dev = x.sma(window), x.std(window)
    return middle, middle + dev * k, middle - dev * k


def zscore(x: Series, window) -> Series:
    return (x - x.sma(window)).divide_safe(x.std(window))


def peak_decline(x: Series) -> Series:
    top = x.cummax()
    return (x - top) / top


def momentum(x: Series, period: int) -> Series:
    return x - x.prev_n(period)


def rate_of_change(x: Series, period: int) -> Series:
    before = x.prev_n(period)
    return (x - before).divide_safe(before) * 100.0


def dc_remove(x: Series, window) -> Series:
    return x - x.sma(window)


def baseline_correct(x: Series, window, percentile: float) -> Series:
    return x - x.quantile(window, percentile)


def normalize_range(x: Series, window) -> Series:
    low, high = x.min(window), x.max(window)
    return (x - low).divide_safe(high - low)


def calibrate(x: Series, gain: float, offset: float) -> Series:
    return x * gain + offset


# Conditioning primitives: like the composites, but with their own rules at the edges.
def dc_remover(x: Series, window) -> Series:
    return dc_remove(x, window)


def baseline_corrector(x: Series, n: int, p: float) -> Series:
    """x less the percentile at the floor of p·(n-1), not interpolated."""
    if n < 1 or not 0.0 <= p <= 1.0:
        raise ValueError("baseline_corrector: n >= 1 and 0 <= p <= 1")
    return _frame(x, n, lambda o, v: v - F.get(F.sort_array(o.list(v)), F.floor((o.count(v) - 1) * F.lit(float(p))).cast("int")))


_EPS = 2.220446049250313e-16


def range_normalizer(x: Series, n: int) -> Series:
    """(x-min)/(max-min), 0.5 where the range is 0."""
    if n < 1:
        raise ValueError("range_normalizer: n >= 1")

    def f(o, v):
        low, high = o.min(A.no_nan(v)), o.max(A.no_nan(v))
        return F.when(high - low < _EPS, 0.5).otherwise(F.try_divide(v - low, high - low))

    return _frame(x, n, f)


def zscore_normalizer(x: Series, n: int) -> Series:
    """(x-mean)/std, 0 where the deviation is 0."""
    if n < 2:
        raise ValueError("zscore_normalizer: n >= 2")

    def f(o, v):
        s = F.sqrt(o.var(v))
        return F.when(s < _EPS, 0.0).otherwise(F.try_divide(v - o.avg(v), s))

    return _frame(x, n, f)


def linreg(x: Series, y: Series, n: int) -> tuple[Series, Series, Series]:
    """slope, intercept and r² of y on x over the last n pairs; a constant x gives (0, mean y), a constant y r² = 1."""
    if n < 2:
        raise ValueError("linreg: n >= 2")
    some = lambda o, a: o.count(a) >= 2
    slope = lambda o, a, b: F.when(o.var(a) < _EPS, 0.0).otherwise(F.try_divide(o.cov(a, b), o.var(a)))
    s = _frame(x, sliding(n), lambda o, a, b: F.when(some(o, a), slope(o, a, b)), y)
    i = _frame(x, sliding(n), lambda o, a, b: F.when(some(o, a), o.avg(b) - slope(o, a, b) * o.avg(a)), y)

    def fit(o, a, b):
        explained = F.when(o.var(a) < _EPS, 0.0).otherwise(F.try_divide(o.cov(a, b) * o.cov(a, b), o.var(a) * o.var(b)))
        return F.when(some(o, a), F.when(o.var(b) < _EPS, 1.0).otherwise(explained))

    return s, i, _frame(x, sliding(n), fit, y)


class GainOffset:
    """raw·gain + offset, its inverse, and the calibration from two points."""

    def __init__(self, gain: float, offset: float):
        self.gain, self.offset = gain, offset

    @classmethod
    def from_two_points(cls, raw1: float, ref1: float, raw2: float, ref2: float) -> GainOffset:
        if -_EPS < raw2 - raw1 < _EPS:
            return cls(0.0, ref1)
        gain = (ref2 - ref1) / (raw2 - raw1)
        return cls(gain, ref1 - gain * raw1)

    def apply(self, x: Series) -> Series:
        return x * self.gain + self.offset

    def inverse(self, x: Series) -> Series:
        return (x - self.offset) / self.gain


for _f in (deviation_band, zscore, peak_decline, momentum, rate_of_change, dc_remove, baseline_correct, normalize_range, calibrate, dc_remover, baseline_corrector, range_normalizer, zscore_normalizer, linreg):
    setattr(Series, _f.__name__, _f)
