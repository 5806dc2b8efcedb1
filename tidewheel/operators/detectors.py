"""Signal detectors: crossings, zones, glitches, runts and pulses.

Each gives a mode (a string), some a payload too. They are window expressions over gaps and islands; only
hysteresis with margin 0 runs as a kernel. Absent records say nothing and change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions import absent as A
from ..plans.series import Kernel, Series

RISING, FALLING, NONE = "Rising", "Falling", "None"


def _series(x: Series, o) -> Series:
    return o if isinstance(o, Series) else x.flow.constant(o)


def _pair_before(env, a: Series, b: Series, va: Column, vb: Column) -> tuple[Column, Column]:
    """Both values at the last record where both were present."""
    if not a.nullable and not b.nullable:
        return F.lag(va).over(env.rows), F.lag(vb).over(env.rows)
    both = va.isNotNull() & vb.isNotNull()
    before = lambda c: F.last(F.when(both, c), ignorenulls=True).over(env.before())
    return before(va), before(vb)


def cross(x: Series, threshold) -> Series:
    """Rising where x comes from below the threshold to it or above, Falling where it goes below, else None."""
    t = _series(x, threshold)

    def build(env, v, th):
        pv, pt = _pair_before(env, x, t, v, th)
        return F.when(A.less(pv, pt) & A.at_most(th, v), RISING).when(A.at_most(pt, pv) & A.less(v, th), FALLING).otherwise(NONE)

    return x.window(build, t, dtype="string", nullable=x.nullable or t.nullable)


def cross_above(x: Series, threshold) -> Series:
    return cross(x, threshold).expr(lambda m: F.when(m == RISING, m).otherwise(NONE), dtype="string")


def cross_under(x: Series, threshold) -> Series:
    return cross(x, threshold).expr(lambda m: F.when(m == FALLING, m).otherwise(NONE), dtype="string")


class Hysteresis(Kernel):
    """State Above or Below; the first record sets it silently."""

    def __init__(self, margin: float):
        self.margin, self.above = margin, None

    def step(self, ts, v, t):
        if self.above is None:
            self.above = v >= t
        elif not self.above and v >= t + self.margin:
            self.above = True
            return RISING, None
        elif self.above and v <= t - self.margin:
            self.above = False
            return FALLING, None
        return NONE, None


def cross_hysteresis(x: Series, threshold, margin: float) -> Series:
    """Rising at threshold + margin, Falling at threshold - margin."""
    t = _series(x, threshold)
    if margin <= 0:
        return x.kernel(lambda: Hysteresis(margin), t, dtype="string")
    first = x.window(lambda env, v, th: F.count(F.when(v.isNotNull() & th.isNotNull(), 1)).over(env.until_now()), t, dtype="bigint")
    mark = x.expr(lambda v, th, n: F.when(n == 1, F.when(A.at_most(th, v), 1).otherwise(0)).when(A.at_most(th + margin, v), 1).when(A.at_most(v, th - margin), 0), t, first, nullable=True, dtype="int")
    state = _carry(mark)

    def build(env, v, th, s):
        before = F.last(s, ignorenulls=True).over(env.before())
        return F.when((s == 1) & (before == 0), RISING).when((s == 0) & (before == 1), FALLING).otherwise(NONE)

    return x.window(build, t, state, dtype="string", nullable=x.nullable or t.nullable)


def _carry(mark: Series) -> Series:
    """The last mark so far, on every row."""
    def build(env, m):
        return F.last(m[0], ignorenulls=True).over(env.until_now()), F.lit(A.WARMING_UP)

    return Series(mark.flow, "window", [mark], build, False, mark.dtype)


def _islands(x: Series, threshold: float) -> tuple[Series, Series, Series]:
    """high (1 or 0), the high of the record before (0 at first), and the number of rising edges so far."""
    high = x.expr(lambda v: F.when(A.at_most(F.lit(float(threshold)), v), 1).otherwise(0), dtype="int")

    def was(env, h):
        before = F.lag(h).over(env.rows) if not x.nullable else F.last(h, ignorenulls=True).over(env.before())
        return F.coalesce(before, F.lit(0))

    before = high.window(was, dtype="int", nullable=x.nullable)
    island = high.window(lambda env, h, b: F.sum(F.when((h == 1) & (b == 0), 1).otherwise(0)).over(env.until_now()), before, dtype="bigint", nullable=x.nullable)
    return high, before, island


def _inside(env, island: Column):
    return Window.partitionBy(*env.keys, island).orderBy("__tw_ts", *env.order).rowsBetween(Window.unboundedPreceding, 0)


def _width(x: Series, threshold: float) -> tuple[Series, Series]:
    """falling edge (boolean) and the time since the rising edge."""
    high, before, island = _islands(x, threshold)
    fell = high.expr(lambda h, b: (h == 0) & (b == 1), before, dtype="boolean")
    width = high.window(lambda env, h, i: env.ts - F.min(F.when(h == 1, env.ts)).over(_inside(env, i)), island, dtype="bigint")
    return fell, width


def glitch_filter(x: Series, threshold: float, min_ms: int) -> Series:
    """At the end of a pulse ValidPulse, or Rejected if it lasted less than min_ms; else NoTransition."""
    fell, width = _width(x, threshold)
    return fell.expr(lambda f, w: F.when(~f, "NoTransition").when(w >= min_ms, "ValidPulse").otherwise("Rejected"), _zero(width), dtype="string")


def _zero(s: Series) -> Series:
    """Null becomes 0, so that a row without a pulse is present."""
    return Series(s.flow, "expr", [s], lambda c: (F.coalesce(c[0], F.lit(0)), c[1]), False, s.dtype)


def runt_detect(x: Series, low: float, high: float) -> tuple[Series, Series]:
    """mode and peak where an excursion over `low` ends: ValidPulse if its peak reached `high`, else Runt; null elsewhere."""
    if not low < high:
        raise ValueError("runt_detect: low must be below high")
    up, before, island = _islands(x, low)
    fell = up.expr(lambda h, b: (h == 0) & (b == 1), before, dtype="boolean")
    peak = x.window(lambda env, v, h, i: F.max(F.when(h == 1, A.no_nan(v))).over(_inside(env, i)), up, island)
    ends = peak.expr(lambda p, f: F.when(f, p), fell, nullable=True)
    return ends.expr(lambda p: F.when(p >= high, "ValidPulse").otherwise("Runt"), dtype="string"), ends


def pulse_width(x: Series, threshold: float, min_ms: int, max_ms: int) -> tuple[Series, Series]:
    """mode (TooShort, Valid or TooLong, both bounds valid) and width where a pulse ends; null elsewhere."""
    if min_ms > max_ms:
        raise ValueError("pulse_width: min is above max")
    fell, width = _width(x, threshold)
    ends = width.expr(lambda w, f: F.when(f, w), fell, nullable=True, dtype="bigint")
    return ends.expr(lambda w: F.when(w < min_ms, "TooShort").when(w > max_ms, "TooLong").otherwise("Valid"), dtype="string"), ends


def window_detect(x: Series, low: float, high: float) -> Series:
    """EnteredWindow, ExitedLow or ExitedHigh; null where the zone stays, jumps over the window, or on the first record."""
    if not low < high:
        raise ValueError("window_detect: low must be below high")
    zone = x.expr(lambda v: F.when(A.less(v, F.lit(float(low))), -1).when(A.less(F.lit(float(high)), v), 1).otherwise(0), dtype="int")

    def build(env, z):
        before = F.lag(z).over(env.rows) if not x.nullable else F.last(z, ignorenulls=True).over(env.before())
        return F.when((z == 0) & (before != 0), "EnteredWindow").when((before == 0) & (z == -1), "ExitedLow").when((before == 0) & (z == 1), "ExitedHigh")

    return zone.window(build, dtype="string")


# Signals: a mode with a payload.
_ACTIVE = {"Rising", "Falling", "Entered", "ExitedLow", "ExitedHigh", "Valid"}
_TO_CROSS = {"ValidPulse": RISING, "Rejected": FALLING, "NoTransition": NONE, "Runt": FALLING, "TooShort": FALLING, "Valid": RISING, "TooLong": FALLING, "EnteredWindow": RISING, "ExitedLow": FALLING, "ExitedHigh": FALLING}


def signal(mode: Column, payload: Column | None = None) -> Column:
    return F.struct(mode.alias("mode"), (payload if payload is not None else F.lit(None).cast("double")).alias("payload"))


def map_payload(s: Column, f) -> Column:
    return F.struct(s["mode"].alias("mode"), f(s["payload"]).alias("payload"))


def is_active(mode: Column) -> Column:
    return F.coalesce(mode.isin(*sorted(_ACTIVE)), F.lit(False))


def to_threshold_cross(mode: Column) -> Column:
    """Every detector's result as Rising, Falling or None."""
    out = F.lit(NONE)
    for name, to in _TO_CROSS.items():
        out = F.when(mode == name, to).otherwise(out)
    return out


for _f in (cross, cross_above, cross_under, cross_hysteresis, glitch_filter, runt_detect, pulse_width, window_detect):
    setattr(Series, _f.__name__, _f)
