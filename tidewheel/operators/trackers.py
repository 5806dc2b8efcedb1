"""Values of earlier records: previous, lagged, cumulative, rates of change."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, Window, functions as F

from ..functions import absent as A
from ..functions.duration import dur
from ..plans.series import Kernel, Series


def _before(env, x: Series, c: Column, n: int = 1) -> Column:
    """The present value n records back (n = 1 where some may be absent)."""
    if not x.nullable:
        return F.lag(c, n).over(env.rows)
    return F.last(c, ignorenulls=True).over(env.before())


def prev(x: Series) -> Series:
    """The previous present value."""
    return x.window(lambda env, v: _before(env, x, v))


def prev_n(x: Series, n: int) -> Series:
    """The present value n steps back: prev taken n times."""
    if not x.nullable or n == 1:
        return x.window(lambda env, v: _before(env, x, v, n))
    return x.window(lambda env, v, seq: F.max(v).over(env.by(seq).rangeBetween(-n, -n)), x.present())


def prev_by(x: Series, *subkeys: str) -> Series:
    """The previous value of the record's own sub-key (columns)."""
    x.flow.pinned.update(subkeys)

    def build(env, v):
        w = Window.partitionBy(*env.keys, *[F.col(c) + F.lit(0.0) if k == "double" else F.col(c) for c, k in x.flow.df.dtypes if c in subkeys]).orderBy("__tw_ts", *env.order)
        return F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    return x.window(build)


class PrevOfMost(Kernel):
    """The previous value of the sub-key, of the `most` sub-keys seen last."""

    def __init__(self, most: int):
        self.most, self.held = most, OrderedDict()

    def step(self, ts, v, subkey):
        subkey += 0.0  # -0.0 and 0.0 are one key
        before = self.held.pop(subkey, None)
        self.held[subkey] = v
        if len(self.held) > self.most:
            self.held.popitem(last=False)
        return (None, A.WARMING_UP) if before is None else (before, None)


def prev_by_max(x: Series, subkey: Series, most: int) -> Series:
    """prev_by with a bound on the sub-keys of a key: the one seen longest ago is forgotten."""
    if most < 1:
        raise ValueError("at least one sub-key is kept")
    return x.kernel(lambda: PrevOfMost(most), subkey)


def lag(x: Series, duration) -> Series:
    """The latest value with a timestamp at or before ts - duration."""
    d = dur(duration)
    if d == 0:
        return x

    def build(env, v):
        at = Window.partitionBy(*env.keys).orderBy("__tw_ts").rangeBetween(Window.unboundedPreceding, -d)
        if env.unique_ts:
            return F.last(v, ignorenulls=True).over(at)
        held = F.struct(env.ts.alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(env.order)], v.alias("v"))
        return F.max(F.when(v.isNotNull(), held)).over(at)["v"]  # the last of ties

    return x.window(build)


def delta(x: Series, duration) -> Series:
    return x - lag(x, duration)


def changes(x: Series) -> Series:
    """Difference to the previous present value."""
    return x.window(lambda env, v: v - _before(env, x, v))


def _time_before(env, x: Series, c: Column) -> Column:
    if not x.nullable:
        return F.lag(env.ts).over(env.rows)
    return F.last(F.when(c.isNotNull(), env.ts), ignorenulls=True).over(env.before())


def rate(x: Series, duration=0) -> Series:
    """Change per second since the previous value; absent (ZeroTimeDelta) where no time has passed. The duration is not used."""

    def build(env, v):
        p, dt = _before(env, x, v[0]), env.ts - _time_before(env, x, v[0])
        out = F.when(dt > 0, F.try_divide(v[0] - p, dt.cast("double")) * 1000.0)
        r = F.when(v[0].isNull(), v[1]).when(p.isNotNull() & (dt <= 0), A.ZERO_TIME_DELTA).otherwise(A.WARMING_UP)
        return (F.when(v[0].isNotNull(), out) if x.nullable else out), r

    return Series(x.flow, "window", [x], build, True)


velocity = rate


def acceleration(x: Series, duration=0) -> Series:
    """Change of velocity per second since the last velocity that was defined; the duration is not used."""
    r = rate(x)

    def build(env, r, v):
        before, dt = F.last(r[0], ignorenulls=True).over(env.before()), env.ts - _time_before(env, x, v[0])
        return F.when(r[0].isNotNull(), F.try_divide(r[0] - before, dt.cast("double")) * 1000.0), F.when(r[0].isNull(), r[1]).otherwise(A.WARMING_UP)

    return Series(x.flow, "window", [r, x], build, True)


def _running(x: Series, f) -> Series:
    return x.window(lambda env, v: f(v).over(env.until_now()))


def cumsum(x: Series) -> Series:
    return _running(x, F.sum)


def cumprod(x: Series) -> Series:
    return _running(x, F.product)


def cummax(x: Series) -> Series:
    return _running(x, lambda v: F.max(A.no_nan(v)))


def cummin(x: Series) -> Series:
    return _running(x, lambda v: F.min(A.no_nan(v)))


def cummean(x: Series) -> Series:
    return _running(x, F.avg)


def _against_prev(x: Series, f, reason: str) -> Series:
    def build(env, v):
        p = _before(env, x, v[0])
        out = f(v[0], p)
        r = F.when(v[0].isNull(), v[1]).when(p.isNull(), A.WARMING_UP).otherwise(reason)
        return (F.when(v[0].isNotNull(), out) if x.nullable else out), r

    return Series(x.flow, "window", [x], build, True)


def pct_change(x: Series) -> Series:
    """Per cent; absent (DivideByZero) after a zero."""
    return _against_prev(x, lambda v, p: F.when(p != 0, F.try_divide(v - p, p) * 100.0), A.DIVIDE_BY_ZERO)


def log_return(x: Series) -> Series:
    """ln(v/p); absent (DomainError) unless both are above zero."""
    return _against_prev(x, lambda v, p: F.when((v > 0) & (p > 0), F.ln(F.try_divide(v, p))), A.DOMAIN_ERROR)


def rate_per_ms(x: Series) -> Series:
    """Change per millisecond since the previous value; absent where no time has passed."""
    return rate(x).expr(lambda v: v / 1000.0)


for _f in (prev, prev_n, prev_by, prev_by_max, lag, delta, changes, rate, acceleration, cumsum, cumprod, cummax, cummin, cummean, pct_change, log_return, rate_per_ms):
    setattr(Series, _f.__name__, _f)
Series.velocity = velocity
