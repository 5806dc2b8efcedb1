"""Sliding-window aggregates over Count(n) or Time(length).

Count windows hold the last n present values: over a series without absent rows that is a ROWS frame, else a
RANGE frame over the number of present values. Time windows include both ends; where timestamps may be equal, a
row sees only the ties that came before it. Results come from the first row
on, with the least counts of each statistic; what isn't finite is absent (WarmingUp).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, Window, functions as F

from ..functions import absent as A
from ..plans.series import Kernel, Series
from ..plans.windows import Count, Time, sliding


class Frame:
    """Aggregates over one window frame, each made once for all that use it."""

    def __init__(self, env, at):
        self.env, self.at = env, at

    def over(self, c: Column) -> Column:
        return self.env.shared.once(c.over(self.at))

    def sum(self, v: Column) -> Column:
        return self.over(F.sum(v))

    def count(self, v: Column) -> Column:
        return self.over(F.count(v))

    def avg(self, v: Column) -> Column:
        return self.over(F.avg(v))

    def min(self, v: Column) -> Column:
        return self.over(F.min(v))

    def max(self, v: Column) -> Column:
        return self.over(F.max(v))

    def var(self, v: Column) -> Column:
        return self.over(F.var_pop(v))

    def cov(self, a: Column, b: Column) -> Column:
        return self.over(F.covar_pop(a, b))

    def corr(self, a: Column, b: Column) -> Column:
        """Where a variance is 0, null; F.corr would raise, in a branch that isn't taken too."""
        return F.try_divide(self.cov(a, b), F.sqrt(self.var(a) * self.var(b)))

    def skewness(self, v: Column) -> Column:
        return self.over(F.skewness(v))

    def kurtosis(self, v: Column) -> Column:
        return self.over(F.kurtosis(v))

    def quantile(self, v: Column, q: float) -> Column:
        return self.over(F.percentile(v, F.lit(q)))

    def list(self, v: Column) -> Column:
        return self.over(F.collect_list(v))


class TwoFrames(Frame):
    """A time window over a key whose timestamps may be equal: all earlier times, and of the ties those that came before.

    Both parts are frames of the JVM; their aggregates are merged, without taking anything away again.
    """

    def __init__(self, older: Frame, ties: Frame):
        self.parts = (older, ties)

    def sum(self, v: Column) -> Column:
        a, b = (p.sum(v) for p in self.parts)
        return F.coalesce(a + b, a, b)

    def count(self, v: Column) -> Column:
        a, b = (p.count(v) for p in self.parts)
        return a + b

    def avg(self, v: Column) -> Column:
        return F.try_divide(self.sum(v), self.count(v))

    def min(self, v: Column) -> Column:
        return F.least(*(p.min(v) for p in self.parts))

    def max(self, v: Column) -> Column:
        return F.greatest(*(p.max(v) for p in self.parts))

    def _merged(self, a: Column, b: Column, of) -> Column:
        """Co-moments of both parts, and what their means' distance adds."""
        (n, m), (x, y) = [p.count(a) for p in self.parts], [of(p) for p in self.parts]
        apart = [self.parts[0].avg(c) - self.parts[1].avg(c) for c in (a, b)]
        total = F.coalesce(n * x, F.lit(0.0)) + F.coalesce(m * y, F.lit(0.0)) + F.coalesce(apart[0] * apart[1] * F.try_divide((n * m).cast("double"), (n + m).cast("double")), F.lit(0.0))
        return F.try_divide(total, (n + m).cast("double"))

    def var(self, v: Column) -> Column:
        return self._merged(v, v, lambda p: p.var(v))

    def cov(self, a: Column, b: Column) -> Column:
        return self._merged(a, b, lambda p: p.cov(a, b))

    def list(self, v: Column) -> Column:
        return F.concat(*(p.list(v) for p in self.parts))

    def _moment(self, v: Column, k: int) -> Column:
        mean, held = self.avg(v), self.list(v)
        return F.try_divide(F.aggregate(held, F.lit(0.0), lambda acc, x: acc + F.pow(x - mean, F.lit(k))), F.size(held).cast("double"))

    def skewness(self, v: Column) -> Column:
        return F.try_divide(self._moment(v, 3), F.pow(self._moment(v, 2), F.lit(1.5)))

    def kurtosis(self, v: Column) -> Column:
        return F.try_divide(self._moment(v, 4), F.pow(self._moment(v, 2), F.lit(2))) - 3.0

    def quantile(self, v: Column, q: float) -> Column:
        held = F.sort_array(self.list(v))
        at = (F.size(held) - 1) * F.lit(q)
        low = F.get(held, F.floor(at).cast("int"))
        return low + (F.get(held, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def _frame(x: Series, window, f: Callable[..., Column], *others: Series) -> Series:
    """f(frame, *values): the statistic as a Column of a frame's aggregates."""
    w = sliding(window)
    bound = max_reach(x, *others) + w.length if isinstance(w, Time) else math.inf
    extra: list[Series] = []
    if isinstance(w, Time) and x.flow.env.unique_ts:
        frame = lambda env, seq: Frame(env, env.back(w.length))
    elif isinstance(w, Time):
        frame = lambda env, seq: TwoFrames(Frame(env, env.back(w.length, -1)), Frame(env, env.ties())) if w.length > 0 else Frame(env, env.ties())
    elif any(s.nullable for s in (x, *others)):
        both = x if not others else x.expr(lambda a, *b: a, *others)
        frame, extra = (lambda env, seq: Frame(env, env.by(seq).rangeBetween(-(w.n - 1), 0))), [both.present()]
    else:
        frame = lambda env, seq: Frame(env, env.rows.rowsBetween(-(w.n - 1), 0))

    def build(env, *v):
        at = frame(env, v[-1] if extra else None)
        values = v[: len(v) - len(extra)]
        if len(values) > 1:  # pairs count only where both are present
            whole = values[0].isNotNull()
            for c in values[1:]:
                whole = whole & c.isNotNull()
            values = tuple(F.when(whole, c) for c in values)
        out = env.shared.once(f(at, *values), 1)
        return F.when(A.is_finite(out), out)

    out = x.window(build, *others, *extra)
    out.reach = bound
    return out


def max_reach(*series: Series) -> float:
    return builtin_max(*[s.reach for s in series], 0.0)


#: From this many rows on, sums and means come from sums within blocks: constant time a row, not the frame's length.
LONG = 256


def _long(x: Series, window) -> tuple[Series, Series] | None:
    """Sum and count of a long Count window; None for other windows.

    A key's rows are cut into blocks as long as the window. A window is the end of a block and the beginning of the
    next one, so its sum is a running sum backwards and one forwards, and holds nothing from outside of the window.
    """
    w = sliding(window)
    if not isinstance(w, Count) or w.n < LONG or x.nullable:
        return None
    n = w.n
    place = x.window(lambda env, v: (F.row_number().over(env.rows) - 1).cast("bigint"), nullable=False, dtype="bigint")

    def span(s: Series) -> Series:
        def run(backwards: bool) -> Callable:
            return lambda env, v, k: F.sum(v).over(env.within(F.floor(k / F.lit(n)), backwards).rowsBetween(Window.unboundedPreceding, 0))

        ahead, behind = s.window(run(False), place, nullable=False), s.window(run(True), place, nullable=False)
        return ahead.window(lambda env, a, b, k: a + F.when(k % n == n - 1, F.lit(0.0)).otherwise(F.coalesce(F.lag(b, n - 1).over(env.rows), F.lit(0.0))), behind, place, nullable=False)

    total = span(x).expr(lambda t: F.when(A.is_finite(t), t), nullable=True, reason=lambda t: F.lit(A.WARMING_UP))
    return total, place.expr(lambda k: F.least(k + 1, F.lit(n)).cast("double"))


def _guard(n: int, o: Frame, v: Column, c: Column) -> Column:
    return F.when(o.count(v) >= n, c)


def sma(x: Series, window) -> Series:
    if long := _long(x, window):
        return long[0].expr(lambda t, n: t / n, long[1])
    return _frame(x, window, lambda o, v: o.avg(v))


def sum(x: Series, window) -> Series:  # noqa: A001
    if long := _long(x, window):
        return long[0]
    return _frame(x, window, lambda o, v: o.sum(v))


def count(x: Series, window) -> Series:
    return _frame(x, window, lambda o, v: o.count(v).cast("double"))


def min(x: Series, window) -> Series:  # noqa: A001
    return _frame(x, window, lambda o, v: o.min(A.no_nan(v)))


def max(x: Series, window) -> Series:  # noqa: A001
    return _frame(x, window, lambda o, v: o.max(A.no_nan(v)))


def variance(x: Series, window) -> Series:
    return _frame(x, window, lambda o, v: _guard(2, o, v, o.var(v)))


def std(x: Series, window) -> Series:
    return _frame(x, window, lambda o, v: _guard(2, o, v, F.sqrt(o.var(v))))


def quantile(x: Series, window, q: float) -> Series:
    """Linear interpolation at q·(n-1)."""
    q = float(np.clip(q, 0.0, 1.0))
    return _frame(x, window, lambda o, v: o.quantile(v, q))


def median(x: Series, window) -> Series:
    return quantile(x, window, 0.5)


def percentile(x: Series, window, p: float) -> Series:
    return quantile(x, window, p / 100.0)


def iqr(x: Series, window) -> Series:
    return quantile(x, window, 0.75) - quantile(x, window, 0.25)


def rank(x: Series, window) -> Series:
    """Share of the window's other values below the current one."""

    def f(o, v):
        held = o.list(v)
        return F.size(F.filter(held, lambda y: A.less(y, v))) / F.greatest(F.size(held) - 1, F.lit(1))

    return _frame(x, window, f)


def skewness(x: Series, window) -> Series:
    return _frame(x, window, lambda o, v: F.when((o.count(v) >= 3) & (o.var(v) > 0), o.skewness(v)))


def kurtosis(x: Series, window) -> Series:
    """Excess, of the population."""
    return _frame(x, window, lambda o, v: F.when((o.count(v) >= 4) & (o.var(v) > 0), o.kurtosis(v)))


def covariance(x: Series, y: Series, window) -> Series:
    return _frame(x, window, lambda o, a, b: _guard(2, o, a, o.cov(a, b)), y)


def sample_covariance(x: Series, y: Series, window) -> Series:
    return _frame(x, window, lambda o, a, b: _guard(2, o, a, o.cov(a, b) * o.count(a) / F.greatest(o.count(a) - 1, F.lit(1))), y)


def correlation(x: Series, y: Series, window) -> Series:
    return _frame(x, window, lambda o, a, b: F.when((o.count(a) >= 2) & (o.var(a) > 0) & (o.var(b) > 0), o.corr(a, b)), y)


def beta(x: Series, y: Series, window) -> Series:
    """Slope of y on x."""
    return _frame(x, window, lambda o, a, b: F.when((o.count(a) >= 2) & (o.var(a) > 0), o.cov(a, b) / F.nullif(o.var(a), F.lit(0.0))), y)


def alpha(x: Series, y: Series, window) -> Series:
    """Intercept of y on x."""
    return _frame(x, window, lambda o, a, b: F.when((o.count(a) >= 2) & (o.var(a) > 0), o.avg(b) - o.cov(a, b) / F.nullif(o.var(a), F.lit(0.0)) * o.avg(a)), y)


def wma(x: Series, window) -> Series:
    """Count: weights 1..n from oldest to newest. Time: weight (ts - oldest)/span + 0.001; mean where the span is 0."""
    w = sliding(window)
    if isinstance(w, Count):
        def f(o, v):
            held = o.list(v)
            total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(held, i - 1), F.lit(0.0)) * i)
            n = F.size(held)
            return F.when(n > 0, total / F.greatest(n * (n + 1) / F.lit(2.0), F.lit(1.0)))

        return _frame(x, w, f)

    def t(o, v):
        at = F.when(v.isNotNull(), F.col("__tw_ts"))
        first, times = o.min(at), o.list(at)
        span = o.max(at) - first
        weight = lambda t: F.when(span > 0, F.try_divide((t - first).cast("double"), span.cast("double")) + 0.001).otherwise(1.0)
        total = lambda held: F.aggregate(held, F.lit(0.0), lambda acc, h: acc + h)
        return F.try_divide(total(F.zip_with(times, o.list(v), lambda t, y: weight(t) * y)), total(F.transform(times, weight)))

    return _frame(x, w, t)


class Ema(Kernel):
    """alpha = 2/(n+1), seeded by the mean of the first n values; absent until then."""

    def __init__(self, n: int, a: float | None = None):
        self.n, self.a, self.seen, self.total, self.value = n, 2.0 / (n + 1) if a is None else a, 0, 0.0, None

    def next(self, v: float) -> float | None:
        if self.value is not None:
            self.value += self.a * (v - self.value)
        else:
            self.seen += 1
            self.total += v
            if self.seen == self.n:
                self.value = self.total / self.n
        return self.value

    def step(self, ts, v):
        out = self.next(v)
        return (None, A.WARMING_UP) if out is None or not math.isfinite(out) else (out, None)


class TimeEma(Kernel):
    """Weight 1 - exp(-dt/length) for the new value; the first seeds, and no time passed changes nothing."""

    def __init__(self, length: int):
        self.length, self.ts, self.value = length, None, None

    def step(self, ts, v):
        if self.value is None:
            self.value = v
        elif ts > self.ts:
            self.value += (1.0 - math.exp(-(ts - self.ts) / self.length) if self.length else 1.0) * (v - self.value)
        self.ts = ts
        return (self.value, None) if math.isfinite(self.value) else (None, A.WARMING_UP)


def ema(x: Series, window) -> Series:
    w = sliding(window)
    return x.kernel(lambda: Ema(w.n)) if isinstance(w, Count) else x.kernel(lambda: TimeEma(w.length))


def ema_alpha(x: Series, a: float) -> Series:
    return x.kernel(lambda: Ema(1, a))


def rsi(x: Series, window) -> Series:
    """Cutler's: mean gain and loss of the changes in the window; without losses 100, or 50 without gains too."""
    change = x.changes()

    def f(o, v):
        gain, loss = o.avg(F.greatest(v, F.lit(0.0))), o.avg(F.greatest(-v, F.lit(0.0)))
        return F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss)))

    return _frame(change, window, f)


class Wilder(Kernel):
    """Wilder's RSI: the mean of the first n changes, then smoothing by 1/n."""

    def __init__(self, n: int):
        self.n, self.prev, self.seen, self.gain, self.loss = n, None, 0, 0.0, 0.0

    def next(self, v: float) -> float | None:
        if self.prev is not None and self.n:
            d = v - self.prev
            g, loss = builtin_max(d, 0.0), builtin_max(-d, 0.0)
            if self.seen < self.n:
                self.seen += 1
                self.gain += g / self.n
                self.loss += loss / self.n
            else:
                self.gain += (g - self.gain) / self.n
                self.loss += (loss - self.loss) / self.n
        self.prev = v
        if not self.n or self.seen < self.n:
            return None
        return (50.0 if self.gain == 0 else 100.0) if self.loss == 0 else 100.0 - 100.0 / (1.0 + self.gain / self.loss)

    def step(self, ts, v):
        out = self.next(v)
        return (None, A.WARMING_UP) if out is None or not math.isfinite(out) else (out, None)


def rsi_wilder(x: Series, n: int) -> Series:
    return x.kernel(lambda: Wilder(n))


class Welford:
    """Running moments that can be added to, taken from and merged."""

    def __init__(self, n: int = 0, mean: float = 0.0, m2: float = 0.0):
        self.n, self.mean, self.m2 = n, mean, m2

    def push(self, v: float) -> None:
        self.n += 1
        d = v - self.mean
        self.mean += d / self.n
        self.m2 += d * (v - self.mean)

    def remove(self, v: float) -> None:
        if self.n <= 1:
            self.__init__()
            return
        d = v - self.mean
        self.mean -= d / (self.n - 1)
        self.m2 = builtin_max(0.0, self.m2 - d * (v - self.mean))
        self.n -= 1

    def merge(self, other: Welford) -> Welford:
        n = self.n + other.n
        if not n:
            return Welford()
        d = other.mean - self.mean
        return Welford(n, self.mean + d * other.n / n, self.m2 + other.m2 + d * d * self.n * other.n / n)

    def variance(self) -> float | None:
        return self.m2 / self.n if self.n >= 2 else None

    def sample_variance(self) -> float | None:
        return self.m2 / (self.n - 1) if self.n >= 2 else None


class SlidingWelford(Kernel):
    """Variance of the last n present values by running moments: one value in, one out."""

    def __init__(self, n: int):
        self.n, self.held, self.moments = n, deque(), Welford()

    def step(self, ts, v):
        self.held.append(v)
        self.moments.push(v)
        if len(self.held) > self.n:
            self.moments.remove(self.held.popleft())
        out = self.moments.variance()
        return (None, A.WARMING_UP) if out is None else (out, None)


def builtin_max(first, *rest):
    for x in rest:
        first = first if first >= x else x
    return first


for _f in (sma, sum, count, min, max, variance, std, quantile, median, percentile, iqr, rank, skewness, kurtosis, covariance, sample_covariance, correlation, beta, alpha, wma, ema, ema_alpha, rsi, rsi_wilder):
    setattr(Series, _f.__name__, _f)
