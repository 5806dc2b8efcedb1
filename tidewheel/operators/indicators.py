"""Financial indicators: window expressions where they are algebraic, kernels where they are recurrences.

Kernels keep a bounded state and take constant time a record.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import functions as F

from ..functions import absent as A
from ..plans.series import Kernel, Series
from .composites import deviation_band, momentum, peak_decline, rate_of_change
from .windows import Ema, Wilder, _frame


def _given(v: float | None):
    return (None, A.WARMING_UP) if v is None or not math.isfinite(v) else (v, None)


class Chain(Kernel):
    """EMAs of EMAs, each seeded by the mean of its first n inputs; combine(e1, e2, ...) of them."""

    def __init__(self, n: int, depth: int, combine):
        self.emas, self.combine = [Ema(n) for _ in range(depth)], combine

    def step(self, ts, v):
        values = []
        for e in self.emas:
            v = e.next(v) if v is not None else None
            values.append(v)
        return _given(None if v is None else self.combine(*values))


class Trix(Chain):
    """Per cent change of a threefold EMA."""

    def __init__(self, n: int):
        super().__init__(n, 3, lambda a, b, c: c)
        self.before = None

    def step(self, ts, v):
        now, r = super().step(ts, v)
        before, self.before = self.before, now
        if now is None or before is None:
            return None, A.WARMING_UP
        return _given((now - before) / before * 100.0 if before else 0.0)


class Macd(Kernel):
    """line, signal or histogram, all from the first row of the signal on."""

    def __init__(self, fast: int, slow: int, signal: int, output: int):
        self.fast, self.slow, self.signal, self.output = Ema(fast), Ema(slow), Ema(signal), output

    def step(self, ts, v):
        f, s = self.fast.next(v), self.slow.next(v)
        if f is None or s is None:
            return None, A.WARMING_UP
        line = f - s
        sig = self.signal.next(line)
        return _given(None if sig is None else (line, sig, line - sig)[self.output])


class Ppo(Kernel):
    def __init__(self, fast: int, slow: int):
        self.fast, self.slow = Ema(fast), Ema(slow)

    def step(self, ts, v):
        f, s = self.fast.next(v), self.slow.next(v)
        return _given(None if f is None or s is None else (f - s) / s * 100.0 if s else 0.0)


class Smoothed(Kernel):
    """Wilder's average: the mean of the first n inputs, then 1/n of each new one."""

    def __init__(self, n: int):
        self.n, self.seen, self.value = n, 0, 0.0

    def next(self, v: float) -> float | None:
        if not self.n:
            return None
        self.seen += 1
        self.value += v / self.n if self.seen <= self.n else (v - self.value) / self.n
        return self.value if self.seen >= self.n else None

    def step(self, ts, v):
        return _given(self.next(v))


class Cmo(Kernel):
    def __init__(self, n: int):
        self.gain, self.loss, self.prev = Smoothed(n), Smoothed(n), None

    def step(self, ts, v):
        prev, self.prev = self.prev, v
        if prev is None:
            return None, A.WARMING_UP
        g, loss = self.gain.next(max(v - prev, 0.0)), self.loss.next(max(prev - v, 0.0))
        if g is None:
            return None, A.WARMING_UP
        return _given(0.0 if g + loss < 1e-15 else 100.0 * (g - loss) / (g + loss))


class Kama(Kernel):
    """Adaptive average: seeded by the n-th value, smoothing by the efficiency of the last n changes."""

    FAST, SLOW = 2.0 / 3.0, 2.0 / 31.0

    def __init__(self, n: int):
        self.n, self.held, self.changes, self.value = n, deque(), deque(), None

    def step(self, ts, v):
        if self.held:
            self.changes.append(abs(v - self.held[-1]))
        self.held.append(v)
        if len(self.held) > self.n + 1:
            self.held.popleft()
            self.changes.popleft()
        if len(self.held) == self.n and self.value is None:
            self.value = v
            return None, A.WARMING_UP
        if len(self.held) <= self.n or not self.n:
            return None, A.WARMING_UP
        moved, path = abs(v - self.held[0]), math.fsum(self.changes)
        ratio = 1.0 if path <= 0.0 else min(1.0, moved / path)
        self.value += (ratio * (self.FAST - self.SLOW) + self.SLOW) ** 2 * (v - self.value)
        return _given(self.value)


class Directional(Kernel):
    """Wilder's directional movement: `plus`, `minus` (from row n) or `adx` (from row 2n-1)."""

    TINY = 1e-14

    def __init__(self, n: int, output: str):
        self.n, self.output, self.row, self.last = n, output, 0, None
        self.plus = self.minus = self.span = 0.0
        self.di = {"plus": 0.0, "minus": 0.0}
        self.total = 0.0
        self.adx = None

    def step(self, ts, close, high, low):
        last, self.last, row = self.last, (high, low, close), self.row
        self.row += 1
        if last is None or self.n < (2 if self.output == "adx" else 1):
            return None, A.WARMING_UP
        up, down = high - last[0], last[1] - low
        seeded = row >= self.n
        if seeded:
            for name in ("plus", "minus", "span"):
                setattr(self, name, getattr(self, name) * (1.0 - 1.0 / self.n))
        self.minus += down if down > 0 and up < down else 0.0
        self.plus += up if up > 0 and up > down else 0.0
        self.span += max(high - low, abs(high - last[2]), abs(low - last[2]))
        if not seeded:
            return None, A.WARMING_UP
        dx = None
        if abs(self.span) > self.TINY:
            self.di = {"plus": 100.0 * self.plus / self.span, "minus": 100.0 * self.minus / self.span}
            both = self.di["plus"] + self.di["minus"]
            if abs(both) > self.TINY:
                dx = 100.0 * abs(self.di["minus"] - self.di["plus"]) / both
        if self.output != "adx":
            return _given(self.di[self.output])
        if row < 2 * self.n:
            self.total += dx or 0.0
            if row < 2 * self.n - 1:
                return None, A.WARMING_UP
            self.adx = self.total / self.n
        elif dx is not None:
            self.adx = (self.adx * (self.n - 1) + dx) / self.n
        return _given(self.adx)


class StochRsi(Kernel):
    """fastK of Wilder's RSI, or the mean of the last fastd of it."""

    def __init__(self, n: int, fastk: int, fastd: int, output: int):
        self.rsi, self.held, self.ks, self.fastk, self.fastd, self.output = Wilder(n), deque(maxlen=max(1, fastk)), deque(maxlen=max(1, fastd)), fastk, fastd, output

    def step(self, ts, v):
        r = self.rsi.next(v)
        if r is None:
            return None, A.WARMING_UP
        self.held.append(r)
        if len(self.held) < self.fastk:
            return None, A.WARMING_UP
        low, high = min(self.held), max(self.held)
        self.ks.append((r - low) / (high - low) * 100.0 if high > low else 0.0)
        if self.output == 0:
            return _given(self.ks[-1])
        return _given(sum(self.ks) / self.fastd if len(self.ks) == self.fastd else None)


bollinger_bands, drawdown, mom_n, roc_n = deviation_band, peak_decline, momentum, rate_of_change


def macd_n(x: Series, fast: int, slow: int, signal: int) -> tuple[Series, Series, Series]:
    return tuple(x.kernel(lambda o=o: Macd(fast, slow, signal, o)) for o in range(3))


def stochastic_k(x: Series, window) -> Series:
    low, high = x.min(window), x.max(window)
    return (x - low) / (high - low) * 100.0


def stochastic_n(x: Series, k: int, d: int) -> tuple[Series, Series]:
    fast = stochastic_k(x, k)
    return fast, fast.sma(d)


def stochastic_ohlc_n(close: Series, high: Series, low: Series, k: int, d: int) -> tuple[Series, Series]:
    bottom = low.min(k)
    slow_k = ((close - bottom) / (high.max(k) - bottom) * 100.0).sma(d)
    return slow_k, slow_k.sma(d)


def williams_r_n(x: Series, n: int) -> Series:
    top = x.max(n)
    return (top - x) / (top - x.min(n)) * -100.0


def williams_r_ohlc_n(close: Series, high: Series, low: Series, n: int) -> Series:
    top = high.max(n)
    return (top - close) / (top - low.min(n)) * -100.0


def cci_n(x: Series, n: int) -> Series:
    def f(o, v):
        held = o.list(v)
        mean = F.aggregate(held, F.lit(0.0), lambda a, y: a + y) / n
        dev = F.aggregate(held, F.lit(0.0), lambda a, y: a + F.abs(y - mean)) / n
        return F.when(F.size(held) == n, F.when(dev == 0, 0.0).otherwise(F.try_divide(v - mean, 0.015 * dev)))

    return _frame(x, n, f)


def true_range(close: Series, high: Series, low: Series) -> Series:
    before = close.prev()
    return high.expr(lambda h, lo, p: F.greatest(*[A.no_nan(c) for c in (h - lo, F.abs(h - p), F.abs(lo - p))]), low, before)


def atr_n(close: Series, high: Series, low: Series, n: int) -> Series:
    return true_range(close, high, low).ema(n)


def atr_wilder_n(close: Series, high: Series, low: Series, n: int) -> Series:
    return true_range(close, high, low).kernel(lambda: Smoothed(n))


def trima(x: Series, n: int) -> Series:
    """Triangular weights 1, 2, ... up to the middle and down again, over the last n."""
    weights = [float(min(i + 1, n - i)) for i in range(n)]

    def f(o, v):
        held = o.list(v)
        total = F.aggregate(F.zip_with(held, F.array(*map(F.lit, weights)), lambda a, w: a * w), F.lit(0.0), lambda a, y: a + F.coalesce(y, F.lit(0.0)))
        return F.when(F.size(held) == n, total / math.fsum(weights))

    return _frame(x, n, f)


def dema_n(x: Series, n: int) -> Series:
    return x.kernel(lambda: Chain(n, 2, lambda a, b: 2 * a - b))


def tema_n(x: Series, n: int) -> Series:
    return x.kernel(lambda: Chain(n, 3, lambda a, b, c: 3 * a - 3 * b + c))


def trix_n(x: Series, n: int) -> Series:
    return x.kernel(lambda: Trix(n))


def typical_price(close: Series, high: Series, low: Series) -> Series:
    return (high + low + close) / 3.0


def vwap(price: Series, volume: Series) -> Series:
    """Cumulative; never resets."""
    return (price * volume).cumsum() / volume.cumsum()


def obv(close: Series, volume: Series) -> Series:
    def signed(env, c, v):
        before = F.lag(c).over(env.rows) if not close.nullable else F.last(c, ignorenulls=True).over(env.before())
        return F.when(before.isNull() | (c > before), v).when(c < before, -v).otherwise(0.0)

    return close.window(signed, volume).cumsum()


def mfi_n(tp: Series, volume: Series, n: int) -> Series:
    change = tp.changes()
    flow = tp * volume
    up, down = (change.expr(lambda d, f, s=s: F.when(d * s > 0, f).otherwise(0.0), flow) for s in (1, -1))

    def f(o, a, b):
        pos, neg = o.sum(a), o.sum(b)
        out = F.when(neg == 0, F.when(pos == 0, 50.0).otherwise(100.0)).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(pos, neg)))
        return F.when(o.count(a) >= n, out)

    return _frame(up, n, f, down)


def adx_n(close: Series, high: Series, low: Series, n: int) -> Series:
    return close.kernel(lambda: Directional(n, "adx"), high, low)


def plus_di_n(close: Series, high: Series, low: Series, n: int) -> Series:
    return close.kernel(lambda: Directional(n, "plus"), high, low)


def minus_di_n(close: Series, high: Series, low: Series, n: int) -> Series:
    return close.kernel(lambda: Directional(n, "minus"), high, low)


def kama_n(x: Series, n: int) -> Series:
    return x.kernel(lambda: Kama(n))


def cmo_n(x: Series, n: int) -> Series:
    return x.kernel(lambda: Cmo(n))


def linearreg_slope_n(x: Series, n: int) -> Series:
    """Slope over 0..n-1 of the last n values."""
    middle = (n - 1) / 2.0
    spread = n * (n * n - 1) / 12.0

    def f(o, v):
        held = o.list(v)
        total = F.aggregate(F.transform(held, lambda y, i: y * (i - middle)), F.lit(0.0), lambda a, y: a + y)
        return F.when(F.size(held) == n, total / spread if spread else F.lit(0.0))

    return _frame(x, n, f)


def ppo_n(x: Series, fast: int, slow: int) -> Series:
    return x.kernel(lambda: Ppo(fast, slow))


def stochrsi_n(x: Series, rsi: int, fastk: int, fastd: int) -> tuple[Series, Series]:
    return tuple(x.kernel(lambda o=o: StochRsi(rsi, fastk, fastd, o)) for o in range(2))


for _n in ("bollinger_bands", "drawdown", "mom_n", "roc_n", "macd_n", "stochastic_k", "stochastic_n", "stochastic_ohlc_n", "williams_r_n", "williams_r_ohlc_n", "cci_n", "true_range", "atr_n", "atr_wilder_n", "trima", "dema_n", "tema_n", "trix_n", "typical_price", "vwap", "obv", "mfi_n", "adx_n", "plus_di_n", "minus_di_n", "kama_n", "cmo_n", "linearreg_slope_n", "ppo_n", "stochrsi_n"):
    setattr(Series, _n, globals()[_n])
