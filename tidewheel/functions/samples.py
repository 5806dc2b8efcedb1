"""Detectors fed one sample at a time: update() gives a word, reset() forgets.

For callers outside of a table (a service, a stream's own state). Tables use the window forms of
operators.detectors; tests hold the two against each other. A missing sample (None or NaN) says `none` and changes
nothing.
"""

from __future__ import annotations

import math

NONE = "none"


class Sampled:
    def __init__(self):
        self.reset()

    def reset(self) -> None:
        raise NotImplementedError


def _missing(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


class CrossSampler(Sampled):
    """rising or falling where the value goes over the threshold that comes with it."""

    def reset(self):
        self.last = None

    def update(self, value: float, threshold: float) -> str:
        if _missing(value, threshold):
            return NONE
        over, self.last, before = value >= threshold, value >= threshold, self.last
        if before is None or before == over:
            return NONE
        return "rising" if over else "falling"


class HysteresisSampler(Sampled):
    """The same with a margin on both sides; the first sample sets the side silently."""

    def __init__(self, margin: float):
        self.margin = margin
        super().__init__()

    def reset(self):
        self.over = None

    def update(self, value: float, threshold: float) -> str:
        if _missing(value, threshold):
            return NONE
        if self.over is None:
            self.over = value >= threshold
            return NONE
        turned = value <= threshold - self.margin if self.over else value >= threshold + self.margin
        if turned:
            self.over = not self.over
            return "rising" if self.over else "falling"
        return NONE


class _Pulse(Sampled):
    """Follows one pulse: ended() is (width, peak) on the sample that ends it."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        super().__init__()

    def reset(self):
        self.since = self.peak = None

    def ended(self, value: float, ts: int = 0) -> tuple[int, float] | None:
        if _missing(value):
            return None
        if value >= self.threshold:
            self.since = ts if self.since is None else self.since
            self.peak = value if self.peak is None else max(self.peak, value)
            return None
        if self.since is None:
            return None
        out = ts - self.since, self.peak
        self.reset()
        return out


class GlitchSampler(_Pulse):
    """At the end of a pulse valid, or glitch if it was shorter than least_ms."""

    def __init__(self, threshold: float, least_ms: int):
        self.least = int(least_ms)
        super().__init__(threshold)

    def update(self, value: float, ts: int) -> str:
        end = self.ended(value, int(ts))
        return NONE if end is None else "valid" if end[0] >= self.least else "glitch"


class RuntSampler(_Pulse):
    """At the end of an excursion over low: valid if its peak came to high, else runt."""

    def __init__(self, low: float, high: float):
        if not low < high:
            raise ValueError("low must be below high")
        self.high = high
        super().__init__(low)

    def update(self, value: float) -> str:
        end = self.ended(value)
        return NONE if end is None else "valid" if end[1] >= self.high else "runt"


class PulseWidthSampler(_Pulse):
    """At the end of a pulse short, valid or long; both bounds are valid."""

    def __init__(self, threshold: float, least_ms: int, most_ms: int):
        if least_ms > most_ms:
            raise ValueError("the least width is above the most")
        self.least, self.most = int(least_ms), int(most_ms)
        super().__init__(threshold)

    def update(self, value: float, ts: int) -> str:
        end = self.ended(value, int(ts))
        return NONE if end is None else "short" if end[0] < self.least else "long" if end[0] > self.most else "valid"


class WindowSampler(Sampled):
    """entered, exitedLow or exitedHigh; a jump over the window and the first sample say none."""

    def __init__(self, low: float, high: float):
        if not low < high:
            raise ValueError("low must be below high")
        self.low, self.high = low, high
        super().__init__()

    def reset(self):
        self.zone = None

    def update(self, value: float) -> str:
        if _missing(value):
            return NONE
        zone = -1 if value < self.low else 1 if value > self.high else 0
        before, self.zone = self.zone, zone
        if before is None or before == zone:
            return NONE
        if zone == 0:
            return "entered"
        return NONE if before else "exitedLow" if zone < 0 else "exitedHigh"
