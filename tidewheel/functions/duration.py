"""Durations as whole milliseconds."""

from __future__ import annotations

import re

_UNITS = {"ns": 1e-6, "us": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def dur(x: int | float | str) -> int:
    """Milliseconds of `"5s"`, `"250ms"`, `"2h"`, or of a number of ms; negative durations become 0."""
    if isinstance(x, str):
        m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)\s*([a-z]+)\s*", x)
        if not m or m[2] not in _UNITS:
            raise ValueError(f"not a duration: {x!r}")
        x = float(m[1]) * _UNITS[m[2]]
    return max(0, int(x))


def ns(n: int) -> int:
    return max(0, int(n) // 1_000_000)


def us(n: int) -> int:
    return max(0, int(n) // 1000)


def ms(n: int) -> int:
    return max(0, int(n))


def secs(n: int) -> int:
    return ms(n * 1000)


def mins(n: int) -> int:
    return ms(n * 60_000)


def hours(n: int) -> int:
    return ms(n * 3_600_000)


def days(n: int) -> int:
    return ms(n * 86_400_000)
