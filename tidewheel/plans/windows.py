"""Window descriptions: sliding ones (Time, Count) and ones that emit on a trigger (Session, Tumbling)."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.duration import dur


@dataclass(frozen=True)
class Time:
    """The last `length`, both ends included."""

    length: int

    def __init__(self, length: int | str):
        object.__setattr__(self, "length", dur(length))


@dataclass(frozen=True)
class Count:
    """The last n present values; 0 counts as 1."""

    n: int

    def __init__(self, n: int):
        object.__setattr__(self, "n", max(1, int(n)))


@dataclass(frozen=True)
class Session:
    gap: int

    def __init__(self, gap: int | str):
        object.__setattr__(self, "gap", dur(gap))


@dataclass(frozen=True)
class Tumbling:
    size: int

    def __init__(self, size: int | str):
        object.__setattr__(self, "size", dur(size))


Sliding = Time | Count


def sliding(w) -> Sliding:
    if isinstance(w, int):
        return Count(w)
    if isinstance(w, str):
        return Time(w)
    if not isinstance(w, (Time, Count)):
        raise ValueError(f"{type(w).__name__} emits on a trigger; a sliding window is needed here")
    return w


def over(length: int | str) -> Time:
    return Time(length)


def over_n(n: int) -> Count:
    return Count(n)
