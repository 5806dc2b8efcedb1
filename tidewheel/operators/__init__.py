"""Operators of series, attached as methods of Series, and operators of whole streams."""

from . import windows, trackers, math, composites, detectors, indicators  # noqa: F401, I001
