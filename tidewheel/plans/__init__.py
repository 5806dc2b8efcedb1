"""The series graph and the planner that turns it into stages of a DataFrame plan."""

from .flow import Flow
from .series import Series
from .windows import Count, Session, Time, Tumbling, over, over_n

__all__ = ["Count", "Flow", "Series", "Session", "Time", "Tumbling", "over", "over_n"]
