"""Counts of what passes through a plan, without a pass of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, ts: str, name: str = "records") -> tuple[DataFrame, Observation]:
    """df, and an observation with `records`, `first` and `last` that is there once df has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records"), F.min(ts).alias("first"), F.max(ts).alias("last")), seen


class ProgressListener(StreamingQueryListener):
    """Hands each micro-batch's input rows, rows a second and watermark to a function."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"started": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "watermark": p.eventTime.get("watermark") if p.eventTime else None})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"ended": str(event.id), "error": event.exception})
