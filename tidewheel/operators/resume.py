"""Snapshots of kernels as a table: a run's last state by key, and runs that start from it."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..plans.series import Kernel
from .keyed import Emitter, emit

_FIRST = -(1 << 62)


class _Resumed(Emitter):
    """A row with a payload sets the state; each other row is a step; the flush tells the state."""

    def __init__(self, make: Callable[[], Kernel], fingerprint: str):
        self.kernel, self.fingerprint, self.ts = make(), fingerprint, None

    def record(self, ts, row):
        row_id, value, payload, fingerprint = row
        if payload is not None:
            if fingerprint != self.fingerprint:
                raise ValueError("the snapshot belongs to another graph")
            self.kernel.__dict__.update(pickle.loads(payload))  # noqa: S301  written by a run of this engine
            self.ts = ts
            return []
        self.ts = ts
        out = (None, "FilteredOut") if value is None else self.kernel.step(ts, value)
        return [(row_id, out[0], out[1], None, None)]

    def flush(self):
        return [(None, None, None, pickle.dumps(self.kernel.__dict__), self.ts)]


def run_resumable(df: DataFrame, key: str, ts: str, order: str, value: str, make: Callable[[], Kernel], fingerprint: str, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, order, value, absent) of a kernel over df, and the states (key, ts, fingerprint, payload) after it.

    states: those of an earlier run; they must have the same fingerprint. Keys without new rows keep their state.
    """
    types = dict(df.dtypes)
    rows = df.select(F.col(key), F.col(ts).cast("bigint").alias("t"), F.col(ts).cast("bigint").alias("at"), F.col(order).cast("bigint").alias("o"), F.col(value).cast("double").alias("v"), F.lit(None).cast("binary").alias("p"), F.lit(None).cast("string").alias("f"))
    if states is not None:
        rows = rows.union(states.select(F.col(key), F.lit(_FIRST).alias("t"), F.col("ts").alias("at"), F.lit(_FIRST).alias("o"), F.lit(None).cast("double"), F.col("payload"), F.col("fingerprint")))
    out = emit(rows, [key], ["t", "o"], "at", lambda: _Resumed(make, fingerprint), ["o", "v", "p", "f"], f"`{key}` {types[key]}, `{order}` bigint, value double, absent string, payload binary, ts bigint")
    return out.filter("payload is null").select(key, order, "value", "absent"), out.filter("payload is not null").select(key, "ts", F.lit(fingerprint).alias("fingerprint"), "payload")
