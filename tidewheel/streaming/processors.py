"""Processors for transformWithStateInPandas.

Out-of-order rows are handled per key, as in the tables: rows wait in a reorder buffer in the state, and are late
only behind the key's last released row. Spark's own watermark is global; give it a generous delay (a day is the
buffer's bound) so that it only drives timers and bounds state, and doesn't drop what a key would accept.
Records fire what is due before them; event-time timers fire it when no records come. What is still waiting when a
stream stops stays in the state; only a table has an end.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import cel
from ..operators.keyed import ReorderBuffer
from ..plans.pattern import Matcher, Pattern
from ..plans.series import Kernel

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _Held(StatefulProcessor):
    """Keeps one Python object for each key; subclasses say how it starts and what rows do to it."""

    names: list[str] = []

    def start(self):
        raise NotImplementedError

    def rows(self, held, batch: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def due(self, held, now: int) -> list[tuple]:
        return []

    def next_timer(self, held) -> int | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "payload binary")

    def _load(self):
        return pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()  # noqa: S301  the query's own checkpoint

    def _save(self, held, watermark: int) -> None:
        self.state.update((pickle.dumps(held),))
        at = self.next_timer(held)
        if at is not None and at > watermark:
            if at not in set(self.handle.listTimers()):
                self.handle.registerTimer(at)

    def _frame(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        for batch in rows:
            out += self.rows(held, batch)
        self._save(held, timerValues.getCurrentWatermarkInMs())
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load()
        out = self.due(held, expiredTimerInfo.getExpiryTimeInMs())
        self._save(held, timerValues.getCurrentWatermarkInMs())
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


class _Series(_Held):
    def __init__(self, names: list[str], values: list[str], kernels: list[tuple[Callable[[], Kernel], list[int]]], lateness: int):
        self.names, self.values, self.kernels, self.lateness = names, values, kernels, lateness

    def start(self):
        return ReorderBuffer(self.lateness), [make() for make, _ in self.kernels]

    def _step(self, kernels: list, released: list) -> list[tuple]:
        out = []
        for ts, row in released:
            got = []
            for (_, at), k in zip(self.kernels, kernels, strict=True):
                values = [row[1 + a] for a in at]
                got.append(k.absent("FilteredOut") if any(v is None or v != v for v in values) else k.step(ts, *values)[0])
            out.append((ts, row[0], *got, False))
        return out

    def due(self, held, now):
        buffer, kernels = held
        return self._step(kernels, buffer.drain(now - self.lateness))

    def next_timer(self, held):
        return held[0].heap[0][0] + self.lateness if held[0].heap else None

    def rows(self, held, batch):
        buffer, kernels = held
        out = []
        for ts, *row in batch.sort_values(["tw_ts", "tw_order"], kind="stable")[["tw_ts", "tw_order", *self.values]].itertuples(index=False, name=None):
            out += self._step(kernels, buffer.step(ts, tuple(row)))
        return out + [(ts, row[0], *[None] * len(self.kernels), True) for ts, row in buffer.take_late()]


def stream_series(df: DataFrame, key: str, event_time: str, order: str, values: list[str], outputs: dict[str, tuple[Callable[[], Kernel], list[str]]], lateness: int = 0, delay: str = "1 day") -> DataFrame:
    """key, ts, order, the outputs of kernels over a stream, and late; outputs: name to (kernel factory, its columns of `values`).

    Late rows come out without outputs. Rows that wait are released by newer ones, or by the watermark.
    """
    marked = df.withWatermark(event_time, delay)
    lean = marked.select(F.col(key), F.unix_millis(event_time).alias("tw_ts"), F.col(order).cast("bigint").alias("tw_order"), *[F.col(v).cast("double").alias(v) for v in values], F.col(event_time))
    kind = dict(df.dtypes)[key]
    names = [key, "ts", order, *outputs, "late"]
    kernels = [(make, [values.index(c) for c in columns]) for make, columns in outputs.values()]
    schema = ", ".join([f"`{key}` {kind}", "ts bigint", f"`{order}` bigint", *[f"`{n}` double" for n in outputs], "late boolean"])
    return lean.groupBy(key).transformWithStateInPandas(_Series(names, values, kernels, lateness), schema, "Append", "EventTime")


class _Session(_Held):
    def __init__(self, names: list[str], gap: int):
        self.names, self.gap = names, gap

    def start(self):
        return {"last": None, "sum": 0.0, "closed": None}

    def due(self, held, now):
        if held["last"] is None or now < held["last"] + self.gap:
            return []
        at = held["last"] + self.gap
        out = [(at, held["sum"], False)]
        held.update(last=None, sum=0.0, closed=at)
        return out

    def next_timer(self, held):
        return None if held["last"] is None else held["last"] + self.gap

    def rows(self, held, batch):
        out = []
        for ts, _, v, *_ in batch.sort_values(["tw_ts", "tw_order"], kind="stable")[["tw_ts", "tw_order", "tw_v"]].itertuples(index=False, name=None):
            out += self.due(held, ts)
            if held["closed"] is not None and ts < held["closed"]:
                out.append((ts, v, True))
                continue
            held["last"] = ts if held["last"] is None else max(held["last"], ts)
            held["sum"] += v
        return out


def stream_session_sum(df: DataFrame, key: str, event_time: str, order: str, value: str, gap: int, delay: str = "1 day") -> DataFrame:
    """key, emit_ts, sum, late: a session closes when a record or the watermark is `gap` past its last row.

    A row before the end of a session that has come out is late: it comes out by itself, with its time and value.
    """
    lean = df.withWatermark(event_time, delay).select(F.col(key), F.unix_millis(event_time).alias("tw_ts"), F.col(order).cast("bigint").alias("tw_order"), F.col(value).cast("double").alias("tw_v"), F.col(event_time))
    schema = f"`{key}` {dict(df.dtypes)[key]}, emit_ts bigint, sum double, late boolean"
    return lean.groupBy(key).transformWithStateInPandas(_Session([key, "emit_ts", "sum", "late"], gap), schema, "Append", "EventTime")


def stream_tumbling_sum(df: DataFrame, key: str, event_time: str, value: str, size: str, delay: str) -> DataFrame:
    """key, emit_ts, sum, by Spark's own windows."""
    out = df.withWatermark(event_time, delay).groupBy(key, F.window(event_time, size).alias("w")).agg(F.sum(value).alias("sum"))
    return out.select(key, F.unix_millis(F.col("w")["end"]).alias("emit_ts"), "sum")


class _Match(_Held):
    def __init__(self, names: list[str], steps, slots: dict, most: int | None):
        self.names, self.steps, self.slots, self.most = names, steps, slots, most

    def start(self):
        return {"live": [], "dropped": {"MaxInFlight": 0, "Deadline": 0, "Late": 0}, "ts": None}

    def _matcher(self, held) -> Matcher:
        m = Matcher(self.steps, lambda step, slot, event, captures: bool(event[1][self.slots[(step, slot)]]), self.most)
        m.live, m.dropped, m.ts = held["live"], held["dropped"], held["ts"]
        return m

    def _done(self, held, m: Matcher, done: list) -> list[tuple]:
        held.update(live=m.live, dropped=m.dropped, ts=m.ts)
        return [(at, [self.steps[c[0]].name for c in captures], [c[2][0] for c in captures], [c[1] for c in captures]) for at, captures in done]

    def rows(self, held, batch):
        m, done = self._matcher(held), []
        for ts, order, flags in batch.sort_values(["tw_ts", "tw_order"], kind="stable")[["tw_ts", "tw_order", "tw_flags"]].itertuples(index=False, name=None):
            done += m.push(ts, (order, list(flags)))
        return self._done(held, m, done)

    def due(self, held, now):
        m = self._matcher(held)
        return self._done(held, m, m.tick(now))

    def next_timer(self, held):
        at = min((p.deadline for p in held["live"] if p.deadline is not None), default=None)
        return None if at is None else at + 1


def stream_matches(df: DataFrame, pattern: Pattern, key: str, event_time: str, event_id: str, delay: str = "1 day", max_in_flight: int | None = None) -> DataFrame:
    """key, at, steps, events, times of matches; predicates may look at the event only. max_in_flight bounds a key's state: the oldest partial matches give way."""
    from dataclasses import replace

    p, types = pattern.check(), dict(df.dtypes)
    slots, flags = {}, []
    for i, s in enumerate(p.steps):
        for slot, pred in ((-1, s.pred), *enumerate(s.guards)):
            slots[(i, slot)] = len(flags)
            flags.append(cel.predicate(pred, types) if isinstance(pred, str) else F.coalesce(pred, F.lit(False)))
    steps = [replace(s, pred="", guards=tuple("" for _ in s.guards)) for s in p.steps]
    lean = df.withWatermark(event_time, delay).select(F.col(key), F.unix_millis(event_time).alias("tw_ts"), F.col(event_id).cast("bigint").alias("tw_order"), F.array(*flags).alias("tw_flags"), F.col(event_time))
    schema = f"`{key}` {types[key]}, at bigint, steps array<string>, events array<bigint>, times array<bigint>"
    return lean.groupBy(key).transformWithStateInPandas(_Match([key, "at", "steps", "events", "times"], steps, slots, max_in_flight), schema, "Append", "EventTime")
