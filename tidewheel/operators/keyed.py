"""Keyed streams as tables: out-of-order policies, emit-windows, validation, pulses with time-outs.

What needs the order of arrival is given an arrival column. Emitters run in mapInArrow over rows partitioned by
key and sorted by arrival, one state per key at a time, so no key is gathered in memory beyond what its own
state holds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_LATENESS = 24 * 3_600_000


class StreamError(Exception):
    """An error of a stream; permanent unless its kind says otherwise."""

    kind = "Permanent"

    @property
    def retriable(self) -> bool:
        return self.kind == "Retriable"


class Unavailable(StreamError):
    """A store or broker that may answer later: the same call may be tried again."""

    kind = "Retriable"


class InvalidInput(StreamError):
    """A record that breaks the order or a bound."""


class NonMonotonicWatermark(StreamError):
    """A watermark that was set back."""


class ConfigurationError(StreamError, ValueError):
    """Parameters that make no sense."""


def try_new(kind: Callable, *args, **named) -> tuple[object | None, ConfigurationError | None]:
    """(what kind(...) makes, None), or (None, the error) where its parameters make no sense."""
    try:
        return kind(*args, **named), None
    except ValueError as e:
        return None, e if isinstance(e, ConfigurationError) else ConfigurationError(str(e))


class Emitter:
    """Per key: records in, rows out."""

    def record(self, ts: int, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def flush(self) -> list[tuple]:
        return []


def emit(df: DataFrame, keys: list[str], sort: list[str], ts: str, make: Callable[[], Emitter], inputs: list[str], schema: str) -> DataFrame:
    """Runs an Emitter over each key's rows in the order of `sort`; rows are the tuples of `inputs`; a flush ends each key."""
    narrow = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(ts).cast("bigint").alias("__ts"), *[F.col(s).alias(f"__s{i}") for i, s in enumerate(sort)], *[F.col(c).alias(f"__i{i}") for i, c in enumerate(inputs)])
    by = [f"__k{i}" for i in range(len(keys))]
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    placed = (narrow.repartition(*by) if by else narrow.coalesce(1)).sortWithinPartitions(*by, *[f"__s{i}" for i in range(len(sort))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = object(), None, []

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            first = len(keys) + 1 + len(sort)
            for row in zip(*columns, strict=True):
                k = row[: len(keys)]
                if k != current:
                    if state is not None:
                        out += [(*current, *r) for r in state.flush()]
                    current, state = k, make()
                out += [(*k, *r) for r in state.record(row[len(keys)], row[first:])]
            if out:
                yield ready()
                out.clear()
        if state is not None:
            out += [(*current, *r) for r in state.flush()]
            if out:
                yield ready()

    return placed.mapInArrow(run, schema)


@dataclass(frozen=True)
class Error:
    """A record older than the last one is an error."""


@dataclass(frozen=True)
class Drop:
    """A record older than the last one goes to the late output."""


@dataclass(frozen=True)
class Buffer:
    """Records wait until the newest is `lateness` ahead; late is only what comes behind the last released one."""

    lateness: int

    def __post_init__(self):
        if not 0 <= self.lateness <= MAX_LATENESS:
            raise ConfigurationError("lateness must be within 0 and 24 h")


class ReorderBuffer:
    """Releases records in (ts, arrival) order, `lateness` behind the newest."""

    def __init__(self, lateness: int):
        self.lateness = min(max(0, lateness), MAX_LATENESS)
        self.heap: list[tuple[int, int, object]] = []
        self.late: list[tuple[int, object]] = []
        self.newest = self.released = None
        self.arrivals = 0
        self.clock = None

    def drain(self, until: int) -> list[tuple[int, object]]:
        out = []
        while self.heap and self.heap[0][0] <= until:
            ts, _, e = heapq.heappop(self.heap)
            self.released = ts
            out.append((ts, e))
        return out

    def step(self, ts: int, e: object) -> list[tuple[int, object]]:
        if self.released is not None and ts < self.released:
            self.late.append((ts, e))
            return []
        heapq.heappush(self.heap, (ts, self.arrivals, e))
        self.arrivals += 1
        self.newest = ts if self.newest is None else max(self.newest, ts)
        return self.drain(self.newest - self.lateness)

    def advance_watermark(self, ts: int) -> list[tuple[int, object]]:
        if self.clock is not None and ts < self.clock:
            raise NonMonotonicWatermark(f"{ts} is before {self.clock}")
        self.clock = ts
        return self.drain(ts)

    def next_release_ts(self) -> int | None:
        return self.heap[0][0] + self.lateness if self.heap else None

    def take_late(self) -> list[tuple[int, object]]:
        out, self.late = self.late, []
        return out

    def flush(self) -> list[tuple[int, object]]:
        return self.drain(math.inf)


class _Reorder(Emitter):
    def __init__(self, lateness: int):
        self.buffer, self.n = ReorderBuffer(lateness), 0

    def _rows(self, released: list) -> list[tuple]:
        out = []
        for _, row in released:
            out.append((*row, self.n, False))
            self.n += 1
        return out + [(*row, None, True) for _, row in self.buffer.take_late()]

    def record(self, ts, row):
        return self._rows(self.buffer.step(ts, row))

    def flush(self):
        return self._rows(self.buffer.flush())


def ordered(df: DataFrame, key: str, ts: str, arrival: str, policy: Error | Drop | Buffer, carry: list[str] | None = None) -> DataFrame:
    """The rows with `seq` (their place in the key's output) and `late`; with Error also `error`.

    Drop and Error have closed forms: a row is late iff an earlier arrival of its key has a greater time.
    """
    if isinstance(policy, Buffer):
        columns = carry or [c for c in df.columns if c != key]
        types = dict(df.dtypes)
        schema = ", ".join([f"`{key}` {types[key]}", *[f"`{c}` {types[c]}" for c in columns], "seq bigint", "late boolean"])
        return emit(df, [key], [arrival], ts, lambda: _Reorder(policy.lateness), columns, schema)
    w = Window.partitionBy(key).orderBy(arrival)
    late = F.coalesce(F.col(ts) < F.max(ts).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    out = df.withColumn("late", late)
    out = out.withColumn("seq", F.when(~F.col("late"), F.sum(F.when(~F.col("late"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint"))
    if isinstance(policy, Error):
        out = out.withColumn("error", F.when(F.col("late"), F.lit("InvalidInput: out of order")))
    return out


def late_records(df: DataFrame, key: str, ts: str, arrival: str, policy: Drop | Buffer) -> DataFrame:
    """The late output: key, ts and the record's columns."""
    return ordered(df, key, ts, arrival, policy).filter("late").drop("late", "seq")


def session_aggregate(df: DataFrame, key: str, ts: str, order: str, gap: int, **aggregates: Column) -> DataFrame:
    """A row for each session: key, start, end, emit_ts and the aggregates. A session closes when `gap` has passed, so a row exactly `gap` later opens a new one."""
    w = Window.partitionBy(key).orderBy(ts, order)
    opened = df.withColumn("__open", F.coalesce((F.col(ts) - F.lag(ts).over(w) >= gap).cast("int"), F.lit(1)))
    numbered = opened.withColumn("__session", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "__session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), *[a.alias(n) for n, a in aggregates.items()])
    return out.select(key, "start", "end", (F.col("end") + gap).alias("emit_ts"), *aggregates)


def session_sum(df: DataFrame, key: str, ts: str, order: str, value: str, gap: int) -> DataFrame:
    return session_aggregate(df, key, ts, order, gap, sum=F.sum(value)).select(key, "emit_ts", "sum")


def tumbling_aggregate(df: DataFrame, key: str, ts: str, size: int, **aggregates: Column) -> DataFrame:
    """A row for each key and window that has rows; the bucket is ts/size cut towards zero."""
    if size < 1:
        raise ConfigurationError("tumbling size must be at least 1 ms")
    bucket = F.call_function("div", F.col(ts), F.lit(size))
    out = df.groupBy(key, bucket.alias("__bucket")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(key, (F.col("__bucket") * size).alias("window_start"), ((F.col("__bucket") + 1) * size).alias("window_end"), *aggregates)


def tumbling_sum(df: DataFrame, key: str, ts: str, value: str, size: int) -> DataFrame:
    return tumbling_aggregate(df, key, ts, size, sum=F.sum(value)).select(key, F.col("window_end").alias("emit_ts"), "sum")


def tumbling_sum_count(df: DataFrame, key: str, ts: str, arrival: str, value: str, size: int, allowed_lateness: int) -> DataFrame:
    """Count and sum of what the reorder buffer accepts."""
    kept = ordered(df, key, ts, arrival, Buffer(allowed_lateness), [ts, value]).filter(~F.col("late"))
    return tumbling_aggregate(kept, key, ts, size, count=F.count("*"), sum=F.sum(value))


class _TimedPulse(Emitter):
    """Pulses with a time-out: too long a pulse is told when max has passed, and the level counts as low from then."""

    def __init__(self, threshold: float, low: int, high: int):
        self.threshold, self.low, self.high, self.start = threshold, low, high, None

    def _expire(self, now: float) -> list[tuple]:
        if self.start is None or now < self.start + self.high + 1:
            return []
        at, self.start = self.start + self.high + 1, None
        return [(at, "TooLong", self.high)]

    def record(self, ts, row):
        out = self._expire(ts)
        up = row[0] is not None and row[0] >= self.threshold
        if row[0] is None:
            return out
        if up and self.start is None:
            self.start = ts
        elif not up and self.start is not None:
            width, self.start = ts - self.start, None
            out.append((ts, "TooShort" if width < self.low else "Valid", width))
        return out

    def flush(self):
        return self._expire(math.inf)


def pulse_width_keyed(df: DataFrame, key: str, ts: str, order: str, value: str, threshold: float, min_ms: int, max_ms: int) -> DataFrame:
    """key, emit_ts, mode, width_ms: a row for each pulse's end or time-out (at start + max + 1)."""
    if min_ms > max_ms:
        raise ConfigurationError("min is above max")
    return emit(df, [key], [ts, order], ts, lambda: _TimedPulse(threshold, min_ms, max_ms), [value], f"`{key}` {dict(df.dtypes)[key]}, emit_ts bigint, mode string, width_ms bigint")


@dataclass(frozen=True)
class ValidationOptions:
    assert_sorted: bool = False
    min_warmup: int = 1
    max_gap_ms: int | None = None
    reject_nan: bool = False
    reject_inf: bool = False
    error_on_nan: bool = False
    error_on_inf: bool = False
    error_on_negative: bool = False


class _Validate(Emitter):
    def __init__(self, o: ValidationOptions):
        self.o, self.last, self.n = o, None, 0

    def record(self, ts, row):
        o, (rid, v) = self.o, row
        if o.assert_sorted and self.last is not None and ts < self.last:
            return [(rid, "error", "not sorted")]
        if o.max_gap_ms is not None and self.last is not None and ts - self.last > o.max_gap_ms:
            return [(rid, "error", "gap")]
        self.last = ts
        if v is not None and math.isnan(v):
            if o.error_on_nan:
                return [(rid, "error", "NaN")]
            if o.reject_nan:
                return [(rid, "rejected", "NaN")]
        if v is not None and math.isinf(v):
            if o.error_on_inf:
                return [(rid, "error", "infinite")]
            if o.reject_inf:
                return [(rid, "rejected", "infinite")]
        if o.error_on_negative and v is not None and v < 0:
            return [(rid, "error", "negative")]
        self.n += 1
        return [(rid, "ok" if self.n >= o.min_warmup else "warming", None)]


def validated(df: DataFrame, key: str, ts: str, order: str, record_id: str, value: str, options: ValidationOptions) -> DataFrame:
    """key, record_id, status (ok, warming, rejected, error), problem. A sort or gap error doesn't move the last time."""
    types = dict(df.dtypes)
    return emit(df, [key], [order], ts, lambda: _Validate(options), [record_id, value], f"`{key}` {types[key]}, `{record_id}` {types[record_id]}, status string, problem string")


def tried(value: Column, check: Column, message: str) -> Column:
    """struct(value, error): the value where the check holds, else the message."""
    return F.struct(F.when(check, value).alias("value"), F.when(~F.coalesce(check, F.lit(False)), F.lit(message)).alias("error"))


def attempt(make: Callable[[], object], tries: int = 1, wait: Callable[[int], None] = lambda n: None) -> tuple[object, Exception | None]:
    """(result, None), or (None, error): what a constructor or call gives, without raising. Retriable errors are tried again."""
    for n in range(1, max(1, tries) + 1):
        try:
            return make(), None
        except StreamError as e:
            if not e.retriable or n >= tries:
                return None, e
            wait(n)
        except (ValueError, TypeError) as e:
            return None, e
    return None, None


def require_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def require_positive(c: Column) -> Column:
    return require_finite(c) & (c > 0)


def require_non_negative(c: Column) -> Column:
    return require_finite(c) & (c >= 0)


def require_in_range(c: Column, low: float, high: float) -> Column:
    return require_finite(c) & (c >= low) & (c <= high)


class Timers:
    """Event-time timers, fired in the order of (time, registration); due when the time is at or before the watermark."""

    def __init__(self):
        self.heap: list[tuple[int, int, object]] = []
        self.live: set[tuple[int, object]] = set()
        self.n, self.watermark = 0, None

    def register(self, ts: int, node: object = None) -> None:
        if (ts, node) not in self.live:
            self.live.add((ts, node))
            heapq.heappush(self.heap, (ts, self.n, node))
            self.n += 1

    def delete(self, ts: int, node: object = None) -> None:
        self.live.discard((ts, node))

    def advance(self, ts: float) -> list[tuple[int, object]]:
        if self.watermark is not None and ts < self.watermark:
            raise NonMonotonicWatermark(f"{ts} is before {self.watermark}")
        self.watermark, out = ts, []
        while self.heap and self.heap[0][0] <= ts:
            at, _, node = heapq.heappop(self.heap)
            if (at, node) in self.live:
                self.live.discard((at, node))
                out.append((at, node))
        return out
