"""Line protocol: as a Column for whole tables, and a batcher for writers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MAX_BYTES = 16 * 1024 * 1024


def _escape(c: Column, characters: str) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\")) if "\\" in characters else c
    for ch in characters.replace("\\", ""):
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def _field(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        v = F.concat(c.cast("string"), F.lit("i"))
    elif kind in ("double", "float"):
        v = F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c.cast("string"))
    elif kind == "boolean":
        v = F.when(c, F.lit("true")).otherwise(F.lit("false"))
    else:
        v = F.concat(F.lit('"'), _escape(c.cast("string"), '"\\'), F.lit('"'))
    return F.when(c.isNotNull(), F.concat(_escape(F.lit(name), ",= "), F.lit("="), v))


def line_protocol(df: DataFrame, measurement: Column | str, tags: list[str], fields: list[str], ts_ns: Column) -> Column:
    """measurement,tag=… field=… ts: tags by name, absent ones left out; null where no field is left."""
    if not fields:
        raise ValueError("a point needs a field")
    types = dict(df.dtypes)
    m = F.lit(measurement) if isinstance(measurement, str) else measurement
    tagged = [F.when(F.col(f"`{t}`").isNotNull() & (F.col(f"`{t}`").cast("string") != ""), F.concat(F.lit(","), _escape(F.lit(t), ",= "), F.lit("="), _escape(F.col(f"`{t}`").cast("string"), ",= "))) for t in sorted(tags)]
    held = F.concat_ws(",", *[_field(f, types[f]) for f in fields])
    return F.when(held != "", F.concat(_escape(m, ", "), *[F.coalesce(t, F.lit("")) for t in tagged], F.lit(" "), held, F.lit(" "), ts_ns.cast("bigint").cast("string")))


class Batcher:
    """Gathers lines and hands them over by count, bytes or age; beyond the hard bound the oldest lines are dropped."""

    def __init__(self, send: Callable[[str], None], max_lines: int = 5000, max_bytes: int = 1 << 20, max_age_s: float = 1.0, hard_bytes: int = MAX_BYTES, clock: Callable[[], float] = time.monotonic):
        self.send, self.max_lines, self.max_bytes, self.max_age, self.hard, self.clock = send, max_lines, max_bytes, max_age_s, hard_bytes, clock
        self.lines: list[str] = []
        self.bytes, self.since, self.dropped = 0, None, 0

    def push(self, line: str) -> None:
        size = len(line.encode()) + 1
        if size > self.hard:
            self.dropped += 1
            return
        while self.lines and self.bytes + size > self.hard:
            self.bytes -= len(self.lines.pop(0).encode()) + 1
            self.dropped += 1
        self.lines.append(line)
        self.bytes += size
        self.since = self.clock() if self.since is None else self.since
        if len(self.lines) >= self.max_lines or self.bytes >= self.max_bytes:
            self.flush()

    def tick(self) -> None:
        if self.since is not None and self.clock() - self.since >= self.max_age:
            self.flush()

    def flush(self) -> None:
        """A failed send keeps the lines for the next try."""
        if self.lines:
            self.send("\n".join(self.lines) + "\n")
            self.lines, self.bytes, self.since = [], 0, None


def write_lines(lines: DataFrame, make_send: Callable[[], Callable[[str], None]], **options) -> None:
    """Sends a column `line` from the executors, a batcher for each partition; use within foreachBatch for streams."""

    def run(rows) -> None:
        b = Batcher(make_send(), **options)
        for r in rows:
            if r["line"] is not None:
                b.push(r["line"])
        b.flush()

    lines.select("line").foreachPartition(run)
