"""Flow: a table with keys, event time and a total order, and the planner of series over it.

Nodes get levels: an expression has the level of its inputs, a window function or a kernel one more. A level is
one projection (all its windows share the partitioning by key), and one pass of kernels if it has any. Kernels
run in mapInArrow over rows that are partitioned and sorted by key and time; state is kept for one key at a
time, so a key's rows stream through and needn't fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .series import Series

_TS = "__tw_ts"


class Shared:
    """Columns that a level's window nodes have in common: aggregates over frames, then what is made of them.

    Each is made once, however often it is used: Spark makes a window, with a column for its input, for each use.
    """

    def __init__(self):
        self.steps: tuple[dict[str, tuple[str, Column]], ...] = ({}, {})
        self.uses, self.ties = 0, False

    def once(self, c: Column, step: int = 0) -> Column:
        self.uses += 1
        made = self.steps[step]
        return F.col(made.setdefault(str(c), (f"__tw_s{step}_{len(made)}", c))[0])


@dataclass(frozen=True)
class Env:
    """What window nodes build on."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    unique_ts: bool
    shared: Shared = field(default_factory=lambda: Shared(), compare=False)

    @property
    def ts(self) -> Column:
        return F.col(_TS)

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(_TS, *self.order)

    def until_now(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, -1)

    def back(self, ms: int, until: int = 0) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(_TS).rangeBetween(-ms, until)

    def ties(self) -> WindowSpec:
        """Rows of the same time up to this one; the key's exchange serves them too."""
        self.shared.ties = True
        return Window.partitionBy(*self.keys, _TS).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)

    def within(self, block: Column, backwards: bool) -> WindowSpec:
        order = [F.col(c).desc() if backwards else F.col(c) for c in (_TS, *self.order)]
        return Window.partitionBy(*self.keys, block).orderBy(*order)

    def by(self, column: Column) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(column)


class Flow:
    """df with event time `ts` (ms as bigint, or a timestamp), `key` columns, and `order` columns that break ties.

    unit: of a numeric ts: `ms`, `s` (whole seconds) or `s_f64` (fractional seconds, cut to ms).
    unique_ts: the caller knows that a key has no equal timestamps. Time windows are then plain RANGE frames;
    else they are made of two frames, because a RANGE frame would show a row the ties that arrive after it.
    """

    def __init__(self, df: DataFrame, ts: str, key: str | list[str] | None = None, order: str | list[str] = (), unit: str = "ms", unique_ts: bool = False):
        if not ts:
            raise ValueError("a timestamp column is needed")
        self.keys = tuple([key] if isinstance(key, str) else key or ())
        self.order = tuple([order] if isinstance(order, str) else order)
        if not self.order and not unique_ts:
            raise ValueError("order columns are needed where timestamps may be equal: rows have no other order")
        kind = dict(df.dtypes)[ts]
        t = F.col(ts)
        if kind == "timestamp_ntz":  # by the wall clock, whatever the session's zone
            t = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t) / F.lit(1000))
        elif kind == "timestamp":
            t = F.unix_millis(t)
        elif unit == "s":
            t = t.cast("bigint") * 1000
        elif unit == "s_f64":
            t = (t.cast("double") * 1000).cast("bigint")
        elif unit != "ms":
            raise ValueError(f"unknown unit {unit!r}")
        #: Columns that window nodes read besides their inputs.
        self.pinned: set[str] = set()
        self.context: object = None
        self.df, self.columns, self.env = df.withColumn(_TS, t.cast("bigint")), df.columns, Env(self.keys, self.order, unique_ts)

    def with_context(self, context: object) -> Flow:
        """Sets what from_context() reads; series made before keep what they have read."""
        self.context = context
        return self

    # sources
    def prop(self, column: str | Column, required: bool = False) -> Series:
        """A series from a column. required: it holds no nulls, so windows needn't step over absent rows."""
        c = F.col(column) if isinstance(column, str) else column
        return Series(self, "expr", [], lambda: (c.cast("double"), F.lit("FilteredOut")), nullable=not required)

    def constant(self, x: float) -> Series:
        return Series(self, "expr", [], lambda: (F.lit(float(x)), F.lit(None).cast("string")), nullable=False)

    def from_context(self, f: Callable[[object], float]) -> Series:
        """A constant taken from the context."""
        return self.constant(f(self.context))

    def time(self) -> Series:
        return Series(self, "expr", [], lambda: (F.col(_TS).cast("double"), F.lit(None).cast("string")), nullable=False)

    def select_sliced(self, length: int, **outputs: Series) -> DataFrame:
        """select() with each key cut into slices of `length` ms, so that one hot key is many tasks' work.

        Every output must look back a bounded time (time windows and what is made of them); a row also goes, as
        context, to each later slice that may look back at it.
        """
        reach = max((s.reach for s in outputs.values()), default=0)
        if reach == float("inf"):
            raise ValueError("an output may depend on a key's whole past; it can't be sliced")
        if length < 1:
            raise ValueError("slices need a length")
        span = F.sequence(F.floor(F.col(_TS) / F.lit(length)), F.floor((F.col(_TS) + int(reach)) / F.lit(length)))
        whole = self.df, self.columns, self.keys, self.env
        try:
            self.df = self.df.withColumn("__tw_slice", F.explode(span))
            self.columns = [*self.columns, "__tw_slice", _TS]
            self.keys = (*self.keys, "__tw_slice")
            self.env = Env(self.keys, self.order, self.env.unique_ts)
            out = self.select(**outputs)
        finally:
            self.df, self.columns, self.keys, self.env = whole
        return out.filter(F.col("__tw_slice") == F.floor(F.col(_TS) / F.lit(length))).drop("__tw_slice", _TS)

    def describe(self, **outputs: Series) -> dict[str, int]:
        """Counts of the graph: nodes, levels, windows and kernels."""
        seen: dict[int, Series] = {}

        def visit(s: Series) -> None:
            if id(s) not in seen:
                seen[id(s)] = s
                for i in s.inputs:
                    visit(i)

        for s in outputs.values():
            visit(s)
        kinds = [s.kind for s in seen.values()]
        return {"nodes": len(kinds), "levels": max(s.level for s in seen.values()), "windows": kinds.count("window"), "kernels": kinds.count("kernel")}

    # planning
    def select(self, reasons: bool = False, keep: bool | list[str] = True, **outputs: Series) -> DataFrame:
        """The input columns (all, none or those named in keep) and a column for each output; with reasons also `<name>__absent`.

        Name the columns to keep where kernels run: what isn't kept isn't read or sent through Python.
        """
        kept = (self.columns if keep else []) if isinstance(keep, bool) else list(keep)
        if clash := set(outputs) & set(kept):
            raise ValueError(f"outputs named like columns: {', '.join(sorted(clash))}")
        nodes: list[Series] = []
        seen: set[int] = set()

        def visit(s: Series) -> None:
            if id(s) not in seen:
                seen.add(id(s))
                for i in s.inputs:
                    visit(i)
                nodes.append(s)

        for s in outputs.values():
            visit(s)
        name = {id(s): f"__tw_{n}" for n, s in enumerate(nodes)}
        built: dict[int, tuple[Column, Column]] = {}
        needed = {id(i) for s in nodes if s.kind != "expr" for i in s.inputs}
        if any(s.kind == "kernel" for s in nodes):  # what is made of input columns is made before they go
            needed |= {id(s) for s in nodes if s.level == 0}
        df = self.df
        for level in range(max((s.level for s in nodes), default=0) + 1):
            mine = [s for s in nodes if s.level == level]
            windows = [s for s in mine if s.kind == "window"]
            if windows:
                self.env = env = Env(self.keys, self.order, self.env.unique_ts)
                plain, framed = {}, {}
                for s in windows:
                    uses = env.shared.uses
                    v, r = s.build(env, *[built[id(i)] for i in s.inputs])
                    columns = framed if env.shared.uses > uses else plain
                    columns |= {name[id(s)]: v, f"{name[id(s)]}_r": r}
                if env.shared.ties and env.shared.uses:
                    # one sort for windows over times and over ties: a second one would hold the lists of the first
                    df = (df.repartition(*self.keys) if self.keys else df.repartition(1)).sortWithinPartitions(*self.keys, _TS, *self.order)
                steps = [dict(made.values()) for made in env.shared.steps]
                for columns in (plain, *steps, framed):  # plain ones first: their rows hold no lists yet
                    df = df.withColumns(columns) if columns else df
                df = df.drop(*[n for step in steps for n in step])
            kernels = [s for s in mine if s.kind == "kernel"]
            if kernels:
                lean = dict.fromkeys([*self.keys, *self.order, _TS, *kept, *sorted(self.pinned)])
                df = df.select(*[F.col(f"`{c}`") for c in lean], *[F.col(c) for c in df.columns if c.startswith("__tw_") and c not in lean])
                df = self._kernels(df, kernels, name, built)
            for s in windows + kernels:
                built[id(s)] = (F.col(name[id(s)]), F.col(f"{name[id(s)]}_r"))
            columns = {}
            for s in mine:
                if s.kind == "expr":
                    built[id(s)] = s.build(*[built[id(i)] for i in s.inputs])
                    if id(s) in needed:
                        columns |= {name[id(s)]: built[id(s)][0], f"{name[id(s)]}_r": F.when(built[id(s)][0].isNull(), built[id(s)][1])}
                        built[id(s)] = (F.col(name[id(s)]), F.col(f"{name[id(s)]}_r"))
            if columns:
                df = df.withColumns(columns)
        out = [F.col(f"`{c}`") for c in kept]
        for n, s in outputs.items():
            v, r = built[id(s)]
            out.append(v.alias(n))
            if reasons:
                out.append(F.when(v.isNull(), r).alias(f"{n}__absent"))
        return df.select(*out)

    def _kernels(self, df: DataFrame, kernels: list[Series], name: dict[int, str], built: dict) -> DataFrame:
        inputs = {id(i): i for s in kernels for i in s.inputs}
        ready = df.withColumns({f"__in_{n}": built[i][0] for n, i in enumerate(inputs)} | {f"__inr_{n}": F.coalesce(F.when(built[i][0].isNull(), built[i][1])) for n, i in enumerate(inputs)})
        at = {i: n for n, i in enumerate(inputs)}
        plan = [(s.build, [at[id(i)] for i in s.inputs]) for s in kernels]
        ready = (ready.repartition(*self.keys) if self.keys else ready.coalesce(1)).sortWithinPartitions(*self.keys, _TS, *self.order)
        columns = ready.columns
        drop = {c for c in columns if c.startswith(("__in_", "__inr_"))}
        kept = [c for c in columns if c not in drop]
        types = dict(ready.dtypes)
        schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{name[id(s)]} {s.dtype}, {name[id(s)]}_r string" for s in kernels])
        run = _kernel_pass(plan, [f"__in_{n}" for n in range(len(inputs))], [f"__inr_{n}" for n in range(len(inputs))], list(self.keys), kept, [name[id(s)] for s in kernels], [to_arrow_type(DataType.fromDDL(s.dtype)) for s in kernels])
        return ready.mapInArrow(run, schema)


def _kernel_pass(plan: list[tuple[Callable, list[int]]], values: list[str], reasons: list[str], keys: list[str], kept: list[str], names: list[str], kinds: list[pa.DataType]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), []
        for b in batches:
            rows = b.num_rows
            ts = b.column(b.schema.get_field_index(_TS)).to_pylist()
            v = [b.column(b.schema.get_field_index(n)).to_pylist() for n in values]
            r = [b.column(b.schema.get_field_index(n)).to_pylist() for n in reasons]
            k = list(zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in keys], strict=True)) if keys else [()] * rows
            out: list[tuple[list, list]] = [([None] * rows, [None] * rows) for _ in plan]
            for i in range(rows):
                if k[i] != current:
                    current, state = k[i], [make() for make, _ in plan]
                for (_, at), kernel, (ov, orr) in zip(plan, state, out, strict=True):
                    for a in at:
                        if v[a][i] is None:
                            ov[i], orr[i] = kernel.absent(r[a][i]), r[a][i]
                            break
                    else:
                        ov[i], orr[i] = kernel.step(ts[i], *[v[a][i] for a in at])
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            for kind, (ov, orr) in zip(kinds, out, strict=True):
                columns += [pa.array(ov, kind), pa.array(orr, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[x for n in names for x in (n, f"{n}_r")]])

    return run
