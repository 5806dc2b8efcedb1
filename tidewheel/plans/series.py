"""A series: a node of the graph that a Flow plans, with its arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions import absent as A


class Kernel:
    """A sequential operator: one instance per key, one step per present record; also used by streams."""

    def step(self, ts: int, *values: float) -> tuple[object, str | None]:
        raise NotImplementedError

    def absent(self, reason: str | None):
        """The value for a record whose input is absent; state stays as it is."""
        return None


class Series:
    def __init__(self, flow, kind: str, inputs: list[Series], build: Callable, nullable: bool = True, dtype: str = "double"):
        self.flow, self.kind, self.inputs, self.build, self.nullable, self.dtype = flow, kind, inputs, build, nullable, dtype
        self.level = max((i.level for i in inputs), default=0) + (kind != "expr")
        self.label: str | None = None
        #: How far back in ms a value looks; infinite where it may depend on a key's whole past.
        self.reach: float = max((i.reach for i in inputs), default=0.0) if kind == "expr" else float("inf")

    # construction
    def expr(self, f: Callable[..., Column], *others: Series, nullable: bool | None = None, reason: Callable[..., Column] | None = None, dtype: str = "double") -> Series:
        """f over the values; absent where an input is (the left one's reason first), or where f gives null (with `reason`)."""
        inputs = [self, *others]

        def build(*cols):
            v = f(*[c[0] for c in cols])
            own = reason(*[c[0] for c in cols]) if reason else F.lit(A.FILTERED_OUT)
            for c in reversed(cols):
                own = F.when(c[0].isNull(), c[1]).otherwise(own)
            present = None
            for i, c in zip(inputs, cols, strict=True):
                if i.nullable:
                    present = c[0].isNotNull() if present is None else present & c[0].isNotNull()
            return (F.when(present, v) if present is not None else v), own

        return Series(self.flow, "expr", inputs, build, (any(i.nullable for i in inputs) or reason is not None) if nullable is None else nullable, dtype)

    def window(self, f: Callable, *others: Series, reason: str = A.WARMING_UP, dtype: str = "double", nullable: bool = True) -> Series:
        """f(env, *values) is a window expression; null results are absent with `reason`, absent inputs keep theirs."""
        inputs = [self, *others]

        def build(env, *cols):
            v = f(env, *[c[0] for c in cols])
            r = F.lit(reason)
            present = None
            for i, c in reversed(list(zip(inputs, cols, strict=True))):
                if i.nullable:
                    r = F.when(c[0].isNull(), c[1]).otherwise(r)
                    present = c[0].isNotNull() if present is None else present & c[0].isNotNull()
            return (F.when(present, v) if present is not None else v), r

        return Series(self.flow, "window", inputs, build, nullable, dtype)

    def kernel(self, make: Callable[[], Kernel], *others: Series, dtype: str = "double") -> Series:
        return Series(self.flow, "kernel", [self, *others], make, True, dtype)

    # graph primitives
    def named(self, label: str) -> Series:
        self.label = label
        return self

    def prop_from_record(self, column: str | Column) -> Series:
        return self.flow.prop(column)

    def map(self, f: Callable[[Column], Column]) -> Series:
        return self.expr(f)

    def map2(self, other: Series, f: Callable[[Column, Column], Column]) -> Series:
        return self.expr(f, other)

    def filter(self, pred: Callable[[Column], Column]) -> Series:
        """Absent (FilteredOut) where the predicate isn't true; the row stays."""
        return self.expr(lambda v: F.when(pred(v), v), nullable=True)

    def filter_map(self, f: Callable[[Column], Column]) -> Series:
        """Absent (FilteredOut) where f gives null."""
        return self.expr(f, nullable=True)

    def scan(self, init: Callable[[], object], step: Callable[[object, float], tuple[object, float]]) -> Series:
        """Fold: step(state, value) gives the next state and the output; absent records are stepped over."""
        return self.kernel(lambda: _Scan(init, step))

    def scan2(self, other: Series, init: Callable[[], object], step: Callable[[object, float, float], tuple[object, float]]) -> Series:
        return self.kernel(lambda: _Scan(init, step), other)

    def custom(self, make: Callable[[], Kernel], *others: Series, dtype: str = "double") -> Series:
        """A user's own operator: an object with step(ts, *values) for each key."""
        return self.kernel(make, *others, dtype=dtype)

    # arithmetic
    def _with(self, other, f: Callable[[Column, Column], Column], swap: bool = False) -> Series:
        o = other if isinstance(other, Series) else self.flow.constant(other)
        return o.expr(f, self) if swap else self.expr(f, o)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __radd__(self, o):
        return self._with(o, lambda a, b: a + b, True)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._with(o, lambda a, b: a - b, True)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return self._with(o, lambda a, b: a * b, True)

    def __truediv__(self, o):
        return self._with(o, A.divide)

    def __rtruediv__(self, o):
        return self._with(o, A.divide, True)

    def __neg__(self):
        return self.expr(lambda v: -v)

    def gt(self, o) -> Series:
        return self._with(o, lambda a, b: F.when(A.less(b, a), 1.0).otherwise(0.0))

    def gte(self, o) -> Series:
        return self._with(o, lambda a, b: F.when(A.at_most(b, a), 1.0).otherwise(0.0))

    def lt(self, o) -> Series:
        return self._with(o, lambda a, b: F.when(A.less(a, b), 1.0).otherwise(0.0))

    def lte(self, o) -> Series:
        return self._with(o, lambda a, b: F.when(A.at_most(a, b), 1.0).otherwise(0.0))

    def divide_safe(self, o) -> Series:
        """Division that is absent (DivideByZero) at a zero divisor."""
        o = o if isinstance(o, Series) else self.flow.constant(o)
        return self.expr(lambda a, b: F.when(b != 0, F.try_divide(a, b)), o, nullable=True, reason=lambda a, b: F.lit(A.DIVIDE_BY_ZERO))

    def present(self) -> Series:
        """Number of present values so far, the order that count windows over absent rows go by."""
        def build(env, x):
            return F.count(x[0]).over(env.until_now()), F.lit(None).cast("string")

        return Series(self.flow, "window", [self], build, False, "bigint")


class _Scan(Kernel):
    def __init__(self, init: Callable, step: Callable):
        self.state, self._step = init(), step

    def step(self, ts, *values):
        self.state, out = self._step(self.state, *values)
        return (None, A.FILTERED_OUT) if out is None else (float(out), None)
