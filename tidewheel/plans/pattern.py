"""Event patterns: when, then, not_then, not_between, times, next, within.

A pattern is matched per key. Step predicates that look only at the event are evaluated as Columns before the
matcher runs; predicates in the rule language may also look at captures (`first_x`, `prev_x`, `s0_x`). Short
patterns (one step, two steps, or an absence) become window expressions; the others run in a matcher that goes
through a key's events once. Runs overlap: an event may advance one partial match and open another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cel
from ..functions.duration import dur
from ..operators.keyed import Emitter, emit

_CAPTURE = re.compile(r"(first|prev|s\d+)_(\w+)")


class PatternError(ValueError):
    """NoWhenStep, NotThenMissingWithin, NotThenNotTerminal or CelCompile."""


@dataclass(frozen=True)
class Step:
    kind: str  # when, then, not_then
    name: str
    pred: Column | str
    guards: tuple = ()
    within: int | None = None
    strict: bool = False
    least: int = 1
    most: int = 1


@dataclass(frozen=True)
class Pattern:
    name: str = "pattern"
    steps: tuple[Step, ...] = ()
    pending: tuple = ()
    strict: bool = False
    broken: str | None = None

    def _add(self, kind: str, pred, name: str | None) -> Pattern:
        broken = self.broken
        if isinstance(pred, str):
            try:
                cel.parse(pred)
            except cel.CelError as e:
                broken = broken or f"CelCompile: {e}"
        step = Step(kind, name or f"s{len(self.steps)}", pred, self.pending, strict=self.strict)
        return replace(self, steps=(*self.steps, step), pending=(), strict=False, broken=broken)

    def when(self, pred: Column | str, name: str | None = None) -> Pattern:
        """Opens a partial match on each event that matches."""
        return self._add("when", pred, name)

    def then(self, pred: Column | str, name: str | None = None) -> Pattern:
        """The next event that matches, whatever lies between."""
        return self._add("then", pred, name)

    def not_then(self, pred: Column | str, name: str | None = None) -> Pattern:
        """Last step: the match completes if no such event comes within the bound."""
        return self._add("not_then", pred, name)

    def not_between(self, pred: Column | str) -> Pattern:
        """An event that matches ends the partial match, unless it also matches the step that follows."""
        broken = self.broken
        if isinstance(pred, str):
            try:
                cel.parse(pred)
            except cel.CelError as e:
                broken = broken or f"CelCompile: {e}"
        return replace(self, pending=(*self.pending, pred), broken=broken)

    def next(self) -> Pattern:
        """The step that follows must be the very next event."""
        return replace(self, strict=True)

    def within(self, length: int | str) -> Pattern:
        """Bounds the last step: at most `length` after the capture before it."""
        return self._last(within=dur(length))

    def times(self, least: int, most: int) -> Pattern:
        """The last step, least to most times, as often as it can."""
        if least < 1 or most < least:
            raise PatternError("times needs 1 <= least <= most")
        return self._last(least=least, most=most)

    def _last(self, **change) -> Pattern:
        if not self.steps:
            raise PatternError("NoWhenStep")
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **change)))

    def check(self) -> Pattern:
        if self.broken:
            raise PatternError(self.broken)
        if not self.steps or self.steps[0].kind != "when" or any(s.kind == "when" for s in self.steps[1:]):
            raise PatternError("NoWhenStep")
        for i, s in enumerate(self.steps):
            if s.kind == "not_then" and s.within is None:
                raise PatternError("NotThenMissingWithin")
            if s.kind == "not_then" and i < len(self.steps) - 1:
                raise PatternError("NotThenNotTerminal")
        return self

    @classmethod
    def from_spec(cls, spec: dict | str) -> Pattern:
        """{name, when, then[], notBetween[], notThen, within}: `within` bounds the last step, guards stand before each then."""
        spec = json.loads(spec) if isinstance(spec, str) else spec
        if "when" not in spec:
            raise PatternError("NoWhenStep")
        p = cls(spec.get("name", "pattern")).when(spec["when"])
        thens = spec.get("then") or []
        for t in [thens] if isinstance(thens, str) else thens:
            for g in spec.get("notBetween") or []:
                p = p.not_between(g)
            p = p.then(t)
        if spec.get("notThen"):
            p = p.not_then(spec["notThen"])
        if spec.get("within") is not None:
            p = p.within(spec["within"])
        return p.check()


@dataclass
class Partial:
    captures: list = field(default_factory=list)  # (step number, ts, event)
    step: int = 1
    repeats: int = 0
    deadline: int | None = None


class Matcher:
    """Matches one stream: push events in order, tick to let time pass, flush at the end.

    test(step, slot, event, captures) tells whether an event matches a step (slot -1) or its guard (slot 0, 1, ...).
    """

    def __init__(self, steps: Iterable[Step], test: Callable, max_in_flight: int | None = None):
        self.steps, self.test, self.most = list(steps), test, max_in_flight
        self.evicted: list[list] = []  # captures of partial matches that gave way to newer ones
        self.live: list[Partial] = []
        self.dropped = {"MaxInFlight": 0, "Deadline": 0, "Late": 0}
        self.ts: int | None = None

    def _bound(self, p: Partial) -> None:
        within = self.steps[p.step].within if p.step < len(self.steps) else None
        p.deadline = None if within is None else p.captures[-1][1] + within

    def _satisfied(self, p: Partial) -> bool:
        """Nothing is missing but more repeats of the last step, or an event that must not come."""
        if p.step >= len(self.steps):
            return True
        s = self.steps[p.step]
        return p.step == len(self.steps) - 1 and (s.kind == "not_then" or p.repeats >= s.least)

    def tick(self, ts: int) -> list[tuple[int, list]]:
        """Matches that complete because their deadline has passed: (time, captures)."""
        done, live = [], []
        for p in self.live:
            if p.deadline is not None and ts > p.deadline:
                if self._satisfied(p):
                    done.append((p.deadline, p.captures))
                else:
                    self.dropped["Deadline"] += 1
            else:
                live.append(p)
        self.live = live
        return done

    def _advance(self, p: Partial, ts: int, event) -> str:
        """What becomes of a partial match: `keep`, `dead` or `done`."""
        while True:
            s = self.steps[p.step]
            hit = self.test(p.step, -1, event, p.captures)
            if s.kind == "not_then":
                return "dead" if hit else "keep"
            if hit:
                p.captures.append((p.step, ts, event))
                p.repeats += 1
                if p.repeats < s.most:
                    self._bound(p)
                    return "keep"
                p.step, p.repeats = p.step + 1, 0
                self._bound(p)
                return "done" if p.step >= len(self.steps) else "keep"
            if any(self.test(p.step, g, event, p.captures) for g in range(len(s.guards))):
                return "dead"
            if p.repeats >= s.least:  # enough of them: the event is tried on the next step
                p.step, p.repeats = p.step + 1, 0
                self._bound(p)
                if p.step >= len(self.steps):
                    return "done"
                continue
            return "dead" if s.strict else "keep"

    def push(self, ts: int, event) -> list[tuple[int, list]]:
        if self.ts is not None and ts < self.ts:
            self.dropped["Late"] += 1
            return []
        self.ts = ts
        done = self.tick(ts)
        live = []
        for p in reversed(self.live):
            state = self._advance(p, ts, event)
            if state == "done":
                done.append((ts, p.captures))
            elif state == "keep":
                live.append(p)
        self.live = live[::-1]
        if self.test(0, -1, event, []):
            p = Partial([(0, ts, event)])
            if len(self.steps) == 1:
                done.append((ts, p.captures))
            else:
                self._bound(p)
                if self.most is not None and len(self.live) >= self.most:
                    self.evicted.append(self.live.pop(0).captures)
                    self.dropped["MaxInFlight"] += 1
                self.live.append(p)
        return done

    def next_deadline(self) -> int | None:
        return min((p.deadline for p in self.live if p.deadline is not None), default=None)

    def flush(self) -> list[tuple[int, list]]:
        done = [(p.deadline if p.deadline is not None else p.captures[-1][1], p.captures) for p in self.live if self._satisfied(p)]
        self.live = []
        return done


def _looks_back(pred: Column | str, types: dict[str, str]) -> bool:
    return isinstance(pred, str) and any(n not in types and _CAPTURE.fullmatch(n) for n in cel.names(cel.parse(pred)))


class _Run(Emitter):
    def __init__(self, steps, plan, fields, max_in_flight):
        self.matcher = Matcher(steps, self.test, max_in_flight)
        self.plan, self.fields = plan, fields

    def test(self, step: int, slot: int, event: tuple, captures: list) -> bool:
        how = self.plan[(step, slot)]
        if isinstance(how, int):
            return bool(event[1][how])
        env = dict(zip(self.fields, event[2], strict=True))
        if captures:
            for name, (_, _, e) in (("first", captures[0]), ("prev", captures[-1]), *((f"s{i}", c) for i, c in enumerate(captures))):
                env |= {f"{name}_{f}": v for f, v in zip(self.fields, e[2], strict=True)}
        return cel.true_on(how, env)

    def rows(self, done: list, dropped: str | None = None) -> list[tuple]:
        names = [s.name for s in self.matcher.steps]
        return [(at, [names[c[0]] for c in captures], [c[2][0] for c in captures], [c[1] for c in captures], dropped) for at, captures in done]

    def record(self, ts, row):
        flags, fields = row[1 : 1 + self.width], row[1 + self.width :]
        out = self.rows(self.matcher.push(ts, (row[0], flags, fields)))
        if self.matcher.evicted:
            out += self.rows([(ts, captures) for captures in self.matcher.evicted], "MaxInFlight")
            self.matcher.evicted.clear()
        return out

    def flush(self):
        return self.rows(self.matcher.flush())


def match_pattern(df: DataFrame, pattern: Pattern, key: str, ts: str, order: str, event_id: str, shapes: bool = True, max_in_flight: int | None = None) -> DataFrame:
    """key, pattern, at, steps, events, times: a row for each match, with the captures' step names, event ids and times.

    at is the last capture's time, or the deadline of an absence. shapes: use window expressions where there are any.
    max_in_flight: so many partial matches a key has open at most; the oldest gives way, and comes out as a row too,
    with `MaxInFlight` in a further column `dropped` (null for matches). Without it nothing is dropped.
    """
    p = pattern.check()
    types = dict(df.dtypes)
    if shapes and max_in_flight is None and (shaped := _shape(df, p, types, key, ts, order, event_id)) is not None:
        return shaped
    plan: dict[tuple[int, int], object] = {}
    flags, fields = {}, set()
    for i, s in enumerate(p.steps):
        for slot, pred in ((-1, s.pred), *enumerate(s.guards)):
            if _looks_back(pred, types):
                plan[(i, slot)] = cel.parse(pred)
                for n in cel.names(plan[(i, slot)]):
                    m = _CAPTURE.fullmatch(n)
                    fields.add(n if n in types else m[2] if m else n)
            else:
                plan[(i, slot)] = len(flags)
                flags[f"__f{len(flags)}"] = cel.predicate(pred, types) if isinstance(pred, str) else F.coalesce(pred, F.lit(False))
    used = sorted(f for f in fields if f in types)
    ready = df.withColumns(flags) if flags else df
    width = len(flags)
    steps = [replace(s, pred="", guards=tuple("" for _ in s.guards)) for s in p.steps]

    def make():
        run = _Run(steps, plan, used, max_in_flight)
        run.width = width
        return run

    out = emit(ready, [key], [ts, order], ts, make, [event_id, *flags, *used], f"`{key}` {types[key]}, at bigint, steps array<string>, events array<{types[event_id]}>, times array<bigint>, dropped string")
    return out.select(key, F.lit(p.name).alias("pattern"), "at", "steps", "events", "times", *(["dropped"] if max_in_flight is not None else []))


def _shape(df: DataFrame, p: Pattern, types: dict, key: str, ts: str, order: str, event_id: str) -> DataFrame | None:
    """One step; when-then; when-not_then: the next event of a kind is a window function away."""
    s = p.steps
    if len(s) > 2 or any(_looks_back(x, types) for step in s for x in (step.pred, *step.guards)) or any((x.least, x.most) != (1, 1) for x in s[1:]):
        return None
    hold = lambda pred: cel.predicate(pred, types) if isinstance(pred, str) else F.coalesce(pred, F.lit(False))
    w = Window.partitionBy(key).orderBy(ts, order)
    after = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)  # what follows, as a running frame: linear
    d = df.withColumns({"__when": hold(s[0].pred), "__ts": F.col(ts).cast("bigint")})
    done = lambda at, names, events, times: [F.col(key), F.lit(p.name).alias("pattern"), at.alias("at"), F.array(*map(F.lit, names)).alias("steps"), F.array(*events).alias("events"), F.array(*times).alias("times")]
    if len(s) == 1:
        return d.filter("__when").select(*done(F.col("__ts"), [s[0].name], [F.col(event_id)], [F.col("__ts")]))
    t = s[1]
    d = d.withColumns({"__hit": hold(t.pred), "__place": F.row_number().over(w)})
    spot = F.struct(F.col("__place").alias("place"), F.col("__ts").alias("ts"), F.col(event_id).alias("id"))
    if t.strict:
        nxt = F.lead(F.when(F.col("__hit"), spot)).over(w)
    else:
        nxt = F.last(F.when(F.col("__hit"), spot), ignorenulls=True).over(after)
    columns = {"__next": nxt}
    if t.guards:
        guard = F.lit(False)
        for g in t.guards:
            guard = guard | hold(g)
        columns["__stop"] = F.last(F.when(guard & ~F.col("__hit"), F.col("__place")), ignorenulls=True).over(after)
    d = d.withColumns(columns).filter("__when")
    in_time = F.col("__next")["ts"] - F.col("__ts") <= t.within if t.within is not None else F.lit(True)
    if t.kind == "not_then":
        if t.guards:
            return None
        return d.filter(~F.coalesce(F.col("__next").isNotNull() & in_time, F.lit(False))).select(*done(F.col("__ts") + t.within, [s[0].name], [F.col(event_id)], [F.col("__ts")]))
    if t.guards:
        d = d.filter(F.col("__stop").isNull() | (F.col("__stop") > F.col("__next")["place"]))
    return d.filter(F.col("__next").isNotNull() & in_time).select(*done(F.col("__next")["ts"], [s[0].name, t.name], [F.col(event_id), F.col("__next")["id"]], [F.col("__ts"), F.col("__next")["ts"]]))
