"""Series operators over events: key user_id, time ts, order event_id, series value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import operators  # noqa: F401  attaches the operators to Series
from ..functions import absent as A
from ..operators import detectors
from ..operators.composites import GainOffset
from ..plans import Count, Flow, Series, Time, over, over_n

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 4
#: Added before rounding: means of short decimals often lie halfway between two results.
SHIFT = 0.0000314159


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


class Source:
    """Series of an events flow: value, a second series, and bars made of value."""

    def __init__(self, df: DataFrame):
        self.flow = Flow(df, "ts", "user_id", "event_id", unique_ts=True)
        p = self.flow.prop
        self.v = p("value", required=True)
        self.y = p(F.col("value") * F.col("value") + F.col("event_id") % 5, required=True)
        self.high, self.low = p(F.col("value") * 1.01, required=True), p(F.col("value") * 0.99, required=True)
        self.q = p(F.col("event_id") % 7 + 1, required=True)
        self.some = p(F.when(F.col("event_id") % 3 != 0, F.col("value")))  # every third is absent


def _out(c: Column, kind: str) -> Column:
    c = c.cast("double") if kind == "bigint" else c
    if kind in ("string", "boolean", "int"):
        return c
    return F.when(A.is_finite(c), F.round(c + F.lit(SHIFT), DIGITS) + F.lit(0.0))


def series_query(spark: SparkSession, sf_dir: str, make: Callable[[Source], dict], reasons: bool = False) -> DataFrame:
    src = Source(events(spark, sf_dir))
    outs = make(src)
    df = src.flow.select(reasons, ["event_id"], **outs)
    kinds = dict(df.dtypes)
    columns = [_out(F.col(n), kinds[n]).alias(n) for n in outs]
    if reasons:
        columns += [F.col(f"{n}__absent") for n in outs]
    return df.select("event_id", *columns)


BASE = """e as (select event_id, user_id, epoch_us(ts) // 1000 as t, value as v, value * value + event_id % 5 as y, value * 1.01::double as h, value * 0.99::double as l,
  (event_id % 7 + 1)::double as q, case when event_id % 3 <> 0 then value end as s, event_type from events)"""
W = "(partition by user_id order by t, event_id)"


def wn(n: int) -> str:
    return f"(partition by user_id order by t, event_id rows between {n - 1} preceding and current row)"


def wt(ms: int) -> str:
    return f"(partition by user_id order by t range between {ms} preceding and current row)"


UNB = "(partition by user_id order by t, event_id rows between unbounded preceding and current row)"


def _sql_out(x: str) -> str:
    return f"case when isfinite(({x})::double) then round(({x})::double + {SHIFT}::double, {DIGITS}) + 0.0 end"


def add(name: str, make: Callable[[Source], dict], strings: dict[str, str] | None = None, ctes: str = "", source: str = "e", reasons: bool = False, **sql: str) -> None:
    """Registers a query; sql: an expression over `source` for each numeric output, strings: for the others."""
    QUERIES[name] = lambda spark, sf_dir: series_query(spark, sf_dir, make, reasons)
    columns = [f"{_sql_out(x)} as {n}" for n, x in sql.items()] + [f'{x} as "{n}"' for n, x in (strings or {}).items()]
    ORACLES[name] = f"with {BASE}{', ' + ctes if ctes else ''} select event_id, {', '.join(columns)} from {source}"


def add_recursive(name: str, make: Callable[[Source], dict], state: list[tuple[str, str, str]], ctes: str = "", over: str = "e", **sql: str) -> None:
    """state: (name, seed, step); a step sees the row as n, the state before as r, and what stands above it as <name>_n."""
    QUERIES[name] = lambda spark, sf_dir: series_query(spark, sf_dir, make)
    ORACLES[name] = recursive_sql(state, ctes, over, **sql)


def recursive_sql(state: list[tuple[str, str, str]], ctes: str = "", over: str = "e", **sql: str) -> str:
    seeds = ", ".join(f"{s} as {n}" for n, s, _ in state)
    steps = ", ".join(f"{x} as {n}_n" for n, _, x in state)
    named = ", ".join(f"{n}_n as {n}" for n, _, _ in state)
    columns = ", ".join(f"{_sql_out(x)} as {n}" for n, x in sql.items())
    return f"""with recursive {BASE}{', ' + ctes if ctes else ''}, n as (select *, row_number() over {W} as rn from {over}),
 r as (select user_id, 0::bigint as rn, null::bigint as event_id, {seeds} from (select distinct user_id from n)
   union all select user_id, rn, event_id, {named} from (select n.user_id, n.rn, n.event_id, {steps} from r join n on n.user_id = r.user_id and n.rn = r.rn + 1))
select event_id, {columns} from r where rn > 0"""


# graph primitives
add("prop", lambda s: {"x": s.v}, x="v")
add("const", lambda s: {"x": s.flow.constant(2.5)}, x="2.5")
add("prop_from_record", lambda s: {"x": s.v.prop_from_record("event_id")}, x="event_id")
add("map", lambda s: {"x": s.v.map(lambda v: v * 2 + 1)}, x="v * 2 + 1")
add("map2", lambda s: {"x": s.some.map2(s.q, lambda a, b: a * b + b)}, x="s * q + q")
add("filter", lambda s: {"x": s.v.filter(lambda v: v > 20)}, reasons=True, x="case when v > 20 then v end", strings={"x__absent": "case when v > 20 then null else 'FilteredOut' end"})
add("filter_map", lambda s: {"x": s.v.filter_map(lambda v: F.when(v > 20, v * 10))}, x="case when v > 20 then v * 10 end")
add_recursive("scan", lambda s: {"x": s.v.scan(lambda: 0.0, lambda a, v: (0.9 * a + 0.1 * v,) * 2)}, [("a", "0::double", "0.9::double * r.a + 0.1::double * n.v")], x="a")
add_recursive("scan2", lambda s: {"x": s.v.scan2(s.q, lambda: 0.0, lambda a, v, q: (0.5 * a + v * q,) * 2)}, [("a", "0::double", "0.5::double * r.a + n.v * n.q")], x="a")
add_recursive("scan_ckpt", lambda s: {"x": s.some.scan(lambda: 0.0, lambda a, v: (0.9 * a + v,) * 2)}, [("a", "0::double", "case when n.s is null then r.a else 0.9::double * r.a + n.s end"), ("o", "null::double", "case when n.s is not null then a_n end")], x="o")
add("named", lambda s: {"x": s.v.named("reading")}, x="v")
add("arith", lambda s: {"a": s.v + s.q, "b": s.v - 3, "c": 2 * s.v, "d": s.v / (s.q - 4), "e": -s.v, "f": 100 / s.q}, a="v + q", b="v - 3", c="2 * v", d="case when q <> 4 then v / (q - 4) end", e="-v", f="100 / q")
add("cmp", lambda s: {"a": s.v.gt(s.q * 10), "b": s.v.gte(20), "c": s.v.lt(20), "d": s.v.lte(s.q)}, a="(v > q * 10)::int", b="(v >= 20)::int", c="(v < 20)::int", d="(v <= q)::int")


class _Peak(operators.windows.Kernel):
    def __init__(self):
        self.best = float("-inf")

    def step(self, ts, v):
        self.best = max(self.best * 0.99, v)
        return self.best, None


add_recursive("custom_node", lambda s: {"x": s.v.custom(_Peak)}, [("b", "'-infinity'::double", "greatest(r.b * 0.99::double, n.v)")], x="b")
add("multi_out", lambda s: {"a": s.v, "b": s.v + 1, "c": s.v.sma(3)}, a="v", b="v + 1", c=f"avg(v) over {wn(3)}")
add("graph_map", lambda s: {"x": s.v.sma(3).map(lambda m: m * 2)}, x=f"2 * avg(v) over {wn(3)}")
add("graph_filter", lambda s: {"x": s.v.sma(3).filter(lambda m: m > 20)}, ctes=f"g as (select *, avg(v) over {wn(3)} as m from e)", source="g", x="case when m > 20 then m end")
add("graph_filter_map", lambda s: {"x": s.v.sma(3).filter_map(lambda m: F.when(m > 20, m - 20))}, ctes=f"g as (select *, avg(v) over {wn(3)} as m from e)", source="g", x="case when m > 20 then m - 20 end")
add("graph_fold", lambda s: {"x": s.v.sma(2).cumsum()}, ctes=f"g as (select *, avg(v) over {wn(2)} as m from e)", source="g", x=f"sum(m) over {UNB}")
add("graph_reduce", lambda s: {"x": s.v.map2(s.q, lambda a, b: a * b), "y": s.v.expr(lambda a, b, c: a + b * c, s.q, s.y)}, x="v * q", y="v + q * y")
add("pipe", lambda s: {"x": s.v.sma(3).zscore(5)}, ctes=f"g as (select *, avg(v) over {wn(3)} as m from e), k as (select *, avg(m) over {wn(5)} as a, stddev_pop(m) over {wn(5)} as d, count(*) over {wn(5)} as c from g)", source="k", x="case when c > 1 and d <> 0 then (m - a) / d end")


def _with_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(events(spark, sf_dir))
    return s.flow.select(m=s.v.sma(3)).select("event_id", "user_id", "event_type", _out(F.col("m"), "double").alias("m"))


QUERIES["with_record"] = _with_record
ORACLES["with_record"] = f"with {BASE} select event_id, user_id, event_type, {_sql_out(f"avg(v) over {wn(3)}")} as m from e"
add("graph_zip", lambda s: {"a": s.v.sma(3), "b": s.v.cumsum()}, a=f"avg(v) over {wn(3)}", b=f"sum(v) over {UNB}")

# sliding windows
N, T = 5, 3_600_000 * 6
_BOTH = (("n", Count(N), wn(N)), ("t", Time(T), wt(T)))
for _k, _w, _o in _BOTH:
    _c = f"count(v) over {_o}"
    add(f"sma_{_k}", lambda s, w=_w: {"x": s.v.sma(w)}, x=f"avg(v) over {_o}")
    add(f"sum_{_k}", lambda s, w=_w: {"x": s.v.sum(w)}, x=f"sum(v) over {_o}")
    add(f"count_{_k}", lambda s, w=_w: {"x": s.v.count(w)}, x=_c)
    add(f"min_{_k}", lambda s, w=_w: {"x": s.v.min(w)}, x=f"min(v) over {_o}")
    add(f"max_{_k}", lambda s, w=_w: {"x": s.v.max(w)}, x=f"max(v) over {_o}")
    add(f"var_{_k}", lambda s, w=_w: {"x": s.v.variance(w)}, x=f"case when {_c} >= 2 then var_pop(v) over {_o} end")
    add(f"std_{_k}", lambda s, w=_w: {"x": s.v.std(w)}, x=f"case when {_c} >= 2 then stddev_pop(v) over {_o} end")
    add(f"median_{_k}", lambda s, w=_w: {"x": s.v.median(w)}, x=f"quantile_cont(v, 0.5) over {_o}")
    add(f"quantile_{_k}", lambda s, w=_w: {"x": s.v.quantile(w, 0.8)}, x=f"quantile_cont(v, 0.8) over {_o}")
    _l = f"g as (select event_id, v, list(v) over {_o} as a from e)"
    add(f"rank_{_k}", lambda s, w=_w: {"x": s.v.rank(w)}, ctes=_l, source="g", x="len(list_filter(a, lambda z: z < v))::double / greatest(len(a) - 1, 1)")
    _m = _l + ", m as (select *, len(a) as n, list_avg(a) as mu, list_var_pop(a) as s2 from g)"
    add(f"skew_{_k}", lambda s, w=_w: {"x": s.v.skewness(w)}, ctes=_m, source="m", x="case when n >= 3 and s2 > 0 then list_avg(list_transform(a, lambda z: (z - mu) ** 3)) / s2 ** 1.5 end")
    add(f"kurt_{_k}", lambda s, w=_w: {"x": s.v.kurtosis(w)}, ctes=_m, source="m", x="case when n >= 4 and s2 > 0 then list_avg(list_transform(a, lambda z: (z - mu) ** 4)) / s2 ** 2 - 3 end")
    add(f"cov_{_k}", lambda s, w=_w: {"x": s.v.covariance(s.y, w)}, x=f"case when {_c} >= 2 then covar_pop(v, y) over {_o} end")
    add(f"corr_{_k}", lambda s, w=_w: {"x": s.v.correlation(s.y, w)}, ctes=f"g as (select event_id, {_c} as c, var_pop(v) over {_o} as a, var_pop(y) over {_o} as b, covar_pop(v, y) over {_o} as k from e)", source="g", x="case when c >= 2 and a > 0 and b > 0 then k / sqrt(a * b) end")
_c5 = f"count(v) over {wn(N)}"
add("iqr", lambda s: {"x": s.v.iqr(Count(N))}, x=f"quantile_cont(v, 0.75) over {wn(N)} - quantile_cont(v, 0.25) over {wn(N)}")
add("percentile", lambda s: {"x": s.v.percentile(Count(N), 90)}, x=f"quantile_cont(v, 0.9) over {wn(N)}")
add("sample_cov", lambda s: {"x": s.v.sample_covariance(s.y, N)}, x=f"case when {_c5} >= 2 then covar_samp(v, y) over {wn(N)} end")
_reg = f"g as (select event_id, {_c5} as c, var_pop(v) over {wn(N)} as a, covar_pop(v, y) over {wn(N)} as k, avg(v) over {wn(N)} as mv, avg(y) over {wn(N)} as my from e)"
add("beta", lambda s: {"x": s.v.beta(s.y, N)}, ctes=_reg, source="g", x="case when c >= 2 and a > 0 then k / a end")
add("alpha", lambda s: {"x": s.v.alpha(s.y, N)}, ctes=_reg, source="g", x="case when c >= 2 and a > 0 then my - k / a * mv end")
add("wma_n", lambda s: {"x": s.v.wma(Count(N))}, ctes=f"g as (select event_id, list(v) over {wn(N)} as a from e)", source="g", x="list_sum(list_transform(a, lambda z, i: z * i)) / (len(a) * (len(a) + 1) / 2.0)")
add("wma_t", lambda s: {"x": s.v.wma(Time(T))}, ctes=f"g as (select event_id, t, list({{'t': t, 'v': v}}) over {wt(T)} as a from e), k as (select event_id, list_transform(a, lambda z: case when t > a[1].t then (z.t - a[1].t)::double / (t - a[1].t) + 0.001::double else 1::double end) as w, list_transform(a, lambda z: z.v) as v from g)", source="k", x="list_sum(list_transform(w, lambda z, i: z * v[i])) / list_sum(w)")
add("count_over_absent", lambda s: {"x": s.some.sma(3), "p": s.some.prev(), "c": s.some.count(3)}, ctes=f"g as (select * from e where s is not null), k as (select event_id, avg(s) over {wn(3)} as x, lag(s) over {W} as p, count(s) over {wn(3)} as c from g), j as (select e.event_id, k.x, k.p, k.c from e left join k using (event_id))", source="j", x="x", p="p", c="c")


def ema(p: str, n: int, x: str, a: str | None = None) -> list[tuple[str, str, str]]:
    a = a or f"(2.0::double / {n + 1})"
    return [(f"{p}c", "0::bigint", f"r.{p}c + ({x} is not null)::int"), (f"{p}s", "0::double", f"r.{p}s + coalesce({x}, 0)"),
            (f"{p}e", "null::double", f"case when {x} is null then r.{p}e when r.{p}e is not null then r.{p}e + {a} * ({x} - r.{p}e) when {p}c_n = {n} then {p}s_n / {n} end")]


def smooth(p: str, n: int, x: str) -> list[tuple[str, str, str]]:
    return ema(p, n, x, f"(1.0::double / {n})")


_PREV = [("p", "null::double", "n.v"), ("d", "null::double", "n.v - r.p")]
add_recursive("ema_n", lambda s: {"x": s.v.ema(Count(4))}, ema("a", 4, "n.v"), x="ae")
add_recursive("ema_t", lambda s: {"x": s.v.ema(Time(T))}, [("t0", "null::bigint", "n.t"), ("e", "null::double", f"case when r.t0 is null then n.v when n.t <= r.t0 then r.e else r.e + (1 - exp(-(n.t - r.t0)::double / {T})) * (n.v - r.e) end")], x="e")
add_recursive("ema_alpha", lambda s: {"x": s.v.ema_alpha(0.3)}, ema("a", 1, "n.v", "0.3::double"), x="ae")
_RSI = "case when l = 0 then case when g = 0 then 50 else 100 end else 100 - 100 / (1 + g / l) end"
for _k, _w, _o in _BOTH:
    add(f"rsi_{_k}", lambda s, w=_w: {"x": s.v.rsi(w)}, ctes=f"d as (select *, v - lag(v) over {W} as d from e), g as (select event_id, d, avg(greatest(d, 0)) over {_o} as g, avg(greatest(-d, 0)) over {_o} as l from (select * from d where d is not null)), k as (select d.event_id, g.g, g.l from d left join g using (event_id))", source="k", x=f"case when g is not null then {_RSI} end")
_WILDER = [*_PREV, *smooth("g", 4, "greatest(d_n, case when d_n is not null then 0 end)"), *smooth("l", 4, "case when d_n is not null then greatest(-d_n, 0) end")]
_WILDER[2:5] = smooth("g", 4, "case when d_n is not null then greatest(d_n, 0) end")
_WRSI = "case when ge is null then null when le = 0 then case when ge = 0 then 50 else 100 end else 100 - 100 / (1 + ge / le) end"
add_recursive("rsi_wilder", lambda s: {"x": s.v.rsi_wilder(4)}, _WILDER, x=_WRSI)
add("welford", lambda s: {"x": s.v.custom(lambda: operators.windows.SlidingWelford(7))}, x=f"case when count(v) over {wn(7)} >= 2 then var_pop(v) over {wn(7)} end")
add("over", lambda s: {"x": s.v.sma(over("6h")), "y": s.v.sma(over_n(4))}, x=f"avg(v) over {wt(T)}", y=f"avg(v) over {wn(4)}")

_LONG = operators.windows.LONG
add("sma_long", lambda s: {"x": s.v.sma(Count(_LONG)), "y": s.v.sum(Count(_LONG))}, x=f"avg(v) over {wn(_LONG)}", y=f"sum(v) over {wn(_LONG)}")
QUERIES["sliced"] = lambda spark, sf_dir: _sliced(spark, sf_dir)
ORACLES["sliced"] = f"with {BASE} select event_id, {_sql_out(f'avg(v) over {wt(T)}')} as x, {_sql_out(f'max(v) over {wt(T)} - min(v) over {wt(T)}')} as y from e"


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(events(spark, sf_dir))
    d = s.flow.select_sliced(10 * T, x=s.v.sma(Time(T)), y=s.v.max(Time(T)) - s.v.min(Time(T)))
    return d.select("event_id", _out(F.col("x"), "double").alias("x"), _out(F.col("y"), "double").alias("y"))



def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time windows over times that many events of a user share."""
    t = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / F.lit(1000 * T)).cast("bigint") * T
    f = Flow(events(spark, sf_dir).select("event_id", "user_id", "value", t.alias("t")), "t", "user_id", "event_id")
    v, y, w = f.prop("value", required=True), f.prop(F.col("event_id") % 5, required=True), Time(20 * T)
    outs = {"sma": v.sma(w), "total": v.sum(w), "n": v.count(w), "low": v.min(w), "high": v.max(w), "var": v.variance(w), "median": v.median(w), "cov": v.covariance(y, w), "lag": v.lag(20 * T), "rank": v.rank(w)}
    d = f.select(keep=["event_id"], **outs)
    return d.select("event_id", *[_out(F.col(n), "double").alias(n) for n in outs])


QUERIES["windows_with_ties"] = _tied
_MET = "avg(v) as sma, sum(v) as total, count(*) as n, min(v) as low, max(v) as high, case when count(*) > 1 then var_pop(v) end as var, median(v) as median, case when count(*) > 1 then covar_pop(v, y) end as cov, count(*) filter (where v < xv)::double / greatest(count(*) - 1, 1) as rank"
ORACLES["windows_with_ties"] = f"""with {BASE}, d as (select event_id, user_id, t // {T} * {T} as t, v, (event_id % 5)::double as y from e),
 j as (select x.event_id, x.v as xv, p.v, p.y from d x join d p on p.user_id = x.user_id and p.t >= x.t - {20 * T} and (p.t < x.t or (p.t = x.t and p.event_id <= x.event_id))),
 g as (select event_id, {_MET} from j group by event_id),
 l as (select x.event_id, arg_max(p.v, (p.t, p.event_id)) as lag from d x join d p on p.user_id = x.user_id and p.t <= x.t - {20 * T} group by x.event_id)
select g.event_id, {", ".join(f"{_sql_out(n)} as {n}" for n in ("sma", "total", "n", "low", "high", "var", "median", "cov", "lag", "rank"))} from g left join l using (event_id)"""

# trackers
add("prev", lambda s: {"x": s.v.prev()}, x=f"lag(v) over {W}")
add("prev_by_max", lambda s: {"x": s.v.prev_by_max(s.q, 3)}, ctes=f"""n as (select *, row_number() over {W} as rn from e),
 p as (select *, lag(rn) over (partition by user_id, q order by rn) as prn, lag(v) over (partition by user_id, q order by rn) as pv from n),
 z as (select p.event_id, any_value(p.pv) as pv, count(distinct b.q) as others from p left join n b on b.user_id = p.user_id and b.rn > p.prn and b.rn < p.rn group by p.event_id)""", source="z", x="case when others < 3 then pv end")
add("with_context", lambda s: {"x": s.v * s.flow.with_context({"scale": 3.0}).from_context(lambda c: c["scale"])}, x="v * 3")
add("prev_by", lambda s: {"x": s.v.prev_by("event_type")}, x="lag(v) over (partition by user_id, event_type order by t, event_id)")
_LAG = f"last_value(v) over (partition by user_id order by t range between unbounded preceding and {T} preceding)"
add("lag", lambda s: {"x": s.v.lag("6h")}, x=_LAG)
add("delta", lambda s: {"x": s.v.delta("6h")}, x=f"v - {_LAG}")
add("lag_at", lambda s: {"x": s.some.lag("6h")}, ctes=f"j as (select a.event_id, max_by(b.s, b.t) as z, any_value(a.s) as s from e a left join e b on a.user_id = b.user_id and b.t <= a.t - {T} and b.s is not null group by a.event_id)", source="j", x="case when s is not null then z end")
_RATE = f"(v - lag(v) over {W}) / (t - lag(t) over {W}) * 1000"
add("rate", lambda s: {"x": s.v.rate(1000) * 1000.0}, x=f"1000 * {_RATE}")
add("velocity", lambda s: {"x": s.v.velocity(1000) * 1000.0}, x=f"1000 * {_RATE}")
add("acceleration", lambda s: {"x": s.v.acceleration(1000) * 1e9}, ctes=f"g as (select *, {_RATE} as r, t - lag(t) over {W} as dt from e)", source="g", x=f"(r - lag(r) over {W}) / dt * 1000 * 1000000000")
add("cumsum", lambda s: {"x": s.v.cumsum()}, x=f"sum(v) over {UNB}")
add("cummax", lambda s: {"x": s.v.cummax()}, x=f"max(v) over {UNB}")
add("cummin", lambda s: {"x": s.v.cummin()}, x=f"min(v) over {UNB}")
add("cumprod", lambda s: {"x": (s.v / 1000.0 + 1).cumprod()}, x=f"product(v / 1000 + 1) over {UNB}")
add("cummean", lambda s: {"x": s.v.cummean()}, x=f"avg(v) over {UNB}")
add("pct_change", lambda s: {"x": s.v.pct_change()}, ctes=f"g as (select *, lag(v) over {W} as p from e)", source="g", x="case when p <> 0 then (v - p) / p * 100 end")
add("log_return", lambda s: {"x": (s.v - 15).log_return()}, ctes=f"g as (select event_id, v - 15 as z, lag(v - 15) over {W} as p from e)", source="g", reasons=True, x="case when z > 0 and p > 0 then ln(z / p) end", strings={"x__absent": "case when p is null then 'WarmingUp' when not (z > 0 and p > 0) then 'DomainError' end"})
add("ts_prev", lambda s: {"x": s.v.rate_per_ms() * 1e6}, x=f"(v - lag(v) over {W}) / (t - lag(t) over {W}) * 1000000")

# scalar math
add("abs", lambda s: {"x": (s.v - 20).abs()}, x="abs(v - 20)")
add("exp", lambda s: {"x": (s.v / 50).exp()}, x="exp(v / 50)")
add("floor", lambda s: {"x": s.v.floor()}, x="floor(v)")
add("ceil", lambda s: {"x": s.v.ceil()}, x="ceil(v)")
add("round", lambda s: {"x": s.v.round()}, x="round(v)")
add("pow", lambda s: {"x": (s.v / 10).pow(1.5)}, x="pow(v / 10, 1.5)")
add("clamp", lambda s: {"x": s.v.clamp(10, 30)}, x="least(greatest(v, 10), 30)")
add("sqrt", lambda s: {"x": (s.v - 20).sqrt()}, reasons=True, x="case when v >= 20 then sqrt(greatest(v - 20, 0)) end", strings={"x__absent": "case when v >= 20 then null else 'DomainError' end"})
for _n in ("ln", "log10", "log2"):
    add(_n, lambda s, n=_n: {"x": getattr(s.v - 20, n)()}, x=f"case when v > 20 then {_n}(case when v > 20 then v - 20 else 1 end) end")
add("divide_safe", lambda s: {"x": s.v.divide_safe(s.q - 4)}, reasons=True, x="case when q <> 4 then v / (q - 4) end", strings={"x__absent": "case when q = 4 then 'DivideByZero' end"})

# composites
_BAND = f"g as (select *, avg(v) over {wn(N)} as m, case when {_c5} >= 2 then stddev_pop(v) over {wn(N)} end as d, min(v) over {wn(N)} as lo, max(v) over {wn(N)} as hi, max(v) over {UNB} as top, lag(v, 3) over {W} as p3, quantile_cont(v, 0.1) over {wn(N)} as q10 from e)"
for _n in ("deviation_band", "bollinger_bands"):
    add(_n, lambda s, n=_n: dict(zip(("middle", "upper", "lower"), getattr(s.v, n)(N, 2.0), strict=True)), ctes=_BAND, source="g", middle="m", upper="m + 2 * d", lower="m - 2 * d")
add("zscore", lambda s: {"x": s.v.zscore(N)}, ctes=_BAND, source="g", reasons=True, x="case when d <> 0 then (v - m) / d end", strings={"x__absent": "case when d is null then 'WarmingUp' when d = 0 then 'DivideByZero' end"})
for _n in ("peak_decline", "drawdown"):
    add(_n, lambda s, n=_n: {"x": getattr(s.v, n)()}, ctes=_BAND, source="g", x="case when top <> 0 then (v - top) / top end")
for _n in ("momentum", "mom_n"):
    add(_n, lambda s, n=_n: {"x": getattr(s.v, n)(3)}, ctes=_BAND, source="g", x="v - p3")
for _n in ("rate_of_change", "roc_n"):
    add(_n, lambda s, n=_n: {"x": getattr(s.v, n)(3)}, ctes=_BAND, source="g", x="case when p3 <> 0 then (v - p3) / p3 * 100 end")
for _n in ("dc_remove", "dc_remover"):
    add(_n, lambda s, n=_n: {"x": getattr(s.v, n)(N)}, ctes=_BAND, source="g", x="v - m")
add("baseline_correct", lambda s: {"x": s.v.baseline_correct(N, 0.1)}, ctes=_BAND, source="g", x="v - q10")
add("normalize_range", lambda s: {"x": s.v.normalize_range(N)}, ctes=_BAND, source="g", x="case when hi > lo then (v - lo) / (hi - lo) end")
add("calibrate", lambda s: {"x": s.v.calibrate(1.5, -2)}, x="v * 1.5 - 2")
add("baseline_corrector", lambda s: {"x": s.v.baseline_corrector(N, 0.4)}, ctes=f"g as (select event_id, v, list_sort(list(v) over {wn(N)}) as a from e)", source="g", x="v - a[floor((len(a) - 1) * 0.4)::int + 1]")
add("range_normalizer", lambda s: {"x": s.v.range_normalizer(N)}, ctes=_BAND, source="g", x="case when hi > lo then (v - lo) / (hi - lo) else 0.5 end")
add("zscore_normalizer", lambda s: {"x": s.v.zscore_normalizer(N)}, ctes=_BAND, source="g", x="case when d > 1e-12 then (v - m) / d else 0 end")
_FIT = f"g as (select event_id, {_c5} as c, var_pop(v) over {wn(N)} as a, var_pop(y) over {wn(N)} as b, covar_pop(v, y) over {wn(N)} as k, avg(v) over {wn(N)} as mv, avg(y) over {wn(N)} as my from e), f as (select *, case when a > 1e-12 then k / a else 0 end as sl from g)"
add("linreg_window", lambda s: dict(zip(("slope", "intercept", "r2"), s.v.linreg(s.y, N), strict=True)), ctes=_FIT, source="f", slope="case when c >= 2 then sl end", intercept="case when c >= 2 then my - sl * mv end", r2="case when c >= 2 then case when b < 1e-12 then 1 when a > 1e-12 then k * k / (a * b) else 0 end end")
add("gain_offset", lambda s: {"x": GainOffset.from_two_points(0, 32, 100, 212).apply(s.v), "y": GainOffset(1.8, 32).inverse(s.v)}, x="v * 1.8 + 32", y="(v - 32) / 1.8")

# detectors
_P = f"g as (select *, lag(v) over {W} as p, lag(q * 5) over {W} as pq from e)"
add("cross", lambda s: {"x": s.v.cross(20)}, ctes=_P, source="g", strings={"x": "case when p < 20 and v >= 20 then 'Rising' when p >= 20 and v < 20 then 'Falling' else 'None' end"})
add("cross_above", lambda s: {"x": s.v.cross_above(s.q * 5)}, ctes=_P, source="g", strings={"x": "case when p < pq and v >= q * 5 then 'Rising' else 'None' end"})
add("cross_under", lambda s: {"x": s.v.cross_under(s.q * 5)}, ctes=_P, source="g", strings={"x": "case when p >= pq and v < q * 5 then 'Falling' else 'None' end"})
QUERIES["cross_hysteresis"] = lambda spark, sf_dir: series_query(spark, sf_dir, lambda s: {"x": s.v.cross_hysteresis(20, 5)})
ORACLES["cross_hysteresis"] = f"""with recursive {BASE}, n as (select *, row_number() over {W} as rn from e),
 r as (select user_id, 0::bigint as rn, null::bigint as event_id, null::boolean as up, 'None' as x from (select distinct user_id from n)
  union all select n.user_id, n.rn, n.event_id, case when r.up is null then v >= 20 when not r.up and v >= 25 then true when r.up and v <= 15 then false else r.up end,
    case when not r.up and v >= 25 then 'Rising' when r.up and v <= 15 then 'Falling' else 'None' end from r join n on n.user_id = r.user_id and n.rn = r.rn + 1)
select event_id, x from r where rn > 0"""
_ISLE = f"i as (select *, sum(case when up and not was then 1 else 0 end) over {UNB} as isle from (select *, coalesce(lag(v >= 20) over {W}, false) as was, v >= 20 as up from e)), g as (select *, t - min(case when up then t end) over (partition by user_id, isle) as width, max(case when up then v end) over (partition by user_id, isle) as peak, was and not up as fell from i)"
_MS = 3_600_000 * 4
add("glitch_filter", lambda s: {"x": s.v.glitch_filter(20, _MS)}, ctes=_ISLE, source="g", strings={"x": f"case when not fell then 'NoTransition' when width >= {_MS} then 'ValidPulse' else 'Rejected' end"})
add("runt_detect", lambda s: dict(zip(("mode", "peak"), s.v.runt_detect(20, 40), strict=True)), ctes=_ISLE, source="g", peak="case when fell then peak end", strings={"mode": "case when fell then case when peak >= 40 then 'ValidPulse' else 'Runt' end end"})
add("pulse_width", lambda s: dict(zip(("mode", "width"), s.v.pulse_width(20, _MS, 4 * _MS), strict=True)), ctes=_ISLE, source="g", width="case when fell then width end", strings={"mode": f"case when fell then case when width < {_MS} then 'TooShort' when width > {4 * _MS} then 'TooLong' else 'Valid' end end"})
add("window_detect", lambda s: {"x": s.v.window_detect(10, 30)}, ctes=f"z as (select *, case when v < 10 then -1 when v > 30 then 1 else 0 end as z from e), g as (select *, lag(z) over {W} as pz from z)", source="g", strings={"x": "case when z = 0 and pz <> 0 then 'EnteredWindow' when pz = 0 and z = -1 then 'ExitedLow' when pz = 0 and z = 1 then 'ExitedHigh' end"})


def _signal_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(events(spark, sf_dir))
    d = s.flow.select(x=s.v.window_detect(10, 30))
    m = F.coalesce("x", F.lit("None"))
    return d.select("event_id", detectors.to_threshold_cross(m).alias("edge"), detectors.is_active(m).alias("active"), F.round(detectors.map_payload(detectors.signal(m, F.col("value")), lambda p: p * 2)["payload"], DIGITS).alias("payload"))


QUERIES["signal_ops"] = _signal_ops
ORACLES["signal_ops"] = f"with {BASE}, z as (select *, case when v < 10 then -1 when v > 30 then 1 else 0 end as z from e), g as (select *, lag(z) over {W} as pz from z) select event_id, case when z = 0 and pz <> 0 then 'Rising' when pz = 0 and z <> 0 then 'Falling' else 'None' end as edge, coalesce(pz = 0 and z <> 0, false) as active, round(v * 2, 4) as payload from g"

# indicators
_M3 = [*ema("f", 3, "n.v"), *ema("w", 6, "n.v"), ("line", "null::double", "fe_n - we_n"), *ema("g", 4, "line_n")]
add_recursive("macd_n", lambda s: dict(zip(("line", "signal", "hist"), s.v.macd_n(3, 6, 4), strict=True)), _M3, line="case when ge is not null then line end", signal="ge", hist="line - ge")
_ST = f"g as (select *, min(v) over {wn(N)} as lo, max(v) over {wn(N)} as hi, min(l) over {wn(N)} as ll, max(h) over {wn(N)} as hh from e), k as (select *, case when hi > lo then (v - lo) / (hi - lo) * 100 end as k, case when hh > ll then (v - ll) / (hh - ll) * 100 end as f from g)"
_first = f"row_number() over {W}"
add("stochastic_k", lambda s: {"x": s.v.stochastic_k(N)}, ctes=_ST, source="k", x="k")
# 0/0 is NaN, which keeps its windows absent until it leaves them
_bad = lambda c, n: f"count(*) over {wn(n)} = count({c}) over {wn(n)}"
add("stochastic_n", lambda s: dict(zip(("k", "d"), s.v.stochastic_n(N, 3), strict=True)), ctes=_ST, source="k", k="k", d=f"case when {_bad('k', 3)} then avg(k) over {wn(3)} end")
add("stochastic_ohlc_n", lambda s: dict(zip(("k", "d"), s.v.stochastic_ohlc_n(s.high, s.low, N, 3), strict=True)), ctes=_ST + f", j as (select *, case when {_bad('f', 3)} then avg(f) over {wn(3)} end as sk from k)", source="j", k="sk", d=f"avg(sk) over {wn(3)}")
add("williams_r_n", lambda s: {"x": s.v.williams_r_n(N)}, ctes=_ST, source="k", x="case when hi > lo then (hi - v) / (hi - lo) * -100 end")
add("williams_r_ohlc_n", lambda s: {"x": s.v.williams_r_ohlc_n(s.high, s.low, N)}, ctes=_ST, source="k", x="case when hh > ll then (hh - v) / (hh - ll) * -100 end")
_LIST = f"g as (select event_id, v, list(v) over {wn(N)} as a from e)"
add("cci_n", lambda s: {"x": s.v.cci_n(N)}, ctes=_LIST + ", k as (select *, list_avg(a) as m, list_avg(list_transform(a, lambda z: abs(z - list_avg(a)))) as d from g)", source="k", x=f"case when len(a) = {N} then case when d = 0 then 0 else (v - m) / (0.015 * d) end end")
_TR = f"tr as (select *, case when lag(v) over {W} is not null then greatest(h - l, abs(h - lag(v) over {W}), abs(l - lag(v) over {W})) end as tr from e)"
add("true_range", lambda s: {"x": s.v.true_range(s.high, s.low)}, ctes=_TR, source="tr", x="tr")
add_recursive("atr_n", lambda s: {"x": s.v.atr_n(s.high, s.low, 4)}, ema("a", 4, "n.tr"), ctes=_TR, over="tr", x="ae")
add_recursive("atr_wilder_n", lambda s: {"x": s.v.atr_wilder_n(s.high, s.low, 4)}, smooth("a", 4, "n.tr"), ctes=_TR, over="tr", x="ae")
add("trima", lambda s: {"x": s.v.trima(N)}, ctes=_LIST, source="g", x="case when len(a) = 5 then (a[1] + 2 * a[2] + 3 * a[3] + 2 * a[4] + a[5]) / 9 end")
_E3 = [*ema("a", 3, "n.v"), *ema("b", 3, "ae_n"), *ema("c", 3, "be_n")]
add_recursive("dema_n", lambda s: {"x": s.v.dema_n(3)}, _E3[:6], x="2 * ae - be")
add_recursive("tema_n", lambda s: {"x": s.v.tema_n(3)}, _E3, x="3 * ae - 3 * be + ce")
add_recursive("trix_n", lambda s: {"x": s.v.trix_n(3)}, [*_E3, ("o", "null::double", "case when r.ce is not null then case when r.ce <> 0 then (ce_n - r.ce) / r.ce * 100 else 0 end end")], x="o")
add("typical_price", lambda s: {"x": s.v.typical_price(s.high, s.low)}, x="(h + l + v) / 3")
add("vwap", lambda s: {"x": s.v.vwap(s.q)}, x=f"sum(v * q) over {UNB} / sum(q) over {UNB}")
add("obv", lambda s: {"x": s.v.obv(s.q)}, ctes=f"g as (select *, case when lag(v) over {W} is null or v > lag(v) over {W} then q when v < lag(v) over {W} then -q else 0 end as o from e)", source="g", x=f"sum(o) over {UNB}")
_MFI = f"d as (select *, (h + l + v) / 3 as tp, lag((h + l + v) / 3) over {W} as p from e), g as (select event_id, row_number() over {W} as rn, sum(case when tp > p then tp * q else 0 end) over {wn(4)} as pos, sum(case when tp < p then tp * q else 0 end) over {wn(4)} as neg from d)"
add("mfi_n", lambda s: {"x": s.v.typical_price(s.high, s.low).mfi_n(s.q, 4)}, ctes=_MFI, source="g", x="case when rn > 4 then case when neg = 0 then case when pos = 0 then 50 else 100 end else 100 - 100 / (1 + pos / neg) end end")


def _dm(n: int) -> list[tuple[str, str, str]]:
    keep = f"case when i_n > {n} then {1 - 1 / n}::double else 1::double end"
    return [("i", "0::bigint", "r.i + 1"), ("ph", "null::double", "n.h"), ("pl", "null::double", "n.l"), ("pv", "null::double", "n.v"),
            ("up", "null::double", "n.h - r.ph"), ("dn", "null::double", "r.pl - n.l"),
            ("pd", "0::double", f"r.pd * {keep} + case when up_n > 0 and up_n > dn_n then up_n else 0 end"),
            ("md", "0::double", f"r.md * {keep} + case when dn_n > 0 and up_n < dn_n then dn_n else 0 end"),
            ("sp", "0::double", f"r.sp * {keep} + case when r.pv is null then 0 else greatest(n.h - n.l, abs(n.h - r.pv), abs(n.l - r.pv)) end"),
            ("pdi", "0::double", f"case when i_n > {n} and abs(sp_n) > 1e-14 then 100 * pd_n / sp_n else r.pdi end"),
            ("mdi", "0::double", f"case when i_n > {n} and abs(sp_n) > 1e-14 then 100 * md_n / sp_n else r.mdi end")]


add_recursive("plus_di_n", lambda s: {"x": s.v.plus_di_n(s.high, s.low, 4)}, _dm(4), x="case when i > 4 then pdi end")
add_recursive("minus_di_n", lambda s: {"x": s.v.minus_di_n(s.high, s.low, 4)}, _dm(4), x="case when i > 4 then mdi end")
add_recursive("adx_n", lambda s: {"x": s.v.adx_n(s.high, s.low, 4)}, [*_dm(4), ("dx", "null::double", "case when i_n > 4 and abs(sp_n) > 1e-14 and pdi_n + mdi_n > 1e-14 then 100 * abs(mdi_n - pdi_n) / (pdi_n + mdi_n) end"),
              ("adx", "0::double", "case when i_n <= 8 then r.adx + coalesce(dx_n, 0) / 4 when dx_n is null then r.adx else (r.adx * 3 + dx_n) / 4 end")], x="case when i >= 8 then adx end")
_K = "case when path > 0 then least(1.0::double, abs(v - p4) / path) else 1.0::double end"
add_recursive("kama_n", lambda s: {"x": s.v.kama_n(4)}, [("k", "null::double", f"case when n.rn = 4 then n.v when n.rn > 4 then r.k + power(({_K.replace('path', 'n.path').replace('v -', 'n.v -').replace('p4', 'n.p4')}) * (2.0::double / 3 - 2.0::double / 31) + 2.0::double / 31, 2) * (n.v - r.k) end"), ("rn2", "0::bigint", "n.rn")],
              ctes=f"c as (select *, abs(v - lag(v) over {W}) as ch, lag(v, 4) over {W} as p4 from e), d as (select *, sum(ch) over {wn(4)} as path from c)", over="d", x="case when rn2 > 4 then k end")
add_recursive("cmo_n", lambda s: {"x": s.v.cmo_n(4)}, _WILDER, x="case when ge is not null then case when ge + le < 1e-15 then 0 else 100 * (ge - le) / (ge + le) end end")
add("linearreg_slope_n", lambda s: {"x": s.v.linearreg_slope_n(N)}, ctes=_LIST, source="g", x="case when len(a) = 5 then (-2 * a[1] - a[2] + a[4] + 2 * a[5]) / 10 end")
add_recursive("ppo_n", lambda s: {"x": s.v.ppo_n(3, 6)}, [*ema("f", 3, "n.v"), *ema("w", 6, "n.v")], x="case when we is not null and fe is not null then case when we = 0 then 0 else (fe - we) / we * 100 end end")
_SRSI = [*_WILDER, ("rs", "null::double", _WRSI.replace("ge", "ge_n").replace("le ", "le_n ").replace("le)", "le_n)")), ("k", "[]::double[]", "case when rs_n is null then r.k else list_append(r.k, rs_n)[-3:] end"),
         ("fk", "null::double", "case when len(k_n) = 3 then case when list_max(k_n) > list_min(k_n) then (rs_n - list_min(k_n)) / (list_max(k_n) - list_min(k_n)) * 100 else 0 end end"), ("ks", "[]::double[]", "case when fk_n is null then r.ks else list_append(r.ks, fk_n)[-2:] end")]
add_recursive("stochrsi_n", lambda s: dict(zip(("k", "d"), s.v.stochrsi_n(4, 3, 2), strict=True)), _SRSI, k="fk", d="case when len(ks) = 2 then list_avg(ks) end")
