"""Series by hand: windows, ties, absence, detectors, indicators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel import operators  # noqa: F401
from tidewheel.functions.duration import dur, hours, secs
from tidewheel.operators.composites import GainOffset
from tidewheel.operators.windows import Welford
from tidewheel.plans import Count, Flow, Session, Time, over
from tidewheel.plans.pattern import Pattern, match_pattern


def flow(spark, values, ts=None, unique=False, **more):
    n = len(values)
    cols = [ts or [1000 * i for i in range(n)], list(range(n)), [None if x is None else float(x) for x in values], *more.values()]
    df = spark.createDataFrame(list(zip(*cols, strict=True)), ", ".join(["ts bigint", "i bigint", "v double", *[f"{k} double" for k in more]]))
    return Flow(df.withColumn("k", F.lit(1)), "ts", "k", "i", unique_ts=unique)


def out(f, reasons=False, **series):
    rows = f.select(reasons=reasons, **series).orderBy("i").collect()
    got = {n: [r[n] for r in rows] for n in series}
    return {**got, **({f"{n}__absent": [r[f"{n}__absent"] for r in rows] for n in series} if reasons else {})}


def test_mean_from_the_first_row(spark):
    f = flow(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert out(f, x=f.prop("v").sma(3))["x"] == [1.0, 1.5, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("unique", [True, False])
def test_time_window_includes_both_ends(spark, unique):
    v = [3.0, 8.0, -1.0, 4.5, 9.0, 2.25, 7.0]
    f = flow(spark, v, unique=unique)
    x = out(f, x=f.prop("v").sma("3s"), y=f.prop("v").sum("1s"))
    for i in range(len(v)):
        assert x["x"][i] == pytest.approx(np.mean(v[max(0, i - 3) : i + 1])) and x["y"][i] == sum(v[max(0, i - 1) : i + 1])


def test_ties_see_only_what_came_before(spark):
    f = flow(spark, [1.0, 2.0, 3.0, 4.0], ts=[0, 1000, 1000, 1000])
    x = out(f, s=f.prop("v").sum("1s"), w=f.prop("v").wma(Time("1s")), q=f.prop("v").median("1s"), lag=f.prop("v").lag("1s"))
    assert x["s"] == [1, 3, 6, 10] and x["q"] == [1, 1.5, 2, 2.5] and x["lag"] == [None, 1, 1, 1]


def test_frames_and_deques_agree(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=40).round(3).tolist()
    ops = {n: (lambda s, n=n: getattr(s, n)(Time(5000))) for n in ("sma", "sum", "count", "min", "max", "variance", "std", "median", "rank", "skewness", "kurtosis", "wma", "rsi")}
    got = []
    for unique in (True, False):
        f = flow(spark, values, unique=unique)
        v = f.prop("v", required=True)
        got.append(out(f, **{n: op(v) for n, op in ops.items()}, cov=v.covariance(v.prev(), Time(5000)), corr=v.correlation(v.cumsum(), Time(5000))))
    for n in got[0]:
        a, b = ([math.nan if y is None else y for y in g[n]] for g in got)
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9, nan_ok=True), n


def test_windows_step_over_absent_rows(spark):
    f = flow(spark, [1.0, None, 2.0, 3.0, None, 4.0])
    v = f.prop("v")
    x = out(f, reasons=True, a=v.sma(2), p=v.prev(), c=v.cumsum(), e=v.ema(2))
    assert x["a"] == [1, None, 1.5, 2.5, None, 3.5] and x["p"] == [None, None, 1, 2, None, 3] and x["c"] == [1, None, 3, 6, None, 10]
    assert x["a__absent"] == [None, "FilteredOut", None, None, "FilteredOut", None] and x["p__absent"][0] == "WarmingUp"
    assert x["e"][2] == 1.5 and x["e"][3] == pytest.approx(2.5)


def test_reasons(spark):
    f = flow(spark, [1.0, 1.0, -4.0, 0.0], ts=[0, 0, 1000, 2000])
    v = f.prop("v")
    x = out(f, reasons=True, z=v.zscore(2), r=v.rate(), lr=v.log_return(), s=v.sqrt(), p=v.pct_change(), d=(v + 1).divide_safe(v - 1), pair=v.filter(lambda c: c > 5).divide_safe(v.filter(lambda c: c < 0)))
    assert x["z__absent"][:2] == ["WarmingUp", "DivideByZero"] and x["r__absent"][:2] == ["WarmingUp", "ZeroTimeDelta"] and x["r"][2] == -5.0
    assert x["lr__absent"] == ["WarmingUp", None, "DomainError", "DomainError"] and x["s__absent"][2] == "DomainError" and x["d__absent"][0] == "DivideByZero"
    assert x["pair__absent"] == ["FilteredOut"] * 4


def test_ieee_arithmetic(spark):
    f = flow(spark, [1.0, 0.0, -1.0, float("nan")])
    v = f.prop("v")
    x = out(f, d=v / 0.0, g=v.gt(0), m=v.max(3), c=v.clamp(-0.5, 0.5), r=(v * 2.5).round())
    assert x["d"][0] == math.inf and math.isnan(x["d"][1]) and x["d"][2] == -math.inf and math.isnan(x["d"][3])
    assert x["g"] == [1, 0, 0, 0] and x["m"] == [1, 1, 1, 0] and x["c"][:3] == [0.5, 0, -0.5] and math.isnan(x["c"][3]) and x["r"][:3] == [3, 0, -3]


def test_detectors(spark):
    f = flow(spark, [0.0, 6, 6, 0, 12, 0, 6, 0])
    v = f.prop("v")
    peak = v.runt_detect(5, 10)
    pulse = v.pulse_width(5, 1500, 3000)
    x = out(f, c=v.cross(5), g=v.glitch_filter(5, 2000), m=peak[0], p=peak[1], w=pulse[0], ms=pulse[1], z=v.window_detect(5, 10))
    assert x["c"] == ["None", "Rising", "None", "Falling", "Rising", "Falling", "Rising", "Falling"]
    assert x["g"][3] == "ValidPulse" and x["g"][5] == "Rejected" and x["g"][0] == "NoTransition"
    assert x["m"] == [None, None, None, "Runt", None, "ValidPulse", None, "Runt"] and x["p"][3] == 6 and x["p"][5] == 12
    assert x["w"][3] == "Valid" and x["ms"][3] == 2000 and x["w"][5] == "TooShort"
    assert x["z"] == [None, "EnteredWindow", None, "ExitedLow", None, None, "EnteredWindow", "ExitedLow"]


def test_hysteresis(spark):
    f = flow(spark, [0.0, 10, 11, 10, 9, 8, 11])
    x = out(f, a=f.prop("v").cross_hysteresis(10, 1), b=f.prop("v").cross_hysteresis(10, 0))
    assert x["a"] == ["None", "None", "Rising", "None", "Falling", "None", "Rising"]
    assert x["b"] == ["None", "Rising", "None", "Falling", "None", "None", "Rising"]


def test_indicators_by_formula(spark):
    rng = np.random.default_rng(2)
    c = (100 + rng.normal(size=60).cumsum()).tolist()
    f = flow(spark, c, high=[x * 1.01 for x in c], low=[x * 0.99 for x in c])
    v, h, lo = f.prop("v"), f.prop("high"), f.prop("low")
    x = out(f, kama=v.kama_n(10), t=v.trima(10), adx=v.adx_n(h, lo, 14), macd=v.macd_n(12, 26, 9)[0], s=v.stochrsi_n(14, 3, 3)[1], slope=v.linearreg_slope_n(14), atr=v.atr_wilder_n(h, lo, 14))
    first = {n: next(i for i, y in enumerate(ys) if y is not None) for n, ys in x.items()}
    assert first == {"kama": 10, "t": 9, "adx": 27, "macd": 33, "s": 18, "slope": 13, "atr": 14}
    a = np.array(c)
    assert x["slope"][-1] == pytest.approx(np.polyfit(range(14), a[-14:], 1)[0])
    assert x["t"][-1] == pytest.approx((a[-10:] * np.array([1, 2, 3, 4, 5, 5, 4, 3, 2, 1])).sum() / 30)


def test_small_things(spark):
    assert dur("5s") == 5000 and dur(-3) == 0 and secs(2) == 2000 and hours(1) == dur("1h")
    with pytest.raises(ValueError):
        flow(spark, [1.0]).prop("v").sma(Session("1s"))
    with pytest.raises(ValueError):
        Flow(spark.range(1), "id")
    assert Count(0).n == 1
    g = GainOffset.from_two_points(1, 5, 1, 9)
    assert (g.gain, g.offset) == (0.0, 5)
    w, z = Welford(), Welford()
    for y in (1.0, 2.0, 4.0):
        w.push(y)
    for y in (3.0, 9.0):
        z.push(y)
    m = w.merge(z)
    assert m.variance() == pytest.approx(np.var([1, 2, 4, 3, 9])) and m.sample_variance() == pytest.approx(np.var([1, 2, 4, 3, 9], ddof=1))
    m.remove(9.0)
    assert m.variance() == pytest.approx(np.var([1, 2, 4, 3]))


def test_long_windows_by_running_sums(spark, monkeypatch):
    monkeypatch.setattr(operators.windows, "LONG", 3)
    values = [1.0, 2.0, float("nan"), 4.0, 5.0, 6.0, float("inf"), 8.0, 9.0, 10.0]
    f = flow(spark, values)
    x = out(f, reasons=True, s=f.prop("v", required=True).sum(3), m=f.prop("v", required=True).sma(3))
    assert x["s"] == [1, 3, None, None, None, 15, None, None, None, 27] and x["m"][5] == 5 and x["m"][-1] == 9
    assert x["s__absent"][2] == "WarmingUp"


def test_slices(spark):
    rng = np.random.default_rng(4)
    f = flow(spark, rng.normal(size=200).tolist(), unique=True)
    v = f.prop("v", required=True)
    z = v.zscore(Time(7000))
    whole = [r["z"] for r in f.select(z=z).orderBy("i").collect()]
    cut = [r["z"] for r in f.select_sliced(20_000, z=z).orderBy("i").collect()]
    assert [y is None for y in cut] == [y is None for y in whole]
    assert [y or 0.0 for y in cut] == pytest.approx([y or 0.0 for y in whole], abs=1e-9)
    with pytest.raises(ValueError, match="whole past"):
        f.select_sliced(1000, x=v.cumsum())
    with pytest.raises(ValueError, match="named like columns"):
        f.select(v=v)


def test_snapshots_belong_to_their_graph(spark):
    from tidewheel.operators.resume import run_resumable
    from tidewheel.operators.windows import Ema

    df = spark.createDataFrame([(1, i, i, float(i)) for i in range(6)], "k int, ts bigint, i bigint, v double")
    _, states = run_resumable(df.filter("i < 3"), "k", "ts", "i", "v", lambda: Ema(2), "a")
    later, again = run_resumable(df.filter("i >= 3"), "k", "ts", "i", "v", lambda: Ema(2), "a", states)
    whole, end = run_resumable(df, "k", "ts", "i", "v", lambda: Ema(2), "a")
    assert sorted(map(tuple, later.collect())) == sorted(map(tuple, whole.filter("i >= 3").collect())) and again.collect() == end.collect()
    with pytest.raises(Exception, match="another graph"):
        run_resumable(df, "k", "ts", "i", "v", lambda: Ema(2), "b", states)[0].collect()


def test_time_windows_over_ties_by_brute_force(spark):
    rng = np.random.default_rng(8)
    n, length = 80, 5000
    ts = np.sort(rng.integers(0, 30, n) * 1000).tolist()
    v, y = rng.normal(size=n).round(3).tolist(), rng.normal(size=n).round(3).tolist()
    f = flow(spark, v, ts=ts, y=y)
    x, z = f.prop("v"), f.prop("y")
    w = over(length)
    got = out(f, sma=x.sma(w), sum=x.sum(w), count=x.count(w), min=x.min(w), max=x.max(w), var=x.variance(w), q=x.quantile(w, 0.3), skew=x.skewness(w), kurt=x.kurtosis(w), cov=x.covariance(z, w), corr=x.correlation(z, w), rank=x.rank(w), lag=x.lag(length), none=x.sum(over(0)), acc=x.acceleration())
    velocity = ts0 = v0 = None
    for i in range(n):
        held = [j for j in range(i + 1) if ts[j] >= ts[i] - length]
        a, b = np.array([v[j] for j in held]), np.array([y[j] for j in held])
        m = a - a.mean()
        want = {"sma": a.mean(), "sum": a.sum(), "count": len(a), "min": a.min(), "max": a.max(), "var": a.var() if len(a) > 1 else None, "q": np.quantile(a, 0.3), "cov": ((a - a.mean()) * (b - b.mean())).mean() if len(a) > 1 else None, "rank": (a < a[-1]).sum() / max(len(a) - 1, 1), "none": sum(v[j] for j in held if ts[j] == ts[i])}
        if len(a) > 3:
            want |= {"skew": (m**3).mean() / a.std() ** 3, "kurt": (m**4).mean() / a.var() ** 2 - 3, "corr": np.corrcoef(a, b)[0, 1]}
        older = [j for j in range(n) if ts[j] <= ts[i] - length]
        want["lag"] = v[older[-1]] if older else None
        want["acc"] = None
        if ts0 is not None and ts[i] > ts0:
            now = (v[i] - v0) / (ts[i] - ts0) * 1000
            want["acc"] = None if velocity is None else (now - velocity) / (ts[i] - ts0) * 1000
            velocity = now
        ts0, v0 = ts[i], v[i]
        for name, value in want.items():
            assert got[name][i] is None if value is None else got[name][i] == pytest.approx(value, abs=1e-9), (name, i)


def test_long_sums_hold_nothing_from_outside(spark):
    n = operators.windows.LONG
    v = [1e17] + [0.1 * (i % 7) for i in range(3 * n)]
    f = flow(spark, v)
    x = out(f, s=f.prop("v", required=True).sum(n), m=f.prop("v", required=True).sma(n))
    for i in range(n, len(v), 37):
        assert x["s"][i] == pytest.approx(math.fsum(v[i - n + 1 : i + 1]), rel=1e-12) and x["m"][i] == pytest.approx(math.fsum(v[i - n + 1 : i + 1]) / n, rel=1e-12)


def test_open_matches_are_not_dropped(spark):
    rows = [(1, i, i, "a" if i < 2000 else "b") for i in range(2001)]
    d = spark.createDataFrame(rows, "k int, ts bigint, i bigint, kind string")
    p = Pattern("p").when("kind == 'a'").then("kind == 'b'")
    for shapes in (True, False):
        assert match_pattern(d, p, "k", "ts", "i", "i", shapes).count() == 2000
    capped = match_pattern(d, p, "k", "ts", "i", "i", max_in_flight=100).groupBy("dropped").count().collect()
    assert {r["dropped"]: r["count"] for r in capped} == {None: 100, "MaxInFlight": 1900}


def _equal_then_moving(spark):
    v = [2.5, 2.5, 2.5, 2.5, 3.0, 4.0, 4.0, 4.0]
    f = flow(spark, v, unique=True, y=[1.0, 2.0, 3.0, 4.0, 5.0, 7.0, 7.0, 7.0])
    return f.prop("v", required=True), f.prop("y", required=True), [None, None, None, None, 0.866025, 1.0, 1.0, None]


def test_correlation_of_equal_values_is_absent(spark):
    v, y, want = _equal_then_moving(spark)
    got = out(v.flow, x=v.correlation(y, Count(3)))["x"]
    assert [g if g is None else round(g, 6) for g in got] == want


def test_correlation_over_time_of_equal_values_is_absent(spark):
    v, y, want = _equal_then_moving(spark)
    got = out(v.flow, x=v.correlation(y, Time("2s")))["x"]
    assert [g if g is None else round(g, 6) for g in got] == want


def _plan(f, **series):
    return f.select(keep=["i"], **series)._jdf.queryExecution().executedPlan().toString()


def test_weighted_means_list_a_window_once(spark):
    f = flow(spark, [1.0, 2.0, 4.0], ts=[0, 1000, 4000], unique=True)
    v = f.prop("v", required=True)
    assert _plan(f, x=v.wma(Time("5s"))).count("collect_list(") == 2  # times and values
    w = [0.001, 0.251, 1.001]
    assert out(f, x=v.wma(Time("5s")))["x"][2] == pytest.approx((w[0] + 2 * w[1] + 4 * w[2]) / sum(w))


def test_windows_over_ties_sort_once_before_lists(spark):
    f = flow(spark, [3.0, 1.0, 2.0, 5.0], ts=[0, 1000, 1000, 4000])
    v = f.prop("v", required=True)
    plan = _plan(f, m=v.median("5s"), r=v.rank("5s"), s=v.sma("5s"))
    assert plan.count("Sort [") == 1 and plan.count("collect_list(") == 2  # of earlier times, and of ties
    assert out(f, m=v.median("5s"))["m"] == [3.0, 2.0, 2.0, 2.5]
