"""Policies, combinators, patterns, rules, sinks and state by hand."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import cel
from tidewheel.functions.json_api import compute_json, tumbling_json
from tidewheel.functions.rules import Rule, RuleEngine
from tidewheel.operators import combinators as C, keyed as K
from tidewheel.plans.pattern import Matcher, Pattern, PatternError, Step, match_pattern
from tidewheel.sources import state as S
from tidewheel.sources.brokers import KafkaOffset, SeenPackets, kafka_options
from tidewheel.sources.files import read_batches, schema_fingerprint, write_batches
from tidewheel.sources.influx import Batcher, line_protocol


@settings(max_examples=60, deadline=None)
@given(st.permutations(list(range(12))), st.integers(0, 20))
def test_reorder_buffer(order, lateness):
    b, out = K.ReorderBuffer(lateness), []
    for t in order:
        out += [ts for ts, _ in b.step(t, t)]
    out += [ts for ts, _ in b.flush()]
    assert out == sorted(out) and len(out) + len(b.take_late()) == 12
    if lateness >= 12:
        assert out == list(range(12))


def test_behind_the_watermark_but_ahead_of_the_frontier():
    b = K.ReorderBuffer(10)
    assert b.step(100, "a") == [] and b.step(120, "b") == [(100, "a")]
    assert b.step(105, "c") == [(105, "c")]  # older than 120 - 10, newer than the last released
    assert b.step(104, "d") == [] and b.take_late() == [(104, "d")]
    with pytest.raises(K.NonMonotonicWatermark):
        b.advance_watermark(5) and b.advance_watermark(1)
        b.advance_watermark(1)


def test_timers():
    t = K.Timers()
    for ts, n in ((5, "a"), (3, "b"), (5, "c"), (9, "d")):
        t.register(ts, n)
    t.delete(5, "c")
    assert t.advance(5) == [(3, "b"), (5, "a")] and t.advance(8) == []
    with pytest.raises(K.NonMonotonicWatermark):
        t.advance(7)


def test_policy_bounds():
    with pytest.raises(K.ConfigurationError):
        K.Buffer(25 * 3_600_000)


def test_pulse_times_out_and_reopens(spark):
    df = spark.createDataFrame([(1, t, t, v) for t, v in ((0, 1.0), (5, 1.0), (20, 1.0), (22, 0.0))], "k int, ts bigint, i bigint, v double")
    got = K.pulse_width_keyed(df, "k", "ts", "i", "v", 0.5, 1, 10).collect()
    assert [tuple(r)[1:] for r in got] == [(11, "TooLong", 10), (22, "Valid", 2)]


def test_session_closes_at_exactly_the_gap(spark):
    df = spark.createDataFrame([("a", t, t, 1.0) for t in (0, 4, 9, 14)], "k string, ts bigint, i bigint, v double")
    assert sorted(tuple(r)[1:] for r in K.session_sum(df, "k", "ts", "i", "v", 5).collect()) == [(9, 2.0), (14, 1.0), (19, 1.0)]
    t = K.tumbling_sum(df.withColumn("ts", F.col("ts") - 500), "k", "ts", "v", 1000).collect()
    assert [tuple(r)[1:] for r in t] == [(1000, 4.0)]  # towards zero


def test_validation(spark):
    rows = [(1, t, i, v) for i, (t, v) in enumerate([(0, 1.0), (5, float("nan")), (4, 1.0), (6, float("inf")), (7, -1.0), (90, 2.0), (8, 3.0)])]
    df = spark.createDataFrame(rows, "k int, ts bigint, i bigint, v double")
    o = K.ValidationOptions(assert_sorted=True, max_gap_ms=50, reject_nan=True, error_on_inf=True, error_on_negative=True)
    got = {r["i"]: (r["status"], r["problem"]) for r in K.validated(df, "k", "ts", "i", "i", "v", o).collect()}
    assert got == {0: ("ok", None), 1: ("rejected", "NaN"), 2: ("error", "not sorted"), 3: ("error", "infinite"), 4: ("error", "negative"), 5: ("error", "gap"), 6: ("ok", None)}


def test_window_join_keeps_the_left(spark):
    left = spark.createDataFrame([(1, 100), (2, 500)], "id int, ts bigint")
    right = spark.createDataFrame([(90, "a"), (110, "b"), (111, "c")], "rts bigint, n string")
    got = {r["id"]: [m["n"] for m in r["matches"]] for r in C.window_join(left, right, "id", "ts", "rts", 10, ["n"]).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_keep_last(spark):
    df = spark.createDataFrame([(1, t, t) for t in (0, 1, 5, 11, 12, 30)], "k int, ts bigint, i bigint")
    assert sorted(r["ts"] for r in C.rate_limit_keep_last(df, "ts", "i", 10, "k").collect()) == [0, 5, 12, 30]
    assert sorted(r["ts"] for r in C.rate_limit(df, "ts", "i", 10).collect()) == [0, 11, 30]


def _events(spark, rows):
    return spark.createDataFrame([(1, i, t, kind, card, amount) for i, (t, kind, card, amount) in enumerate(rows)], "k int, i bigint, ts bigint, kind string, card string, amount bigint")


@pytest.mark.parametrize("shapes", [True, False])
@pytest.mark.parametrize(("spec", "rows", "times"), [
    ({"when": "kind == 'open'", "notThen": "kind == 'shut'", "within": 400}, [(10, "open", "", 0), (90, "knock", "", 0), (411, "knock", "", 0)], [10]),
    ({"when": "kind == 'open'", "notThen": "kind == 'shut'", "within": 400}, [(10, "open", "", 0), (410, "shut", "", 0)], []),
    ({"when": "kind == 'open'", "notThen": "kind == 'shut'", "within": 400}, [(10, "open", "", 0), (411, "shut", "", 0)], [10]),
    ({"when": "kind == 'lift'", "then": ["kind == 'drop' && card == first_card"], "within": 700}, [(0, "lift", "left", 0), (50, "drop", "right", 0), (60, "drop", "left", 0), (70, "lift", "right", 0), (771, "drop", "right", 0)], [60]),
    ({"when": "kind == 'weigh' && amount >= 31"}, [(0, "weigh", "", 30), (4, "weigh", "", 31), (5, "lift", "", 99)], [4]),
])
def test_specs(spark, spec, rows, times, shapes):
    m = match_pattern(_events(spark, rows), Pattern.from_spec({"name": "x", **spec}), "k", "ts", "i", "i", shapes).collect()
    assert [r["times"][-1] for r in m] == times


def test_shapes_and_matcher_agree(spark):
    import random

    rnd = random.Random(5)
    df = _events(spark, [(t * 10, rnd.choice("abcd"), "", 0) for t in range(200)]).withColumn("k", F.col("i") % 3)
    a, b, c = (f"kind == '{x}'" for x in "abc")
    for p in (Pattern().when(a), Pattern().when(a).then(b), Pattern().when(a).then(b).within(40), Pattern().when(a).not_then(b).within(40), Pattern().when(a).not_between(c).then(b), Pattern().when(a).next().then(b), Pattern().when(a).not_between(c).then(b).within(60)):
        one, two = (sorted((r["k"], r["at"], r["events"]) for r in match_pattern(df, p, "k", "ts", "i", "i", s).collect()) for s in (True, False))
        assert one == two, p


def _run(steps, events, most=1024):
    m = Matcher(steps, lambda step, slot, e, caps: e in (steps[step].pred if slot < 0 else steps[step].guards[slot]), most)
    done = [x for t, e in events for x in m.push(t, e)]
    return [[c[2] for c in caps] for _, caps in done + m.flush()], m


def test_repeats():
    steps = [Step("when", "s0", "a"), Step("then", "s1", "b", least=2, most=3), Step("then", "s2", "c")]
    assert _run(steps, enumerate("abbc"))[0] == [["a", "b", "b", "c"]] and _run(steps, enumerate("abc"))[0] == []
    assert _run(steps, enumerate("abbbbc"))[0] == [["a", "b", "b", "b", "c"]]
    tail = [Step("when", "s0", "a"), Step("then", "s1", "b", least=1, most=9)]
    assert _run(tail, enumerate("abb"))[0] == [["a", "b", "b"]]
    assert _run([Step("when", "s0", "a"), Step("then", "s1", "z")], enumerate("aaaa"), most=2)[1].dropped["MaxInFlight"] == 2


def test_bad_patterns():
    with pytest.raises(PatternError, match="NoWhenStep"):
        Pattern().then("true").check()
    with pytest.raises(PatternError, match="NotThenMissingWithin"):
        Pattern().when("true").not_then("true").check()
    with pytest.raises(PatternError, match="NotThenNotTerminal"):
        Pattern().when("true").not_then("true").within(1).then("true").check()
    with pytest.raises(PatternError, match="CelCompile"):
        Pattern().when("a ==").check()


@pytest.mark.parametrize(("text", "want"), [
    ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2.0", 3.5), ("7 % 4", 3), ("'a' + 'b'", "ab"), ("x > 3 ? 'hi' : 'lo'", "hi"), ("x in [1, 5]", True), ("!(x == 5) || s.startsWith('he')", True),
    ("missing == 1", None), ("missing == 1 || true", True), ("missing == 1 && false", False), ("has(missing)", False), ("has(x)", True), ("size(s)", 5), ("s.matches('^h.*o$')", True), ("1 / 0", None), ("x == 'five'", False), ("int('12') + 1", 13), ("min(x, 3)", 3), ("y > 2.4", True),
])
def test_rule_language(spark, text, want):
    df = spark.createDataFrame([(5, 2.5, "hello")], "x bigint, y double, s string")
    assert df.select(cel.to_column(text, dict(df.dtypes)).alias("v")).first()[0] == want
    assert cel.value_on(cel.parse(text), {"x": 5, "y": 2.5, "s": "hello"})[0] == want


def test_rule_limits():
    for bad in ("(" * 40 + "1" + ")" * 40, "1" * 1025, "a b", "'open", "f(1"):
        with pytest.raises(cel.CelError):
            cel.parse(bad)


def test_rule_order(spark):
    e = RuleEngine([Rule("last", "true"), Rule("two", "true", priority=2), Rule("one", "true", priority=1), Rule("off", "true", enabled=False)])
    df = spark.range(1)
    assert [r["rule"] for r in e.evaluate(df).first()["rules"]] == ["one", "two", "last"] and e.evaluate_first(df).first()["rule"]["rule"] == "one"


def test_line_protocol(spark):
    df = spark.createDataFrame([("a b", None, 'say "hi"\n', 3, 1.5, True), ("", "x=1", None, None, float("nan"), None)], "t string, u string, s string, i bigint, d double, b boolean")
    got = [r[0] for r in df.select(line_protocol(df, "m,1", ["u", "t"], ["s", "i", "d", "b"], F.lit(7))).collect()]
    assert got == ['m\\,1,t=a\\ b s="say \\"hi\\"\\n",i=3i,d=1.5,b=true 7', None]


def test_batcher():
    sent, now = [], [0.0]
    b = Batcher(sent.append, max_lines=2, max_age_s=5, hard_bytes=10, clock=lambda: now[0])
    b.push("aaaa"), b.push("bbbb"), b.push("cc"), b.tick()
    now[0] = 6.0
    b.tick(), b.push("x" * 20)
    assert sent == ["aaaa\nbbbb\n", "cc\n"] and b.dropped == 1


def test_state(tmp_path):
    from tidewheel.operators.windows import Ema

    a = Ema(2)
    for v in (1.0, 3.0, 5.0):
        a.step(0, v)
    snap = S.take_snapshot("k", 5, S.graph_fingerprint("ema"), [a])
    store, cursors = S.FileStateStore(str(tmp_path / "s")), S.FileStateStore(str(tmp_path / "c"))
    c = S.Checkpointer(store, cursors, S.Policy(every_n=2))
    assert not c.record() and c.record()
    c.commit("k/1", snap, KafkaOffset.after("t", 0, 41).to_bytes())
    back = S.Snapshot.from_bytes(store.get("k/1"))
    b = S.restore_snapshot(back, S.graph_fingerprint("ema"), [Ema(2)])[0]
    assert b.step(0, 7.0) == a.step(0, 7.0) and KafkaOffset.from_bytes(cursors.get("k/1")).display() == "t[0]@42" and store.keys() == ["k/1"]
    with pytest.raises(ValueError):
        S.restore_snapshot(back, "other", [Ema(2)])
    d = S.Deduplicator(store, "n")
    assert d.should_emit("x") and (d.mark_emitted("x") or not d.should_emit("x"))
    p = S.ProjectionStore()
    p.put("a", 1), p.restore(p.snapshot())
    assert p.entries() == [("a", 1)] and len(p) == 1 and p.remove("a") == 1
    s = S.RebalancedShard(4, {0, 1, 2, 3})
    assert s.owns("z") and s.apply_rebalance(set(), 1) and not s.owns("z") and not s.apply_rebalance({0}, 1)


def test_failing_commits_open_the_circuit(tmp_path):
    class Broken(S.FileStateStore):
        def put(self, key, raw):
            raise OSError("full")

    c = S.Checkpointer(Broken(str(tmp_path)), S.FileStateStore(str(tmp_path)), S.Policy(), threshold=2)
    snap = S.Snapshot("k", 0, "f", b"")
    for error in (OSError, OSError, RuntimeError):
        with pytest.raises(error):
            c.commit("k", snap, b"")


def test_brokers():
    seen = SeenPackets(2)
    assert [seen.first(i) for i in (1, 1, 2, 3, 1)] == [True, False, True, True, True]
    assert kafka_options("h:1", ["a", "b"], "g")["subscribe"] == "a,b"
    with pytest.raises(ValueError):
        kafka_options("", [])


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    write_batches(df, str(tmp_path / "t"))
    back = read_batches(spark, str(tmp_path / "t"))
    assert back.collect() == df.collect() and schema_fingerprint(back.schema) == schema_fingerprint(df.schema) != schema_fingerprint(df.select("x").schema)


def test_json(spark):
    rows = json.dumps([{"ts": i * 1000, "value": i} for i in range(1, 4)])
    assert [r["sma"] for r in json.loads(compute_json(spark, rows, '{"indicator": "sma", "period": 2}'))] == [1.0, 1.5, 2.5]
    assert json.loads(tumbling_json(spark, rows, '{"sizeMs": 2000}')) == [{"windowStart": 0, "windowEnd": 2000, "count": 1, "sum": 1.0}, {"windowStart": 2000, "windowEnd": 4000, "count": 2, "sum": 5.0}]


def test_observed(spark):
    from tidewheel.functions.metrics import observed

    df, seen = observed(spark.range(5).withColumn("t", F.col("id") * 10), "t")
    assert df.count() == 5 and seen.get == {"records": 5, "first": 0, "last": 40}


def test_dedupe_waits_from_the_last_kept(spark):
    df = spark.createDataFrame([("a", t, t) for t in (0, 6, 11, 16, 22)], "k string, ts bigint, i bigint")
    assert sorted(r["ts"] for r in C.dedupe_by_key(df, "k", "ts", "i", 10).collect()) == [0, 11, 22]


def test_batches_split_by_disorder(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 5, 12, 3, 14))], "k int, i bigint, ts bigint")
    got = [(r["bucket"], [x["ts"] for x in r["items"]]) for r in C.batch_by_time(df, "k", "ts", "i", 10, ["ts"]).orderBy("batch").collect()]
    assert got == [(0, [0, 5]), (10, [12]), (0, [3]), (10, [14])]


def test_window_totals_by_brute_force(spark):
    left = spark.createDataFrame([(i, t) for i, t in enumerate([0, 9, 10, 10, 20, -7, 400, None])], "id int, ts int")
    times = [-17, -10, 0, 0, 1, 9, 19, 20, 21, 30, 31, 410, 411, None]
    right = spark.createDataFrame([(t, None if i == 4 else 2**i) for i, t in enumerate(times)], "rts bigint, `a.b` bigint")
    for w in (0, 1, 10):
        got = {r["id"]: (r["ts"], r["n"], r["s"]) for r in C.window_totals(left, right, "ts", "rts", w, {"s": "a.b"}).collect()}
        near = {r["id"]: [i for i, t in enumerate(times) if None not in (t, r["ts"]) and abs(t - r["ts"]) <= w] for r in left.collect()}
        assert got == {r["id"]: (r["ts"], len(near[r["id"]]), sum(2**i for i in near[r["id"]] if i != 4)) for r in left.collect()}


def test_window_join_shuffles_no_pairs(spark):
    left, right = (spark.range(300).select(F.col("id"), (F.col("id") % 3).alias(t)) for t in ("ts", "rts"))
    joined = C.window_join(left, right.withColumnRenamed("id", "n"), "id", "ts", "rts", 10, ["n"])
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert all([m["n"] for m in r["matches"]] == sorted(range(300), key=lambda n: (n % 3, n)) for r in joined.collect())
