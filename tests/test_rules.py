"""Policies and scripts: Columns against the same expressions on dictionaries, and against values worked out by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidewheel import operators  # noqa: F401
from tidewheel.functions import cel, rules as R
from tidewheel.functions.policy import Policies, PolicyError
from tidewheel.functions.script import Limits, Script, ScriptError
from tidewheel.operators import keyed as K
from tidewheel.operators.composites import GainOffset
from tidewheel.operators.trackers import PrevOfMost

POLICY = """
# who may come in
package door.main
import data.unused
default allow := false
default note = "none"
open_from := 8; open_until := 20
guests := ["ann", "bob"]
allow if { input.name in guests; daytime }
allow { input.rank > data.rank.least }
allow if not input.sealed == true
daytime if { input.hour >= open_from; input.hour < open_until }
note := "early" if { input.hour < open_from } else := "late" if { input.hour >= open_until }
deny contains "sealed # really" if input.sealed
deny[reason] { some n in data.banned; input.name == n; reason := `ban` }
refused if count(deny) > 0
fits if regex.match("^[a-z]{3}$", input.name)
near(x, y) := d if { d := abs(x - y) }
midday if near(input.hour, 12) <= 1
"""
DATA = {"rank": {"least": 5}, "banned": ["eve", "mal"]}
ROWS = [(i, *r) for i, r in enumerate(itertools.product(["ann", "eve", "Zoe", None], [3, 12, 22, None], [1, 9], [True, False, None]))]
COLUMNS = "i int, name string, hour bigint, rank bigint, sealed boolean"


def test_policy_columns_and_rows_agree(spark):
    p = Policies()
    m = p.add(POLICY)
    df = spark.createDataFrame(ROWS, COLUMNS)
    rules = [n for n in m.rules if n not in ("near", "guests")]
    nodes = {n: p.query(f"data.door.main.{n}", DATA) for n in rules}
    types = dict(df.dtypes)
    for r in df.select("*", *[cel.column_of(nodes[n], types).alias(f"p_{n}") for n in rules]).collect():
        row = {c: r[c] for c in ("name", "hour", "rank", "sealed") if r[c] is not None}
        for n in rules:
            want = cel.value_on(nodes[n], row)[0]
            assert r[f"p_{n}"] == want, (n, row)
        day = r["hour"] is not None and 8 <= r["hour"] < 20
        assert r["p_allow"] == (r["name"] == "ann" and day or r["rank"] > 5 or r["sealed"] is not True), row
        assert r["p_note"] == ("none" if r["hour"] is None else "early" if r["hour"] < 8 else "late" if r["hour"] >= 20 else "none")
        assert sorted(r["p_deny"]) == ["ban"] * (r["name"] == "eve") + ["sealed # really"] * (r["sealed"] is True)
        assert (r["p_refused"] is True) == (len(r["p_deny"]) > 0) and (r["p_fits"] is True) == (r["name"] in ("ann", "eve"))
        assert (r["p_midday"] is True) == (r["hour"] == 12)


def test_lists_in_rows(spark):
    e = R.PolicyEngine().add_policy("t", 'package t\nhit if input.tags[_] == "x"\n')
    df = spark.createDataFrame([(1, ["a", "x"]), (2, ["a"]), (3, None)], "i int, tags array<string>")
    assert [r["i"] for r in e.filter(df, "data.t.hit").collect()] == [1]


@pytest.mark.parametrize("bad", ["allow if true", "package a\nx := [y | some y in input.z]", "package a\nallow if {", "package a\nx := {\"k\": 1}", "package a\nallow if { every v in input.l { v > 1 } }", "package a\nallow if { input.x = }"])
def test_bad_policies(bad):
    with pytest.raises(PolicyError):
        Policies().add(bad)


def test_policies_that_cannot_be_answered():
    p = Policies()
    p.add("package a\none if two\ntwo if one\nthree if { some x in input.list; x > 1 }\nfour if nobody(1)")
    for name in ("one", "three", "four"):
        with pytest.raises(PolicyError):
            p.query(f"data.a.{name}", {})
    with pytest.raises(KeyError):
        p.query("data.a.none", {})


def test_policy_engine(spark, tmp_path):
    (tmp_path / "a.rego").write_text("package a\ndefault allow := false\nallow if input.v > data.least\n")
    (tmp_path / "b.json").write_text('{"small": ["v < data_least"]}')
    (tmp_path / "d.txt").write_text('{"least": 2}')
    e = R.PolicyEngine().add_policy_directory(str(tmp_path)).add_data_from_file(str(tmp_path / "d.txt")).add_data({"deep": {"x": 1}})
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v bigint")
    assert [r["v"] for r in e.filter(df, "data.a.allow").collect()] == [3]
    assert [r["v"] for r in e.filter(df, "small").collect()] == [1]
    assert e.filter_result(df, "data.a.nothing").filter("allowed or error is null").count() == 0
    assert e.filter(df, "data.a.allow", R.PolicyConfig(0)).count() == 0
    with pytest.raises(ValueError):
        R.PolicyConfig(-1)


SCRIPT = """
fn sign(x) { if x < 0 { return -1; } if x == 0 { 0 } else { 1 } }
fn twice(x) { let y = x; y += x; y }
let total = 0; // a comment with "quotes"
const most = 4;
for i in 0..most { if i != 2 { total += twice(i); } }
for k in [1, 10] { total += k * sign(v); }
if v > 100 { throw "too much"; } else if v > 50 { total = 0; }
/* nothing
   here */
let word = if v.abs() > 5 { "far" } else { "near" };
if word == "near" { return total; }
total - 1
"""


def _by_hand(v):
    sign = (v > 0) - (v < 0)
    total = sum(2 * i for i in (0, 1, 3)) + 11 * sign
    if v > 100:
        return None
    total = 0 if v > 50 else total
    return total if abs(v) <= 5 else total - 1


def test_script_columns_and_rows_agree(spark):
    e = R.ScriptEngine().compile("s", SCRIPT)
    values = [-200, -6, -5, -1, 0, 1, 5, 6, 50, 51, 100, 101, 10**9]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
    got = {r["v"]: (r["value"], r["error"]) for r in e.result(df, "s").collect()}
    node = Script(SCRIPT).node()
    for v in values:
        want = _by_hand(v)
        assert got[v] == (want, None if want is not None else "too much")
        assert cel.value_on(node, {"v": v})[0] == want
    assert got[None] == (None, "evaluation failed")


def test_scripts_mix_types_as_text(spark):
    df = spark.createDataFrame([(1,), (2,)], "v bigint")
    assert [r["value"] for r in R.ScriptEngine().map(df, 'if v == 1 { "one" } else { v }').collect()] == ["one", "2"]


def test_registered_functions(spark):
    e = R.ScriptEngine().register("valid", lambda f: f.between(2, 4), "bool").register("third", lambda f: f / 3, "num")
    df = spark.range(8).withColumnRenamed("id", "v")
    assert [r["v"] for r in e.filter(df, "let w = v + 1; valid(w) && v > 1").collect()] == [2, 3]
    assert e.map(df, "third(v) + 1.0").collect()[3][0] == 2.0
    assert e.filter_result(df, "valid(v)").filter("passed").count() == 3
    assert e.filter_result(df, "v + 1").filter("passed is null and error = 'not a bool'").count() == 8


@pytest.mark.parametrize("bad", ["while v > 1 { }", "let = 3;", "x = 3;", "if v { 1", "v +", "for i in 0..v { 1 }", "fn f(a) { a } f(1, 2)", "let a = 1 let b = 2", "1 2"])
def test_bad_scripts(bad):
    with pytest.raises(cel.CelError):
        Script(bad)


def test_script_limits():
    with pytest.raises(ScriptError, match="deeper"):
        Script("fn f(x) { f(x) } f(v)")
    grows = "let x = v;" + "x = x + x;" * 30 + "x"
    with pytest.raises(ScriptError, match="operations"):
        Script(grows)
    with pytest.raises(ScriptError, match="operations"):
        Script("let x = 0; for i in 0..9 { x += v; } x", limits=Limits(operations=20))
    with pytest.raises(ScriptError, match="operations"):
        Script("for i in 0..1000000000 { i }")


def test_script_files(spark, tmp_path):
    (tmp_path / "up.rhai").write_text("let y = v + 1;\ny")
    e = R.ScriptEngine().load_directory(str(tmp_path))
    assert [r[0] for r in e.map(spark.range(2).withColumnRenamed("id", "v"), "up").collect()] == [1, 2]


def test_checked_constructors():
    made, error = K.try_new(K.Buffer, 5)
    assert made.lateness == 5 and error is None
    made, error = K.try_new(K.Buffer, -1)
    assert made is None and isinstance(error, K.ConfigurationError) and not error.retriable
    assert K.try_new(GainOffset, 2.0, 1.0)[1] is None


def test_bounded_sub_keys():
    k = PrevOfMost(2)
    assert [k.step(0, v, s)[0] for v, s in ((1, 0.0), (2, -0.0), (3, 5.0), (4, 0.0), (5, 7.0), (6, 5.0), (7, 7.0))] == [None, 1, None, 2, None, None, 5]
