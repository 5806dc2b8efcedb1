"""Streams give what tables give, but for what is still open at the end."""

from pyspark.sql import functions as F

from tidewheel import operators  # noqa: F401
from tidewheel.operators.keyed import session_sum
from tidewheel.operators.windows import Ema
from tidewheel.plans import Flow
from tidewheel.plans.pattern import Pattern, match_pattern
from tidewheel.streaming import configure, stream_matches, stream_series, stream_session_sum

BASE = 1_700_000_000_000
ROWS = [(k, BASE + i * 1000 * (k + 1), i, float((i * 7 + k) % 11), "ab"[(i + k) % 3 == 0]) for k in (1, 2) for i in range(30)]
COLUMNS = "k int, ts bigint, i bigint, v double, kind string"


def _stream(spark, tmp_path, make):
    configure(spark)
    src = str(tmp_path / "in")
    spark.createDataFrame(ROWS, COLUMNS).withColumn("time", F.timestamp_millis("ts")).coalesce(1).write.parquet(src)
    raw = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = make(raw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_series(spark, tmp_path):
    got = _stream(spark, tmp_path, lambda d: stream_series(d, "k", "time", "i", ["v"], {"ema": (lambda: Ema(3), ["v"])}))
    f = Flow(spark.createDataFrame(ROWS, COLUMNS), "ts", "k", "i")
    want = f.select(ema=f.prop("v").ema(3)).select("k", "i", "ema")
    assert {(r["k"], r["i"]): r["ema"] for r in got.collect()} == {(r["k"], r["i"]): r["ema"] for r in want.collect()}


def test_sessions(spark, tmp_path):
    got = _stream(spark, tmp_path, lambda d: stream_session_sum(d.filter("i % 10 < 7"), "k", "time", "i", "v", 4000))
    want = session_sum(spark.createDataFrame(ROWS, COLUMNS).filter("i % 10 < 7"), "k", "ts", "i", "v", 4000)
    got, want = ({(r["k"], r["emit_ts"]): r["sum"] for r in d.collect()} for d in (got, want))
    still_open = {max(at for at in want if at[0] == k) for k in (1, 2)}
    assert got.items() <= want.items() and want.keys() - got.keys() <= still_open


def test_patterns(spark, tmp_path):
    p = Pattern("p").when("kind == 'b'").then("v > 5.0").within(5000)
    got = _stream(spark, tmp_path, lambda d: stream_matches(d, p, "k", "time", "i"))
    want = match_pattern(spark.createDataFrame(ROWS, COLUMNS), p, "k", "ts", "i", "i")
    assert sorted((r["k"], r["at"], r["events"]) for r in got.collect()) == sorted((r["k"], r["at"], r["events"]) for r in want.collect())
