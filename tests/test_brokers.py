"""Sources and sinks of brokers against made-up clients: nothing is lost by a restart, nothing read twice."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewheel import operators  # noqa: F401
from tidewheel.functions import samples as P
from tidewheel.functions.json_api import detect_cross_json, evaluate_rules_json
from tidewheel.plans import Flow
from tidewheel.sources import brokers as B
from tidewheel.sources.state import FileStateStore, RebalancedShard


def test_message_log_survives_a_torn_line(tmp_path):
    log = B.MessageLog(str(tmp_path), per_file=3)
    for i in range(8):
        log.append("t", bytes([i]), 1, False, i)
    newest = sorted(tmp_path.glob("*.log"))[-1]
    with newest.open("ab") as f:
        f.write(b'["t", "torn')
    again = B.MessageLog(str(tmp_path), per_file=3)
    assert (again.begin, again.end) == (0, 8)
    assert [m[1] for m in again.read(2, 7)] == [bytes([i]) for i in range(2, 7)]
    again.append("t", b"x", 0, True, 9)
    again.commit(7)
    assert again.begin == 6 and [m[1] for m in again.read(6, 9)] == [b"\x06", b"\x07", b"x"]
    with pytest.raises(ValueError):
        list(again.read(0, 9))


def test_packets_used_again_are_new_messages():
    seen = B.SeenPackets()
    assert [seen.is_new(p, again) for p, again in ((7, False), (7, True), (7, False), (8, True), (8, True))] == [True, False, True, True, False]


def _incoming(folder: str):
    """A client that hands out the messages of a file once, at the time it connects."""
    def connect(options, on_message=None):
        import types as t
        from pathlib import Path as P

        path = P(folder) / "incoming.json"
        rows = json.loads(path.read_text())
        path.write_text("[]")
        for mid, text, dup in rows:
            on_message(t.SimpleNamespace(topic="room/1", payload=text.encode(), qos=2, retain=False, mid=mid, dup=dup))

    return connect


def test_mqtt_source_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(B.mqtt_source(_incoming(str(tmp_path))))

    def run(rows: list) -> None:
        (tmp_path / "incoming.json").write_text(json.dumps(rows))
        raw = spark.readStream.format("mqtt").option("host", "h").option("topic", "room/+").option("log", str(tmp_path / "log")).option("batch", "2").load()
        q = raw.select(F.col("payload").cast("string").alias("text")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run([(1, "a", False), (1, "a", True), (2, "b", False), (1, "c", False), (3, "d", False), (4, "e", False)])
    run([(1, "f", False), (2, "g", False)])
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list("abcdefg")


def test_mqtt_source_wants_its_options(spark):
    source = B.mqtt_source()
    with pytest.raises(ValueError, match="log"):
        source({"host": "h", "topic": "t"}).simpleStreamReader(None)


def test_mqtt_sink_publishes_every_row(spark, tmp_path):
    folder = str(tmp_path)

    def connect(options, on_message=None):
        import types as t
        import uuid
        from pathlib import Path as P

        def publish(topic, payload, qos, retain):
            (P(folder) / f"{uuid.uuid4().hex}.sent").write_text(f"{topic} {payload.decode()} {qos} {retain}")
            return t.SimpleNamespace(wait_for_publish=lambda: None)

        return t.SimpleNamespace(publish=publish, disconnect=lambda: None, loop_stop=lambda: None)

    spark.dataSource.register(B.mqtt_source(connect))
    df = spark.range(7).select(F.lit("out").alias("topic"), F.col("id").cast("string").cast("binary").alias("payload"), (F.col("id") == 3).alias("retain"))
    df.write.format("mqtt").option("host", "h").option("qos", "1").mode("append").save()
    assert sorted(p.read_text() for p in Path(folder).glob("*.sent")) == [f"out {i} 1 {i == 3}" for i in range(7)]


def test_kafka_offsets_outlive_the_run(spark, tmp_path):
    store = B.CursorStore(FileStateStore(str(tmp_path)), "g")
    rows = [("k", "v", "a", p, o, 0) for p in (0, 1) for o in range(5 + p)]
    batch = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint, at int")
    handled = []
    B.committing(store, lambda d, n: handled.append(d.count()))(batch, 0)
    assert handled == [11] and B.starting_offsets(store.all()) == '{"a": {"0": 5, "1": 6}}'
    store.commit([B.KafkaOffset("a", 0, 2)])
    assert store.get("a", 0).offset == 5
    with pytest.raises(ZeroDivisionError):
        B.committing(store, lambda d, n: 1 / 0)(batch.withColumn("offset", F.col("offset") + 100), 1)
    assert store.get("a", 1).offset == 6
    shard = RebalancedShard(4, {0})
    assert [c.display() for c in B.rebalance(shard, store, "a", {1, 2}, 1)] == ["a[1]@6", "a[2]@0"]
    assert B.rebalance(shard, store, "a", {0}, 1) == []


def test_kafka_columns(spark):
    raw = spark.createDataFrame([(b"k", None, "a", 0, 3, 1_000)], "key binary, value binary, topic string, partition int, offset bigint, ms bigint").withColumn("timestamp", F.timestamp_millis("ms"))
    r = B.from_kafka(raw).first()
    assert (bytes(r["key"]), r["payload"], r["offset"], r["ts_ms"]) == (b"k", None, 3, 1000)
    out = B.to_kafka(spark.createDataFrame([("x", 1)], "s string, n int"), F.col("s"), F.to_json(F.struct("s", "n"))).first()
    assert bytes(out["key"]) == b"x" and json.loads(bytes(out["value"])) == {"s": "x", "n": 1}


@pytest.mark.parametrize("cursor", [B.KafkaOffset("t", 1, 9), B.MqttCursor(12)])
def test_cursors_round_trip(cursor):
    assert type(cursor).from_bytes(cursor.to_bytes()) == cursor and str(cursor.display())


def test_samplers_say_what_tables_say(spark):
    rng = random.Random(3)
    rows = [(i, i * 1000, rng.choice([None, 1.0, 4.0, 5.0, 6.0, 9.0, 12.0])) for i in range(300)]
    f = Flow(spark.createDataFrame(rows, "i bigint, ts bigint, v double"), "ts", order="i")
    v = f.prop("v")
    out = f.select(cross=v.cross(5.0), hyst=v.cross_hysteresis(5.0, 1.0), glitch=v.glitch_filter(5.0, 2000), runt=v.runt_detect(5.0, 9.0)[0], pulse=v.pulse_width(5.0, 2000, 4000)[0], window=v.window_detect(4.0, 9.0)).orderBy("i").collect()
    made = {"cross": (P.CrossSampler(), "vh"), "hyst": (P.HysteresisSampler(1.0), "vh"), "glitch": (P.GlitchSampler(5.0, 2000), "vt"), "runt": (P.RuntSampler(5.0, 9.0), "v"), "pulse": (P.PulseWidthSampler(5.0, 2000, 4000), "vt"), "window": (P.WindowSampler(4.0, 9.0), "v")}
    word = {None: "none", "None": "none", "NoTransition": "none", "Rising": "rising", "Falling": "falling", "ValidPulse": "valid", "Rejected": "glitch", "Runt": "runt", "TooShort": "short", "Valid": "valid", "TooLong": "long", "EnteredWindow": "entered", "ExitedLow": "exitedLow", "ExitedHigh": "exitedHigh"}
    for name, (d, takes) in made.items():
        for _ in range(2):
            said = [d.update(*[{"v": v, "h": 5.0, "t": ts}[c] for c in takes]) for _, ts, v in rows]
            assert said == [word[r[name]] for r in out], name
            assert len(set(said)) > 1
            d.reset()


def test_json_of_crossings_and_rules(spark):
    rows = json.dumps([{"ts": i, "value": v} for i, v in enumerate((1, 6, 7, 2, 9))])
    assert json.loads(detect_cross_json(spark, rows, '{"threshold": 5}')) == [{"ts": 1, "value": 6.0, "direction": "rising"}, {"ts": 3, "value": 2.0, "direction": "falling"}, {"ts": 4, "value": 9.0, "direction": "rising"}]
    assert [r["ts"] for r in json.loads(detect_cross_json(spark, rows, '{"threshold": 5, "direction": "falling"}'))] == [3]
    items = '[{"id": "a", "v": 9.5, "kind": "x"}, {"v": 1, "kind": "y"}]'
    want = [{"item_id": "a", "matched_rules": ["x", "big"]}, {"item_id": "1", "matched_rules": []}]
    assert json.loads(evaluate_rules_json('[{"name": "big", "condition": "v > 5.0"}, {"name": "x", "condition": "kind == \'x\' && id == \'a\'", "priority": 1}]', items)) == want
    assert json.loads(evaluate_rules_json("rules:\n- name: big\n  condition: v > 5.0\n- name: x\n  condition: kind == 'x'\n  priority: 1\n", items, yaml=True)) == want
