"""Message brokers: Kafka streams with offsets that can be kept outside, an MQTT source behind a log, an MQTT sink.

Kafka needs Spark's connector on the class path, MQTT the paho package; both are only looked for when a stream
is started. The projections to and from Kafka's columns are separate, so that they run on any table.
"""

from __future__ import annotations

import base64
import json
import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .state import RebalancedShard, StateStore


@dataclass(frozen=True)
class KafkaOffset:
    """Where to go on: one past the last record read."""

    topic: str
    partition: int
    offset: int

    @classmethod
    def after(cls, topic: str, partition: int, last: int) -> KafkaOffset:
        return cls(topic, partition, last + 1)

    def to_bytes(self) -> bytes:
        return f"{self.topic}\x00{self.partition}\x00{self.offset}".encode()

    @classmethod
    def from_bytes(cls, raw: bytes) -> KafkaOffset:
        topic, partition, offset = raw.decode().split("\x00")
        return cls(topic, int(partition), int(offset))

    def display(self) -> str:
        return f"{self.topic}[{self.partition}]@{self.offset}"


@dataclass(frozen=True)
class MqttCursor:
    """Where to go on in the log of an MQTT source: one past the last message read."""

    n: int

    def to_bytes(self) -> bytes:
        return str(self.n).encode()

    @classmethod
    def from_bytes(cls, raw: bytes) -> MqttCursor:
        return cls(int(raw))

    def display(self) -> str:
        return f"log@{self.n}"


class CursorStore:
    """A consumer group's Kafka offsets in a state store; an offset never goes back but by reset()."""

    def __init__(self, store: StateStore, group: str):
        self.store, self.group = store, group

    def _key(self, topic: str, partition: int) -> str:
        return f"{self.group}\x00{topic}\x00{partition}"

    def get(self, topic: str, partition: int) -> KafkaOffset | None:
        raw = self.store.get(self._key(topic, partition))
        return KafkaOffset.from_bytes(raw) if raw is not None else None

    def commit(self, cursors: list[KafkaOffset]) -> None:
        for c in cursors:
            held = self.get(c.topic, c.partition)
            if held is None or held.offset < c.offset:
                self.reset(c)

    def reset(self, cursor: KafkaOffset) -> None:
        self.store.put(self._key(cursor.topic, cursor.partition), cursor.to_bytes())

    def all(self) -> list[KafkaOffset]:
        mine = [k for k in self.store.keys() if k.startswith(f"{self.group}\x00")]
        return [KafkaOffset.from_bytes(self.store.get(k)) for k in mine]


def starting_offsets(cursors: list[KafkaOffset]) -> str:
    """Cursors as the `starting` of kafka_options. Every partition of the topics must be there."""
    topics: dict[str, dict[str, int]] = {}
    for c in cursors:
        topics.setdefault(c.topic, {})[str(c.partition)] = c.offset
    return json.dumps(topics, sort_keys=True)


def next_offsets(records: DataFrame) -> DataFrame:
    """topic, partition, offset to go on at: a row for each partition that has records."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))


def committing(store: CursorStore, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: handles a batch, then commits its offsets, so a crash repeats records but loses none."""

    def run(batch: DataFrame, number: int) -> None:
        handle(batch, number)
        store.commit([KafkaOffset(r["topic"], r["partition"], r["offset"]) for r in next_offsets(batch).collect()])

    return run


def rebalance(shard: RebalancedShard, store: CursorStore, topic: str, assigned: set[int], epoch: int) -> list[KafkaOffset]:
    """Takes a new assignment (a stale one is refused) and gives the cursors to go on from; a partition never read starts at 0."""
    if not shard.apply_rebalance(assigned, epoch):
        return []
    return [store.get(topic, p) or KafkaOffset(topic, p, 0) for p in sorted(assigned)]


def kafka_options(servers: str, topics: list[str], group: str | None = None, starting: str = "latest", **more: str) -> dict[str, str]:
    if not servers or not topics:
        raise ValueError("servers and topics are needed")
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting} | ({"kafka.group.id": group} if group else {}) | more


def from_kafka(raw: DataFrame) -> DataFrame:
    """key, payload (null for a tombstone), topic, partition, offset, ts_ms of the connector's rows."""
    return raw.select("key", F.col("value").alias("payload"), "topic", "partition", "offset", F.unix_millis("timestamp").alias("ts_ms"))


def to_kafka(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """The columns that the connector writes: bytes as they are, all else as its text; a null value is a tombstone."""
    out = df.select(key.alias("key"), value.alias("value"))
    return out.select(*[(F.col(c) if t == "binary" else F.col(c).cast("string").cast("binary")).alias(c) for c, t in out.dtypes])


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    return from_kafka(spark.readStream.format("kafka").options(**kafka_options(**options)).load())


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: Column, value: Column):
    out = to_kafka(df, key, value)
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


class SeenPackets:
    """Packet ids of exactly-once deliveries; the oldest are forgotten beyond the bound."""

    def __init__(self, most: int = 65_536):
        if not 1 <= most <= 65_536:
            raise ValueError("1 to 65536 packet ids are kept")
        self.most, self.seen = most, OrderedDict()

    def first(self, packet: int) -> bool:
        if packet in self.seen:
            return False
        self.seen[packet] = None
        if len(self.seen) > self.most:
            self.seen.popitem(last=False)
        return True

    def release(self, packet: int) -> None:
        self.seen.pop(packet, None)

    def is_new(self, packet: int, again: bool) -> bool:
        """Whether a delivery is to be taken. Without the redelivery flag an id starts a new message: ids are used again."""
        if not again:
            self.release(packet)
        return self.first(packet)


def read_messages(folder: str, start: int, end: int) -> Iterator[tuple]:
    """Messages start to end (exclusive) of a log's folder; changes nothing there."""
    found = sorted((int(p.stem), p) for p in Path(folder).glob("*.log"))
    sent = 0
    for i, (at, path) in enumerate(found):
        if at >= end or (i + 1 < len(found) and found[i + 1][0] <= start):
            continue
        with path.open("rb") as f:
            for n, line in enumerate(f, at):
                if n >= end:
                    break
                if n >= start:
                    topic, payload, *rest = json.loads(line)
                    sent += 1
                    yield (topic, base64.b64decode(payload), *rest)
    if sent != max(0, end - start):
        raise ValueError(f"the log has {sent} of the {end - start} messages from {start} on")


class MessageLog:
    """Messages in numbered files of a folder, each synced before it counts as received.

    One process writes a log at a time. The folder must be one that the driver's next run and the executors see
    too: a batch that has to be repeated after a restart is read by a task. Messages are numbered for ever; files whose messages
    are all committed are deleted, but for the newest, which holds the count. A line torn by a crash was never
    acknowledged and is cut off.
    """

    def __init__(self, folder: str, per_file: int = 10_000):
        self.folder, self.per_file, self.lock = Path(folder), per_file, threading.Lock()
        self.folder.mkdir(parents=True, exist_ok=True)
        self.starts = sorted(int(p.stem) for p in self.folder.glob("*.log"))
        if not self.starts:
            self._open(0)
            return
        path = self._path(self.starts[-1])
        raw = path.read_bytes()
        whole = raw[: raw.rfind(b"\n") + 1]
        if whole != raw:
            with path.open("r+b") as f:
                f.truncate(len(whole))
        self.end = self.starts[-1] + whole.count(b"\n")
        self.file = path.open("ab")

    def _path(self, start: int) -> Path:
        return self.folder / f"{start:020d}.log"

    def _open(self, start: int) -> None:
        self.starts.append(start)
        self.end, self.file = start, self._path(start).open("ab")

    @property
    def begin(self) -> int:
        return self.starts[0]

    def append(self, topic: str, payload: bytes, qos: int, retain: bool, ts_ms: int) -> None:
        line = json.dumps([topic, base64.b64encode(payload).decode(), qos, retain, ts_ms]).encode() + b"\n"
        with self.lock:
            if self.end - self.starts[-1] >= self.per_file:
                self.file.close()
                self._open(self.end)
            self.file.write(line)
            self.file.flush()
            os.fsync(self.file.fileno())
            self.end += 1

    def read(self, start: int, end: int) -> Iterator[tuple]:
        with self.lock:
            if start < self.begin or end > self.end:
                raise ValueError(f"messages {start} to {end} aren't all in the log, which holds {self.begin} to {self.end}")
        return read_messages(str(self.folder), start, end)

    def commit(self, n: int) -> None:
        """Messages below n aren't asked for again."""
        with self.lock:
            while len(self.starts) > 1 and self.starts[1] <= n:
                self._path(self.starts.pop(0)).unlink(missing_ok=True)


def paho_connect(options: dict, on_message: Callable | None = None):
    """A connected client that calls on_message(message) for each message of the topic before it is acknowledged."""
    try:
        import paho.mqtt.client as mqtt
    except ImportError as e:
        raise RuntimeError("MQTT needs the paho-mqtt package") from e
    versions = getattr(mqtt, "CallbackAPIVersion", None)
    named = {"client_id": options["clientid"], "clean_session": False} if "clientid" in options else {}
    client = mqtt.Client(versions.VERSION2, **named) if versions else mqtt.Client(**named)
    if on_message is not None:
        client.on_message = lambda _, __, m: on_message(m)
        client.on_connect = lambda c, *_: c.subscribe(options["topic"], int(options.get("qos", 0)))  # on each reconnection too
    client.connect(options["host"], int(options.get("port", 1883)))
    client.loop_start()
    return client


def mqtt_source(connect: Callable = paho_connect):
    """The data source class to register: spark.dataSource.register(mqtt_source()); then format("mqtt") reads and writes.

    Reading takes host, topic and log (a folder for messages, see MessageLog), and port, qos, clientid (with it the broker
    keeps what comes while nobody listens) and batch (messages of a micro-batch at most; the rest come in the next).
    Writing takes host, port, qos and rows of topic, payload and, if there, retain; a retried task sends its rows again.
    """
    from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage

    class MqttReader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.options, self.client, self.held, self.done = options, None, None, 0
            self.batch, self.seen = int(options.get("batch", 10_000)), SeenPackets()

        def __getstate__(self) -> dict:
            return self.__dict__ | {"client": None, "held": None, "seen": None}  # a task only reads

        def _log(self) -> MessageLog:
            if self.held is None:
                self.held = MessageLog(self.options["log"])
            return self.held

        def _received(self, m) -> None:
            if m.qos < 2 or self.seen.is_new(m.mid, bool(m.dup)):
                self._log().append(m.topic, bytes(m.payload), int(m.qos), bool(m.retain), int(time.time() * 1000))

        def initialOffset(self) -> dict:
            return {"n": self._log().begin}

        def read(self, start: dict):
            log = self._log()
            if self.client is None:
                self.client = connect(self.options, self._received)
            end = min(log.end, start["n"] + self.batch)
            return iter(list(log.read(start["n"], end))), {"n": end}  # Spark copies the iterator

        def readBetweenOffsets(self, start: dict, end: dict):
            return read_messages(self.options["log"], start["n"], end["n"])

        def commit(self, end: dict) -> None:
            """Keeps the batch last committed, which Spark plans again when it restarts."""
            self._log().commit(self.done)
            self.done = end["n"]

    class MqttWriter(DataSourceStreamWriter, DataSourceWriter):
        def __init__(self, options: dict):
            self.options = options

        def write(self, iterator):
            client, sent, qos = connect(self.options), [], int(self.options.get("qos", 1))
            for row in iterator:
                r = row.asDict()
                sent.append(client.publish(r["topic"], bytes(r["payload"] or b""), qos, bool(r.get("retain") or False)))
                if len(sent) >= 1000:
                    _settle(sent)
            _settle(sent)
            client.disconnect()
            client.loop_stop()
            return WriterCommitMessage()

        def commit(self, messages, batchId=None) -> None:
            pass

        def abort(self, messages, batchId=None) -> None:
            pass

    def _settle(sent: list) -> None:
        for s in sent:
            s.wait_for_publish()
        sent.clear()

    class MqttSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "mqtt"

        def schema(self) -> str:
            return "topic string, payload binary, qos int, retain boolean, ts_ms bigint"

        def _needed(self, *names: str) -> dict:
            if missing := [n for n in names if n not in self.options]:
                raise ValueError(f"options are needed: {', '.join(missing)}")
            return dict(self.options)

        def simpleStreamReader(self, schema):
            return MqttReader(self._needed("host", "topic", "log"))

        def streamWriter(self, schema, overwrite):
            return MqttWriter(self._needed("host"))

        def writer(self, schema, overwrite):
            return MqttWriter(self._needed("host"))

    return MqttSource
