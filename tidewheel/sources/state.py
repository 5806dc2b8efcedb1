"""State outside of Spark's own checkpoints: snapshots, cursors, stores, and the protocol that commits them."""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol


@dataclass(frozen=True)
class Snapshot:
    """A key's operator state with the fingerprint of the graph it belongs to."""

    key: str
    ts: int
    fingerprint: str
    payload: bytes
    version: int = 1

    def to_bytes(self) -> bytes:
        head = json.dumps({"key": self.key, "ts": self.ts, "fingerprint": self.fingerprint, "version": self.version}).encode()
        return len(head).to_bytes(4, "big") + head + self.payload

    @classmethod
    def from_bytes(cls, raw: bytes) -> Snapshot:
        n = int.from_bytes(raw[:4], "big")
        return cls(**json.loads(raw[4 : 4 + n]), payload=raw[4 + n :])


def graph_fingerprint(*parts: str) -> str:
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()


def take_snapshot(key: str, ts: int, fingerprint: str, kernels: list) -> Snapshot:
    """The state of a key's kernels. Restore only what this process or a trusted one has written."""
    return Snapshot(key, ts, fingerprint, pickle.dumps([k.__dict__ for k in kernels]))


def restore_snapshot(snapshot: Snapshot, fingerprint: str, kernels: list) -> list:
    if snapshot.fingerprint != fingerprint:
        raise ValueError("the snapshot belongs to another graph")
    for k, state in zip(kernels, pickle.loads(snapshot.payload), strict=True):  # noqa: S301  own files only
        k.__dict__.update(state)
    return kernels


class StateStore(Protocol):
    def put(self, key: str, raw: bytes) -> None: ...
    def get(self, key: str) -> bytes | None: ...
    def delete(self, key: str) -> None: ...
    def keys(self) -> list[str]: ...


class MemoryStateStore:
    """A store in a dictionary, for tests and for state that lives as long as its process."""

    def __init__(self):
        self.held: dict[str, bytes] = {}

    def put(self, key: str, raw: bytes) -> None:
        self.held[key] = raw

    def get(self, key: str) -> bytes | None:
        return self.held.get(key)

    def delete(self, key: str) -> None:
        self.held.pop(key, None)

    def keys(self) -> list[str]:
        return sorted(self.held)


class FileStateStore:
    """A file for each key, named by the key in hex; written aside, synced, then renamed."""

    SUFFIX = ".snapshot"

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, key: str) -> Path:
        return self.folder / (key.encode().hex() + self.SUFFIX)

    def put(self, key: str, raw: bytes) -> None:
        path = self._path(key)
        aside = path.with_suffix(f".{os.getpid()}.tmp")
        with aside.open("wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        aside.replace(path)

    def get(self, key: str) -> bytes | None:
        path = self._path(key)
        return path.read_bytes() if path.exists() else None

    def delete(self, key: str) -> None:
        self._path(key).unlink(missing_ok=True)

    def keys(self) -> list[str]:
        return sorted(bytes.fromhex(p.name.removesuffix(self.SUFFIX)).decode() for p in self.folder.glob(f"*{self.SUFFIX}"))


class ObjectStateStore:
    """The same over an object store's client: put(name, bytes), get(name) or None, delete(name), list(prefix)."""

    def __init__(self, client, prefix: str = ""):
        self.client, self.prefix = client, prefix

    def _name(self, key: str) -> str:
        return f"{self.prefix}{key.encode().hex()}"

    def put(self, key: str, raw: bytes) -> None:
        self.client.put(self._name(key), raw)

    def get(self, key: str) -> bytes | None:
        return self.client.get(self._name(key))

    def delete(self, key: str) -> None:
        self.client.delete(self._name(key))

    def keys(self) -> list[str]:
        return sorted(bytes.fromhex(n.removeprefix(self.prefix)).decode() for n in self.client.list(self.prefix))


@dataclass(frozen=True)
class Policy:
    """When to commit: every n records, every so many ms, either, or only by hand (neither)."""

    every_n: int | None = None
    every_ms: int | None = None

    def due(self, records: int, ms: float) -> bool:
        return (self.every_n is not None and records >= self.every_n) or (self.every_ms is not None and ms >= self.every_ms)


class Checkpointer:
    """Commits the snapshot, then the cursor, so a crash repeats records but loses none; opens the circuit after too many failures in a row."""

    def __init__(self, state: StateStore, cursors: StateStore, policy: Policy, deadline_ms: float = 5000, threshold: int = 5, clock: Callable[[], float] = time.monotonic):
        self.state, self.cursors, self.policy, self.deadline, self.threshold, self.clock = state, cursors, policy, deadline_ms, threshold, clock
        self.failures, self.records, self.last = 0, 0, clock()

    def record(self) -> bool:
        self.records += 1
        return self.policy.due(self.records, (self.clock() - self.last) * 1000)

    def commit(self, key: str, snapshot: Snapshot, cursor: bytes) -> None:
        if self.failures >= self.threshold:
            raise RuntimeError("circuit open: too many failed commits")
        began = self.clock()
        try:
            self.state.put(key, snapshot.to_bytes())
            if (self.clock() - began) * 1000 > self.deadline:
                raise TimeoutError("snapshot took longer than the deadline")
            self.cursors.put(key, cursor)
        except Exception:
            self.failures += 1
            raise
        self.failures, self.records, self.last = 0, 0, self.clock()


class Deduplicator:
    """Remembers what was emitted, in a store, under a namespace."""

    def __init__(self, store: StateStore, namespace: str):
        self.store, self.namespace = store, namespace

    def should_emit(self, key: str) -> bool:
        return self.store.get(f"{self.namespace}/{key}") is None

    def mark_emitted(self, key: str) -> None:
        self.store.put(f"{self.namespace}/{key}", b"1")


class ProjectionStore:
    """The latest state by key, in memory; snapshot() and restore() as JSON."""

    def __init__(self):
        self._held: dict = {}

    def get(self, key):
        return self._held.get(key)

    def put(self, key, value) -> None:
        self._held[key] = value

    def remove(self, key):
        return self._held.pop(key, None)

    def entries(self) -> list:
        return list(self._held.items())

    def __len__(self) -> int:
        return len(self._held)

    def snapshot(self) -> str:
        return json.dumps(self._held, sort_keys=True)

    def restore(self, text: str) -> None:
        self._held = json.loads(text)


class LocalShard:
    """Owns every key."""

    epoch = 0

    def owns(self, key) -> bool:
        return True


class RebalancedShard:
    """Owns the keys of its partitions; each new assignment raises the epoch, and stale ones are refused."""

    def __init__(self, partitions: int, assigned: set[int]):
        self.partitions, self.assigned, self.epoch = partitions, set(assigned), 0

    def owns(self, key) -> bool:
        return int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16) % self.partitions in self.assigned

    def apply_rebalance(self, assigned: set[int], epoch: int) -> bool:
        if epoch <= self.epoch:
            return False
        self.assigned, self.epoch = set(assigned), epoch
        return True


class ManualClock:
    def __init__(self, now_ms: int = 0):
        self.now = now_ms

    def now_ms(self) -> int:
        return self.now

    def advance(self, ms: int) -> None:
        self.now += ms


class SystemClock:
    def now_ms(self) -> int:
        return int(time.time() * 1000)
