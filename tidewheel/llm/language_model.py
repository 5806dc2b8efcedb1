"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling, and its scores.

The root restaurant holds the words; its children are 256 hash classes of the preceding token, and their
children the preceding tokens themselves, each a context of its own (the start of a text has its own token).
The root's base is uniform over the known words and one class of unknown ones. The state is the number of
tables t of each (context, word), of each (class, word) and of each word at the root. Table counts are sampled
from their full conditionals p(t) ~ S(c, t; d)·a^t, with S the generalised Stirling numbers and a the weight of
opening a table: exactly for up to EXACT customers, beyond that from the matching normal law (tables are
Poisson many, their sizes tilted so that they sum to c). A sweep updates all contexts against the current
classes, then the classes, then the root. Predictive probabilities are averaged over the kept sweeps; they sum
to one over words for each context.

How it runs. One scan cuts the rows in batches; the vocabulary's buckets number the words (frequent ones get
small numbers), so that batches, counts and states stay small. Training counts of (context, word) go to word
buckets; a bucket holds all contexts of its words. Between sweeps the buckets ask for the tables of their
contexts, which meet by context; those of classes and root, a few hundred numbers, pass the driver. To score, a
batch asks the word buckets for its distinct (context, word) and the context buckets for its distinct contexts,
and adds up its rows' logarithms from the answers; nothing is sent for each row and bucket. Buckets with many
tokens are split by batch, their model copied to each split.

Bounds: a word bucket holds the tokens of about BUCKET_BYTES of text, a context bucket those of four times as
much; how many there are changes no result, as numbers hang on counts and hashes, and random ones on word, context
and sweep alone. Partial counts of a bucket are added in groups first where there are many. A word's entries are
in one bucket: as many as it has distinct preceding words. Word identity is a 64-bit hash.

Rows: null and empty texts consist of the end token alone; repeated rows each count and are each scored; a
null id hashes like the empty text; with no training rows every token is unknown; an empty table gives no
rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, fold, forget, materialize, mix64, sliced, table, uniform, words_of

CLASSES = 256
START, END = b"\x00 start", b"\x00 end"  # no word holds a space
DISCOUNT, STRENGTH = 0.8, 1.0  # of the contexts and their classes
ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 1.0
BURN_IN, SAMPLES = 2, 2
EXACT = 200
#: The vocabulary is numbered in so many parts by the words' hashes: a number is the rank in the part, and the part.
SUBS = 1 << 13
_START, _UNKNOWN = np.uint64(1 << 40), np.uint64(1 << 41)  # numbers of words are below
#: Text whose tokens a bucket holds, on average, at most; and how many partial counts of a bucket are added in one step.
BUCKET_BYTES, FAN = 8_000_000, 64
_FLUSH = 1_500_000
_LOW = np.uint64(CLASSES - 1)


@cache
def stirling_logs(most: int, d: float) -> np.ndarray:
    """log S(c, t; d) for c, t up to most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c, 1:] + np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay)
    return s


def sample_tables(c: np.ndarray, a: np.ndarray, d: float, logs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Table counts for c customers of a dish, a the weight of a new table, u uniform numbers."""
    t = np.ones(len(c), np.int64)
    two = c == 2
    t[two] += u[two] < a[two] / (a[two] + 1.0 - d)
    some = np.flatnonzero((c > 2) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    values, starts = np.unique(c[some], return_index=True)
    for n, s, e in zip(values, starts, [*starts[1:], len(some)][: len(starts)], strict=True):
        for at in np.array_split(some[s:e], 1 + (e - s) * int(n) // 2_000_000):
            w = logs[n, 1 : n + 1] + np.log(a[at])[:, None] * np.arange(1, n + 1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (w < (u[at] * w[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        cm, am = c[many].astype(float), a[many]
        low, high = np.full(len(many), -700.0), np.full(len(many), -1e-15)  # log(1 - x), x the tilt: a·x·(1-x)^(d-1) = c
        for _ in range(70):
            mid = (low + high) / 2
            above = np.log(-np.expm1(mid)) + (d - 1.0) * mid > np.log(cm / am)
            low, high = np.where(above, mid, low), np.where(above, high, mid)
        y = np.exp(low)
        x, phi = 1.0 - y, -np.expm1(d * low) / d
        one = x * y ** (d - 1.0)
        size, square = one / phi, (one + x * x * (1.0 - d) * y ** (d - 2.0)) / phi
        g = one + (1.0 - d) * x * x * y ** (d - 2.0)
        slope = y ** (d - 1.0) + 3.0 * (1.0 - d) * x * y ** (d - 2.0) + (1.0 - d) * (2.0 - d) * x * x * y ** (d - 3.0)
        mean = am * phi - 0.5 * (1.0 - slope / g / (1.0 / x + (1.0 - d) / y))  # the saddle point, and its next term
        spread = np.sqrt(np.maximum(mean * (1.0 - size * size / square), 0.0))
        z = np.sqrt(-2.0 * np.log(u[many])) * np.cos(2.0 * np.pi * uniform((u[many] * 2.0**53).astype(np.uint64)))
        t[many] = np.clip(np.rint(mean + spread * z), 1, cm).astype(np.int64)
    return t


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)


class Seating:
    """A bucket's words, contexts and counts, sorted, and the tables of contexts, classes and root."""

    def __init__(self, words: np.ndarray, known: np.ndarray, of: np.ndarray, counts: np.ndarray):
        """known: distinct contexts, of: which one each entry has."""
        self.known, self.of = known, of.astype(np.int64)
        self.words, self.contexts, self.counts = words, known[self.of], counts.astype(np.int64)
        self.key = words | (self.contexts & _LOW)
        self.new_pair, self.new_word = _firsts(self.key), _firsts(words)
        self.pair = np.cumsum(self.new_pair) - 1  # of each entry
        self.pairs = self.key[self.new_pair]
        self.word = np.cumsum(_firsts(self.pairs & ~_LOW)) - 1  # of each pair
        self.t, self.pair_t, self.root = np.ones(len(words), np.int64), np.ones(len(self.pairs), np.int64), np.ones(int(self.new_word.sum()), np.int64)

    def customers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of class and word, and of each word at the root."""
        return np.bincount(self.pair, weights=self.t).astype(np.int64), np.bincount(self.word, weights=self.pair_t).astype(np.int64)

    def sums(self) -> np.ndarray:
        """Customers and tables of each class, tables of the root, words, tokens."""
        of, c = (self.pairs & _LOW).astype(np.int64), self.customers()[0]
        return np.concatenate([np.bincount(of, weights=x, minlength=CLASSES) for x in (c, self.pair_t)] + [[self.root.sum(), len(self.root), self.counts.sum()]]).astype(np.int64)

    def sweep(self, totals: np.ndarray, sums: np.ndarray, salt: np.uint64) -> None:
        """A sweep. totals: the tables of each entry's context; sums: as sums() gives them, over all buckets."""
        logs, root_logs = stirling_logs(EXACT, DISCOUNT), stirling_logs(EXACT, ROOT_DISCOUNT)
        seats, tables, base = sums[:CLASSES], sums[CLASSES : 2 * CLASSES], (ROOT_STRENGTH + ROOT_DISCOUNT * sums[-3]) / (sums[-2] + 1)
        of, at_root = (self.pairs & _LOW).astype(np.int64), tables.sum() + ROOT_STRENGTH
        c, w = self.customers()
        root = (np.maximum(w - ROOT_DISCOUNT * self.root, 0.0) + base) / at_root
        some = np.flatnonzero(self.counts > 1)  # a single customer has its one table
        k = self.pair[some]
        inherited = (STRENGTH + DISCOUNT * tables[of[k]]) * root[self.word[k]]
        parent = (np.maximum(c[k] - self.t[some] - DISCOUNT * self.pair_t[k], 0.0) + inherited) / (seats[of[k]] + STRENGTH)
        a = (STRENGTH + DISCOUNT * (totals[some] - self.t[some])) * parent
        self.t[some] = sample_tables(self.counts[some], a, DISCOUNT, logs, uniform(mix64(self.words[some]) ^ self.contexts[some] ^ salt))
        c, w = self.customers()
        some = np.flatnonzero(c > 1)
        k = self.word[some]
        parent = (np.maximum(w[k] - self.pair_t[some] - ROOT_DISCOUNT * self.root[k], 0.0) + base) / at_root
        before = self.pair_t[some]
        self.pair_t[:] = 1
        self.pair_t[some] = sample_tables(c[some], (STRENGTH + DISCOUNT * (tables[of[some]] - before)) * parent, DISCOUNT, logs, uniform(self.pairs[some] ^ salt))
        w = self.customers()[1]
        self.root = sample_tables(w, np.full(len(w), base), ROOT_DISCOUNT, root_logs, uniform(self.words[self.new_word] ^ salt ^ np.uint64(0x5555555555555555)))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays compressed, byte plane by byte plane: numbers are small, so their upper planes take no room."""
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _spread(raw: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def _pack(words: np.ndarray, contexts: np.ndarray) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries sorted by word: steps from one distinct word to the next, contexts a word, contexts."""
    new = _firsts(words)
    return int(new.sum()), (np.diff(words[new], prepend=np.uint64(0)), np.diff(np.concatenate((np.flatnonzero(new), [len(words)]))).astype(np.uint32), contexts)


def _unpack(raw: bytes, words: int, entries: int, *more: tuple[type, int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    w, per, context, *rest = _spread(raw, (np.uint64, words), (np.uint32, words), (np.uint64, entries), *more)
    return np.repeat(np.cumsum(w), per), context, rest


def _distinct(words: np.ndarray, contexts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs by word, class and context, and how often they occur."""
    order = np.lexsort((contexts, words | (contexts & _LOW)))
    words, contexts = words[order], contexts[order]
    start = np.flatnonzero(_firsts(words) | _firsts(contexts))
    return words[start], contexts[start], np.add.reduceat(n[order], start) if len(start) else n[:0]


def _buckets(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(keys) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _slices(bucket: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    cuts = np.searchsorted(bucket, np.arange(parts + 1))
    return [(int(b), int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts))]


def bucket_count(docs: DataFrame, text_col: str = "text") -> tuple[int, int, int]:
    """Word buckets and context buckets for these texts, and into how many groups a bucket's partial counts go first."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return int(size // BUCKET_BYTES) + 1, int(size // (4 * BUCKET_BYTES)) + 1, int(size // (4 * _FLUSH * FAN)) + 1


# Rows that meet by bucket: what asks (batch >= 0) and what is known there (batch < 0). Rows of batches pass on.
_WORDS, _CONTEXTS, _BATCH = 0, 1, 2
_NAMES = ["kind", "bucket", "split", "batch", "words", "entries", "data", "ids", "contexts", "kept"]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _schema(id_type: str) -> str:
    return f"kind int, bucket int, split int, batch bigint, words int, entries int, data binary, ids array<{id_type}>, contexts int, kept array<binary>"


def _rows(rows: list[tuple], ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
    """Rows without ids, the last one with them if there are any."""
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)]
    none = len(rows) - (ids is not None)
    parts = [pa.nulls(none, pa.list_(id_type))] + ([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)] if ids is not None else [])
    more = [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([x.cast(pa.list_(id_type)) for x in parts]), *more], names=_NAMES)


def _told(rows: DataFrame, kind: int, id_type: str, split=None, batch=None, words=None) -> DataFrame:
    zero = F.lit(0)
    return rows.select(F.lit(kind).alias("kind"), "bucket", (zero if split is None else split).alias("split"), F.coalesce(F.lit(-1) if batch is None else batch).cast("bigint").alias("batch"), (zero if words is None else words).alias("words"), "entries", "data", F.lit(None).cast(f"array<{id_type}>").alias("ids"), *(F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("contexts", "int"), ("kept", "array<binary>"))))


def _cut(docs: DataFrame, parts: int, id_type: str) -> DataFrame:
    """Rows of (id, text, train): batches, and the distinct words' hashes and training counts that they ask the vocabulary."""

    def packed(ids: list[pa.Array], held: list[np.ndarray], train: list[bool], seen: Places, batch: int) -> pa.RecordBatch:
        ids, lengths, taught, at = pa.concat_arrays(ids), np.array([len(h) for h in held]), np.array(train, bool), np.concatenate(held)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        n = np.bincount(at, weights=np.repeat(taught, lengths), minlength=len(words)).astype(np.uint32)
        part = (words % np.uint64(SUBS)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        to = np.empty(len(order), np.uint32)
        to[order] = np.arange(len(order), dtype=np.uint32)
        rows = [(_WORDS, b, 0, batch, 0, e - s, _squeeze(words[order[s:e]], n[order[s:e]])) for b, s, e in _slices(part[order], parts)]
        rows.append((_BATCH, _spot(batch) % parts, 0, batch, len(words), len(at), _squeeze(lengths.astype(np.uint32), taught.astype(np.uint8), to[at])))
        return _rows(rows, ids, ids.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids, held, train, n, batch = Places(), [], [], [], 0, TaskContext.get().partitionId() << 24
        for b in sliced(batches, 100):
            ids.append(b.column(0))
            train += b.column(2).to_pylist()
            for t in b.column(1).to_pylist():
                words = [*words_of(t), END]
                held.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                n += len(words)
            if n >= _FLUSH:
                yield packed(ids, held, train, seen, batch)
                seen, ids, held, train, n, batch = Places(), [], [], [], 0, batch + 1
        if held:
            yield packed(ids, held, train, seen, batch)

    return docs.mapInArrow(run, _schema(id_type))


class Places(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _spot(batch: int) -> int:
    return int(mix64(np.array([batch], np.uint64))[0] >> np.uint64(8))


def _numbered(id_type: str):
    """The vocabulary's parts number the words, or look them up where they are numbered, and answer the batches."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == _BATCH:
            return t
        rows = t.drop_columns(["ids"]).to_pylist()
        known = [_spread(r["data"], (np.uint64, r["entries"]), (np.uint64, r["entries"])) for r in rows if r["batch"] == -1]
        asked = [(r, *_spread(r["data"], (np.uint64, r["entries"]), (np.uint32, r["entries"]))) for r in rows if r["batch"] >= 0]
        out = []
        if any(r["batch"] == -1 for r in rows) or any(r["batch"] == -2 for r in rows):
            words, numbers = (np.concatenate([k[i] for k in known] or [np.empty(0, np.uint64)]) for i in (0, 1))
        else:
            words, at = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([a[2] for a in asked]))
            words, n = words[n > 0], n[n > 0]
            sub = words % np.uint64(SUBS)
            order = np.lexsort((words, -n, sub))
            first = np.flatnonzero(_firsts(sub[order]))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
            numbers = np.empty(len(words), np.uint64)
            numbers[order] = rank.astype(np.uint64) * np.uint64(SUBS) + sub[order]
            out.append((_WORDS, rows[0]["bucket"], 0, -1, 0, len(words), _squeeze(words, numbers)))
        for r, hashes, _ in asked:
            at, has = _find(words, hashes)
            found = np.where(has, numbers[at], _UNKNOWN | (hashes % np.uint64(SUBS))) if len(words) else _UNKNOWN | (hashes % np.uint64(SUBS))
            out.append((_WORDS, r["bucket"], 0, r["batch"], 0, r["entries"], _squeeze(found)))
        return pa.Table.from_batches([_rows(out, None, t.schema.field("ids").type.value_type)]) if out else t.slice(0, 0)

    return run, _schema(id_type)


def _coded(id_type: str):
    """A batch with the numbers of its words, frequent ones first; rows of the vocabulary pass on."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("batch")[0].as_py() < 0:
            return t
        rows = t.drop_columns(["ids"]).to_pylist()
        at = next(i for i, r in enumerate(rows) if r["kind"] == _BATCH)
        own, ids = rows[at], t.column("ids")[at].values
        lengths, train, place = _spread(own["data"], (np.uint32, len(ids)), (np.uint8, len(ids)), (np.uint32, own["entries"]))
        numbers = np.concatenate([_spread(r["data"], (np.uint64, r["entries"]))[0] for r in sorted((r for r in rows if r["kind"] == _WORDS), key=lambda r: r["bucket"])])
        order = np.argsort(-np.bincount(place, minlength=len(numbers)), kind="stable")
        to = np.empty(len(order), np.uint32)
        to[order] = np.arange(len(order), dtype=np.uint32)
        return pa.Table.from_batches([_rows([(_BATCH, own["bucket"], 0, own["batch"], len(numbers), own["entries"], _squeeze(lengths, train, numbers[order], to[place]))], ids, ids.type)])

    return run, _schema(id_type)


def encode(docs: DataFrame, parts: int, train=None, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Batches of numbered words, and the vocabulary: that of the rows where `train` holds, if none is given."""
    id_type = docs.schema[id_col].dataType.simpleString()
    taught = F.lit(False) if train is None else F.coalesce(train, F.lit(False))
    rows = _cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), taught.alias("train")), parts, id_type)
    if vocabulary is not None:
        marks = docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("entries"), F.lit(None).cast("binary").alias("data"))
        rows = rows.union(_told(vocabulary, _WORDS, id_type)).union(_told(marks, _WORDS, id_type, batch=F.lit(-2)))
    run, schema = _numbered(id_type)
    rows = rows.groupBy("kind", "bucket").applyInArrow(run, schema)
    run, schema = _coded(id_type)
    rows = materialize(rows.groupBy("batch", F.when(F.col("batch") < 0, F.col("bucket")).alias("part")).applyInArrow(run, schema))
    found = rows.where(F.col("kind") == _WORDS).select("bucket", "entries", "data")
    return rows.where(F.col("kind") == _BATCH), found if vocabulary is None else vocabulary


def _entries(row: dict, docs: int, parts: int, train_only: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct (word, context) of a batch, sorted by bucket, word, class and context, their buckets and counts; where its tokens stand in them, and its rows' lengths."""
    lengths, train, numbers, tokens = _spread(row["data"], (np.uint32, docs), (np.uint8, docs), (np.uint64, row["words"]), (np.uint32, row["entries"]))
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)
    before = np.concatenate(([0], tokens[:-1])).astype(np.int64)
    before[starts] = len(numbers)  # the start of a text
    if train_only:
        use = np.repeat(train > 0, lengths)
        tokens, before = tokens[use], before[use]
    words, contexts = numbers * np.uint64(CLASSES), np.concatenate((numbers, [_START]))
    bucket = _buckets(words, parts)
    by_word, by_context = np.lexsort((words, bucket)), np.lexsort((contexts, contexts & _LOW))
    ranks = [np.empty(len(x), np.int64) for x in (by_word, by_context)]
    for rank, by in zip(ranks, (by_word, by_context), strict=True):
        rank[by] = np.arange(len(by))
    pair, place, n = np.unique(ranks[0][tokens] * len(contexts) + ranks[1][before], return_inverse=True, return_counts=True)
    word = by_word[pair // len(contexts)]
    return words[word], contexts[by_context[pair % len(contexts)]], bucket[word], n, place, lengths


def _counts(batches: DataFrame, parts: int, groups: int) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for r, ids in zip(b.drop_columns(["ids"]).to_pylist(), b.column("ids"), strict=True):
                words, contexts, bucket, n, *_ = _entries(r, len(ids.values), parts, True)
                rows = []
                for k, s, e in _slices(bucket, parts):
                    count, columns = _pack(words[s:e], contexts[s:e])
                    rows.append((k, _spot(r["batch"]) % groups, count, e - s, _squeeze(*columns, n[s:e].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "grp", "words", "entries", "data"])

    counts = batches.mapInArrow(run, "bucket int, grp int, words int, entries int, data binary")
    return counts.groupBy("bucket", "grp").applyInArrow(_added, "bucket int, words int, entries int, data binary") if groups > 1 else counts


def _sum(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts and counts of the rows together."""
    parts = [_unpack(raw, w, e, (np.uint32, e)) for w, e, raw in zip(t.column("words").to_pylist(), t.column("entries").to_pylist(), t.column("data").to_pylist(), strict=True)]
    return _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2][0] for p in parts]).astype(np.int64))


def _added(t: pa.Table) -> pa.Table:
    words, contexts, n = _sum(t)
    count, columns = _pack(words, contexts)
    return pa.table({"bucket": t.column("bucket").slice(0, 1), "words": pa.array([count], pa.int32()), "entries": pa.array([len(words)], pa.int32()), "data": pa.array([_squeeze(*columns, n.astype(np.uint32))], pa.binary())})


_STATE = "bucket int, words int, entries int, contexts int, data binary, tokens bigint, sums array<bigint>, kept array<binary>"


def _state_of(at: Seating, *more: np.ndarray) -> tuple[int, int, int, bytes]:
    """Words, entries, contexts, and the columns."""
    words, (w, per, _) = _pack(at.words, at.contexts)
    return words, len(at.words), len(at.known), _squeeze(w, per, at.known, at.of.astype(np.uint32), *(x.astype(np.uint32) for x in (at.counts, *more)))


def _row(bucket: int, at: Seating, kept: list[bytes]) -> pa.Table:
    """A bucket's state; kept: the tables of the kept sweeps, a squeezed block for each."""
    values = (bucket, *_state_of(at, at.t, at.pair_t, at.root), int(at.counts.sum()), at.sums().tolist(), kept)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()))
    names = ("bucket", "words", "entries", "contexts", "data", "tokens", "sums", "kept")
    return pa.table({n: pa.array([v], k) for n, v, k in zip(names, values, kinds, strict=True)})


def _restored(r: dict, *more: tuple[type, int]) -> tuple[Seating, list[np.ndarray]]:
    w, per, known, of, counts, *rest = _spread(r["data"], (np.uint64, r["words"]), (np.uint32, r["words"]), (np.uint64, r["contexts"]), (np.uint32, r["entries"]), (np.uint32, r["entries"]), *more)
    return Seating(np.repeat(np.cumsum(w), per), known, of, counts), rest


def _seating(r: dict) -> Seating:
    at, _ = _restored(r)
    kinds = ((np.uint32, r["entries"]), (np.uint32, len(at.pairs)), (np.uint32, r["words"]))
    at.t, at.pair_t, at.root = (x.astype(np.int64) for x in _restored(r, *kinds)[1])
    return at


def _seated(t: pa.Table) -> pa.Table:
    """The counts of a bucket, with one table for each pair."""
    words, contexts, n = _sum(t)
    return _row(t.column("bucket")[0].as_py(), Seating(words, *np.unique(contexts, return_inverse=True), n), [])


def _context_totals(state: DataFrame, parts: int, answer: bool) -> DataFrame:
    """Customers and tables of the contexts: whole (answer false), or the tables of each bucket's contexts, in their order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = _seating(r)
                u, n, t = at.known, *(np.bincount(at.of, weights=x).astype(np.int64) for x in (at.counts, at.t))
                to = _buckets(u, parts)
                order = np.argsort(to, kind="stable")
                u, n, t = u[order], n[order], t[order]
                rows = [(c, r["bucket"], e - s, _squeeze(u[s:e], t[s:e], *(() if answer else (n[s:e],)))) for c, s, e in _slices(to[order], parts)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "bucket", "entries", "data"])

    def add(t: pa.Table) -> pa.Table:
        rows = [(r["bucket"], *_spread(r["data"], (np.uint64, r["entries"]), *[(np.int64, r["entries"])] * (2 - answer))) for r in t.to_pylist()]
        part = t.column("part")[0].as_py()
        u, inverse = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([r[i] for r in rows])).astype(np.int64) for i in range(2, 4 - answer)]
        out = [(part, part, len(u), _squeeze(u, *sums[::-1]))]
        if answer:
            out = [(b, part, len(own), _squeeze(sums[0][np.searchsorted(u, own)])) for b, own, *_ in rows]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "part": pa.array([o[1] for o in out], pa.int32()), "entries": pa.array([o[2] for o in out], pa.int32()), "data": pa.array([o[3] for o in out], pa.binary())})

    asked = state.select("bucket", "words", "entries", "contexts", "data").mapInArrow(ask, "part int, bucket int, entries int, data binary")
    return asked.groupBy("part").applyInArrow(add, "bucket int, part int, entries int, data binary")


def _sums(state: DataFrame) -> np.ndarray:
    sums = np.zeros(2 * CLASSES + 3)
    for r in state.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # 2·CLASSES + 3 rows
        sums[r["at"]] = r["n"]
    return sums


def _swept(state: DataFrame, parts: int, sums: np.ndarray, sweep: int, keep: bool) -> DataFrame:
    """The state after a sweep against the whole's totals."""
    salt = np.uint64(0x9E3779B97F4A7C15 * (sweep + 1) % 2**64)

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if r["words"] is not None)
        at = _seating(own)
        told = sorted((r for r in rows if r["words"] is None), key=lambda r: r["part"])
        n = np.empty(len(at.known), np.int64)
        n[np.argsort(_buckets(at.known, parts), kind="stable")] = np.concatenate([_spread(r["data"], (np.int64, r["entries"]))[0] for r in told])
        at.sweep(n[at.of], sums, salt)
        kept = [_squeeze(*(x.astype(np.uint32) for x in (at.t, at.pair_t, at.root)))] if keep else []
        return _row(own["bucket"], at, own["kept"] + kept)

    totals = _context_totals(state, parts, True).select("bucket", "part", F.lit(None).cast("int").alias("words"), "entries", F.lit(0).alias("contexts"), "data", F.lit(None).cast("array<binary>").alias("kept"))
    return state.select("bucket", F.lit(-1).alias("part"), "words", "entries", "contexts", "data", "kept").union(totals).groupBy("bucket").applyInArrow(run, _STATE)


def seat(batches: DataFrame, parts: int, context_parts: int, groups: int = 1, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[DataFrame, dict]:
    """The model's table (a row for each bucket), and the totals over all buckets with the table of all contexts' totals."""
    spark = batches.sparkSession
    state = materialize(_counts(batches, parts, groups).groupBy("bucket").applyInArrow(_seated, _STATE))
    kept, contexts = [], []
    sums = _sums(state)
    for sweep in range(burn_in + samples):
        last, state = state, materialize(_swept(state, context_parts, sums, sweep, sweep >= burn_in))
        discard(last)
        del last
        forget(spark)
        sums = _sums(state)
        if sweep >= burn_in:
            kept.append(sums)
            contexts.append(materialize(_context_totals(state, context_parts, False).select(F.lit(len(kept) - 1).alias("sample"), "bucket", "entries", "data")))
    all_contexts = contexts[0]
    for c in contexts[1:]:
        all_contexts = all_contexts.union(c)
    return state, {"parts": parts, "context_parts": context_parts, "sums": np.array(kept), "contexts": all_contexts}


def fit(training: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """A model of all rows: see seat(); the totals also hold its vocabulary."""
    parts, context_parts, groups = bucket_count(training, text_col)
    batches, vocabulary = encode(training, parts, F.lit(True), None, id_col, text_col)
    model, totals = seat(batches, parts, context_parts, groups, burn_in, samples)
    return model, totals | {"vocabulary": vocabulary}


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the asked ones stand in the sorted keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in values[low:high], each sorted by itself: bisection of all at once."""
    low, end, high = low.copy(), high, high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        less = values[mid] < asked[live]
        low[live], high[live] = np.where(less, mid + 1, low[live]), np.where(less, high[live], mid)
        live = live[low[live] < high[live]]
    at = np.minimum(low, max(len(values) - 1, 0))
    return at, (low < end) & (values[at] == asked) if len(values) else np.zeros(len(asked), bool)


class Bucket:
    """A bucket of the model, or none: looks words and contexts up."""

    def __init__(self, samples: int, r: dict | None = None):
        one = np.zeros(1, np.int64)
        self.word = self.pair = self.context = np.empty(0, np.uint64)
        self.start = np.zeros(2, np.int64)
        self.of_word, self.of_pair, self.of_entry = [one] * (1 + 2 * samples), [one] * (2 * samples), [one] * (1 + samples)
        if r is None:
            return
        at, _ = _restored(r)
        self.word, self.pair, self.context = at.words[at.new_word], at.pairs, at.contexts
        self.start = np.concatenate((np.flatnonzero(at.new_pair), [len(at.words)]))
        self.of_word, self.of_pair, self.of_entry = [np.add.reduceat(at.counts, np.flatnonzero(at.new_word))], [], [at.counts]
        for raw in r["kept"]:
            at.t, at.pair_t, at.root = (x.astype(np.int64) for x in _spread(raw, (np.uint32, r["entries"]), (np.uint32, len(at.pairs)), (np.uint32, r["words"])))
            c, customers = at.customers()
            self.of_word += [customers, at.root]
            self.of_pair += [c, at.pair_t]
            self.of_entry.append(at.t)

    def __call__(self, words: np.ndarray, contexts: np.ndarray) -> tuple[list, list, list]:
        """Of the distinct words, in order: count, and customers and tables at the root in each sample; of all: customers and tables in the
        class in each sample; of all: customers in the context, and tables there in each sample."""
        word, has_word = _find(self.word, words[_firsts(words)])
        pair, has_pair = _find(self.pair, words | (contexts & _LOW))
        entry, has = _within(self.context, np.where(has_pair, self.start[pair], 0), np.where(has_pair, self.start[pair + 1], 0), contexts)
        return tuple([np.where(ok, v[at], 0) for v in values] for at, ok, values in ((word, has_word, self.of_word), (pair, has_pair, self.of_pair), (entry, has, self.of_entry)))


def predictive(of_word: list, of_pair: list, of_entry: list, of_context: list, classes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The averaged probability of words; of_context: customers of the context and its tables in each sample. In an unknown context it is the class's."""
    q = 0.0
    for s, total in enumerate(sums):
        seats, tables = total[:CLASSES], total[CLASSES : 2 * CLASSES]
        root = (of_word[1 + 2 * s] - ROOT_DISCOUNT * of_word[2 + 2 * s] + (ROOT_STRENGTH + ROOT_DISCOUNT * total[-3]) / (total[-2] + 1)) / (tables.sum() + ROOT_STRENGTH)
        of_class = (of_pair[2 * s] - DISCOUNT * of_pair[2 * s + 1] + (STRENGTH + DISCOUNT * tables[classes]) * root) / (seats[classes] + STRENGTH)
        q = q + (of_entry[0] - DISCOUNT * of_entry[1 + s] + (STRENGTH + DISCOUNT * of_context[1 + s]) * of_class) / (of_context[0] + STRENGTH)
    return q / len(sums)


def _asks(batches: DataFrame, parts: int, context_parts: int, splits: dict[int, int], id_type: str) -> DataFrame:
    """What the batches ask the word and the context buckets."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for r, ids in zip(b.drop_columns(["ids"]).to_pylist(), b.column("ids"), strict=True):
                batch, spot, out = r["batch"], _spot(r["batch"]), []
                words, contexts, bucket, *_ = _entries(r, len(ids.values), parts)
                for k, s, e in _slices(bucket, parts):
                    count, columns = _pack(words[s:e], contexts[s:e])
                    out.append((_WORDS, k, spot % splits.get(k, 1), batch, count, e - s, _squeeze(*columns)))
                known = np.unique(contexts)
                to = _buckets(known, context_parts)
                order = np.argsort(to, kind="stable")
                out += [(_CONTEXTS, k, 0, batch, 0, e - s, _squeeze(known[order[s:e]])) for k, s, e in _slices(to[order], context_parts)]
                yield _rows(out, None, ids.values.type)

    return batches.mapInArrow(run, _schema(id_type))


def _answered(samples: int, id_type: str):
    """What a bucket answers: its model's or its contexts' rows meet the asking ones."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        rows, out = t.drop_columns(["ids"]).to_pylist(), []
        own = [r for r in rows if r["batch"] < 0]
        asking = [r for r in rows if r["batch"] >= 0]
        if kind == _WORDS:
            look = Bucket(samples, own[0] if own else None)
            for r in asking:
                words, contexts, _ = _unpack(r["data"], r["words"], r["entries"])
                per = np.diff(np.concatenate((np.flatnonzero(_firsts(words)), [len(words)]))).astype(np.uint32)
                out.append((r, _squeeze(per, *(x.astype(np.uint32) for values in look(words, contexts) for x in values))))
        else:
            keys, values = np.empty(0, np.uint64), [np.zeros(1, np.int64)] * (samples + 1)
            for r in own:  # the same contexts, sorted, for each sample
                keys, values[0], values[-r["batch"]] = _spread(r["data"], (np.uint64, r["entries"]), (np.int64, r["entries"]), (np.int64, r["entries"]))
            for r in asking:
                (u,) = _spread(r["data"], (np.uint64, r["entries"]))
                at, has = _find(keys, u)
                out.append((r, _squeeze(*(np.where(has, x[at], 0) for x in values))))
        return pa.Table.from_batches([_rows([(kind, r["bucket"], 0, r["batch"], r["words"], r["entries"], x) for r, x in out], None, t.schema.field("ids").type.value_type)])

    return run, _schema(id_type)


def _scored(parts: int, context_parts: int, sums: np.ndarray):
    """The rows of a batch, from all answers."""
    samples = len(sums)

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.drop_columns(["ids"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        ids = next(x for x in t.column("ids") if x.is_valid).values
        words, contexts, _, _, place, lengths = _entries(rows[-1], len(ids), parts)
        answers = []
        for r in rows:
            if r["kind"] == _WORDS:
                w, e = r["words"], r["entries"]
                per, *values = _spread(r["data"], (np.uint32, w), *[(np.uint32, w)] * (1 + 2 * samples), *[(np.uint32, e)] * (1 + 3 * samples))
                answers.append([np.repeat(x, per) for x in values[: 1 + 2 * samples]] + values[1 + 2 * samples :])
        values = [np.concatenate([a[i] for a in answers]).astype(np.float64) for i in range(2 + 5 * samples)]
        told = [_spread(r["data"], *[(np.int64, r["entries"])] * (1 + samples)) for r in rows if r["kind"] == _CONTEXTS]
        known, of = np.unique(contexts, return_inverse=True)
        order, of_context = np.argsort(_buckets(known, context_parts), kind="stable"), []
        for i in range(1 + samples):
            x = np.empty(len(known))
            x[order] = np.concatenate([y[i] for y in told])
            of_context.append(x[of])
        logs = np.log10(predictive(values[: 1 + 2 * samples], values[1 + 2 * samples : 1 + 4 * samples], values[1 + 4 * samples :], of_context, (contexts & _LOW).astype(np.int64), sums))
        base = np.log10((values[0] + 1.0) / (sums[0, -1] + sums[0, -2] + 1.0))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)  # every row has its end token
        logs, base, known = (np.add.reduceat(x[place], starts) for x in (logs, base, (values[0] > 0).astype(np.int64)))
        return pa.table({"doc_id": ids, "n_tokens": pa.array(lengths.astype(np.int64)), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(logs)})

    return run


def score_batches(batches: DataFrame, model: DataFrame, totals: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of the batches."""
    parts, sums, id_type = totals["parts"], totals["sums"], batches.schema["ids"].dataType.elementType.simpleString()
    loads = {r["bucket"]: r["tokens"] for r in model.select("bucket", "tokens").collect()}  # a row for each of `parts` buckets
    mean = max(1.0, sum(loads.values()) / parts)
    splits = {b: int(-(-n // (1.5 * mean))) for b, n in loads.items() if n > 1.5 * mean}
    copies = F.coalesce(F.create_map(*[F.lit(x) for kv in splits.items() for x in kv])[F.col("bucket")], F.lit(1)) if splits else F.lit(1)
    known = _told(model.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))), _WORDS, id_type, split=F.col("copy"), words=F.col("words"))
    rows = _asks(batches, parts, totals["context_parts"], splits, id_type).union(known).union(_told(totals["contexts"], _CONTEXTS, id_type, batch=-1 - F.col("sample")))
    run, schema = _answered(len(sums), id_type)
    answered = rows.groupBy("kind", "bucket", "split").applyInArrow(run, schema)
    out = answered.unionByName(batches).groupBy("batch").applyInArrow(_scored(parts, totals["context_parts"], sums), f"doc_id {id_type}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(sums[0, -1])).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score(docs: DataFrame, model: DataFrame, totals: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of any rows under a model of fit()."""
    return score_batches(encode(docs, totals["parts"], None, totals["vocabulary"], id_col, text_col)[0], model, totals)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One encoding serves both: the model learns from the batches' training rows, and scores them all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts, context_parts, groups = bucket_count(docs)
    batches, _ = encode(docs, parts, fold(F.col("doc_id"), 7) != 2)
    model, totals = seat(batches, parts, context_parts, groups)
    return score_batches(batches, model, totals).select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
