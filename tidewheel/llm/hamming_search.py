"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each coordinate, set where it is positive, in as many 64-bit words as the longest
vector needs. The codes are cut into segments, and each segment value points to the codes that have it. A query
looks up, segment by segment, all values within a radius that grows by one after each round; found codes are
verified with the whole Hamming distance. After segment a of radius r, a code not yet found differs in at least
m·r + a + 1 bits, m the number of segments; the search ends when the k-th best verified distance is at most
m·r + a, so the result is exact.

The codes stay where they are: every partition indexes its own codes once (equal codes once, with their k least
ids) and answers all queries, which are broadcast in blocks of bounded size and read one block at a time; the best
k of all partitions are kept. Rows of one code, however many, cost a partition one entry, and at most k answers a
query. Segments are 16 bits wide where a partition has over WIDE codes, else 8; that changes no result.

Rows: null or empty vectors and null ids take no part, as rows or as queries; a coordinate that is null or
missing gives a zero bit; ids are of any type with an order; ties go by id; repeated rows are each found; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, table

K = 10
EVERY = 100
#: Queries that are broadcast at a time (about; they are dealt to blocks by hash).
BLOCK = 8192
WIDE = 20_000


def binary_codes(vectors: list, words: int) -> np.ndarray:
    """Codes of so many 64-bit words, a row for each vector."""
    on = np.zeros((len(vectors), 64 * words), np.uint8)
    for i, v in enumerate(vectors):
        x = np.array([0.0 if c is None else c for c in v], np.float64)
        on[i, : len(x)] = x > 0
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, code (its words as bytes)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and size(v) > 0")
    words = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 1) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in binary_codes(b.column(1).to_pylist(), words)], pa.binary())], names=["id", "code"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, code binary")


def _codes_of(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)


class Index:
    """Multi-index of a partition's distinct codes."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        for w in range(code.shape[1]):
            order = order[np.argsort(code[order, w], kind="stable")]
        ids, code = ids[order], code[order]
        self.start = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]).any(axis=1))))
        self.end = np.concatenate((self.start[1:], [len(code)]))
        self.ids, self.code, self.k = ids, code[self.start], k
        self.width = 16 if len(self.code) > WIDE else 8
        self.m = 64 * code.shape[1] // self.width
        self.masks = [np.array([sum(1 << b for b in on) for on in combinations(range(self.width), r)], np.int64) for r in range(self.width + 1)]
        self.tables = []
        for s in range(self.m):
            value = self._segment(self.code, s)
            by = np.argsort(value, kind="stable")
            self.tables.append((by, np.searchsorted(value[by], np.arange((1 << self.width) + 1))))

    def _segment(self, code: np.ndarray, s: int):
        word, at = divmod(s * self.width, 64)
        return ((code[..., word] >> np.uint64(at)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, own, query: np.ndarray) -> list[tuple]:
        """The k least (distance, id) other than the query's own id."""
        k, seen = self.k, np.zeros(len(self.code), bool)
        distances, rows, sizes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for r in range(self.width + 1):
            for s in range(self.m):
                by, cuts = self.tables[s]
                value = int(self._segment(query, s)) ^ self.masks[r]
                lo, hi = cuts[value], cuts[value + 1]
                full = hi > lo
                if full.any():
                    new = np.concatenate([by[a:b] for a, b in zip(lo[full], hi[full], strict=True)])
                    new = new[~seen[new]]
                    seen[new] = True
                    rows = np.concatenate((rows, new))
                    distances = np.concatenate((distances, np.bitwise_count(self.code[new] ^ query).sum(axis=1, dtype=np.int64)))
                    sizes = np.concatenate((sizes, self.end[new] - self.start[new]))
                near = distances <= self.m * r + s
                if int(sizes[near].sum()) > k:  # one more than k: the query itself may be among them
                    return self._best(own, rows[near], distances[near])
        return self._best(own, rows, distances)

    def _best(self, own, rows: np.ndarray, distances: np.ndarray) -> list[tuple]:
        found: list[tuple] = []
        for d in np.unique(distances):
            ring = rows[distances == d]
            ids = np.concatenate([self.ids[a : min(b, a + self.k + 1)] for a, b in zip(self.start[ring], self.end[ring], strict=True)])
            found += [(int(d), i) for i in np.sort(ids[ids != own]).tolist()]
            if len(found) >= self.k:
                break
        return found[: self.k]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, neighbor_id, distance, rank from tables of codes() over the same number of words."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType
    asked = queries.dropDuplicates(["id", "code"])
    blocks, shared = -(-asked.count() // BLOCK), []
    for n in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id", "code"), F.lit(blocks)) == n).collect()  # about BLOCK rows
        shared.append(spark.sparkContext.broadcast(([r["id"] for r in mine], [bytes(r["code"]) for r in mine])))
    id_type, of_id = kind.simpleString(), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), _codes_of(b.column(1))) for b in batches if b.num_rows]
        if not parts:
            return
        index = Index(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k)
        for block in shared:
            for q, code in zip(*block.value, strict=True):
                hits = index.search(q, np.frombuffer(code, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(hits), of_id), pa.array([code] * len(hits), pa.binary()), pa.array([h[1] for h in hits], of_id), pa.array([h[0] for h in hits], pa.int32())], names=["query_id", "query_code", "neighbor_id", "distance"])

    found = rows.mapInArrow(run, f"query_id {id_type}, query_code binary, neighbor_id {id_type}, distance int")
    order = Window.partitionBy("query_id", "query_code").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "neighbor_id", "distance", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(codes(table(spark, sf_dir, "embeddings")))
    return top_k(rows, rows.where(F.col("id") % EVERY == 0))


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: coalesce(x, 0) > 0) as bits from embeddings where vec_id is not null and len(embedding) > 0),
 d as (select q.vec_id as query_id, r.vec_id as neighbor_id, list_sum(list_transform(list_zip(q.bits, r.bits), lambda p: (coalesce(p[1], false) <> coalesce(p[2], false))::int))::int as distance
       from v q join v r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id),
 k as (select *, row_number() over (partition by query_id order by distance, neighbor_id)::int as rank from d)
select * from k where rank <= 10
"""
