"""Sharding by jump consistent hashing.

A document's shard follows from its id and the number of shards alone; no ring table is kept. When
shards are appended, a document either stays or moves to one of the new shards, and the share that
moves is the least that evens the load.

Rows: a null id hashes like the empty text; a null text counts no bytes; repeated rows each get a
slot of their own; an empty table gives an empty result; columns other than the id and the text are
not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, table

SHARDS = 40
LCG = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys: the last jump that stays below `shards`."""
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    nxt = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = nxt[live]
            key[live] = key[live] * LCG + np.uint64(1)
            step = 2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            nxt[live] = ((at[live] + 1) * step).astype(np.int64)
            live = live[nxt[live] < shards]
    return at.astype(np.int32)


def shard_key(doc_id):
    """60 bits of the md5 of the id as text, so that keys of any kind are spread evenly."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def assign(key, shards: int):
    """Column expression: the shard of a shard_key()."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).astype(np.uint64), shards), dtype="int32")

    return jump(key)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a partition's rows within each shard, in their order."""
    seen: dict[int, int] = {}
    for b in batches:
        shard = b.column(b.schema.get_field_index("shard")).to_numpy()
        local = np.zeros(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            local[mine] = seen.get(s, 0) + np.arange(len(mine))
            seen[s] = seen.get(s, 0) + len(mine)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "local"])


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots number a shard's rows by id. Rows are sorted by id in range partitions (ties are spread by a
    row number, so one id may hold any share of the rows), numbered there, and moved up by the count of
    the partitions before; no task gets a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = narrow.withColumn("key", shard_key(F.col("doc_id")))
    placed = keyed.withColumn("shard", assign(F.col("key"), shards)).withColumn("grown_shard", assign(F.col("key"), shards + 1)).drop("key")
    placed = materialize(placed).withColumn("row", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange("doc_id", "text_crc32", "row").sortWithinPartitions("doc_id", "text_crc32", "row").drop("row").withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{c}` {kind}" for c, kind in ranged.dtypes) + ", local bigint"
    numbered = materialize(ranged.mapInArrow(_numbered, schema))
    counts = numbered.groupBy("shard", "part").agg(F.max("local").alias("last"))
    before = docs.sparkSession.sql("select shard, part, coalesce(sum(last + 1) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0) as base from {counts}", counts=counts)
    out = numbered.join(before, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("local") + F.col("base")).cast("bigint").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 4, id_col: str = "doc_id") -> None:
    """Writes docs as parquet folders shard=0, 1, ...; about `files` files each, dealt by the ids' hash.

    A column of docs named `shard` stays: the folders are named shard_ then (or with more underscores). Rows with a
    null id go where the empty text goes, repeated rows together; an empty table gives no folder.
    """
    name = "shard"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    placed = docs.withColumn(name, assign(shard_key(docs[id_col]), shards))
    placed.repartition(shards * files, name, F.pmod(F.xxhash64(id_col), F.lit(files))).write.partitionBy(name).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


#: crc32 by its table, bytes from the text's hex digits; jump hashing as a recursion, in 128-bit integers modulo 2^64.
ORACLE_SQL = """
with recursive t as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as tbl),
 d as (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::hugeint as key from documents),
 c as (select row, doc_id, key, len(h) // 2 + 16 as size,
         xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)::bigint as text_crc32 from d, t),
 j as (select row, n, key, 0::bigint as b, 0::bigint as j from c, (values (40), (41)) as s(n)
   union all select row, n, key2, j, floor((j + 1) * (2147483648.0::double / ((key2 >> 33) + 1)::double))::bigint
     from (select row, n, j, (key * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint as key2 from j where j < n)),
 s as (select row, n, max(b) as shard from j group by row, n)
select c.doc_id, c.size::bigint as size, c.text_crc32, 'key' as law, a.shard::int as shard, row_number() over (partition by a.shard order by c.doc_id, c.text_crc32) - 1 as slot, g.shard::int as grown_shard
from c join s a on a.row = c.row and a.n = 40 join s g on g.row = c.row and g.n = 41
"""
