"""What the text operators share: scratch tables in the shared folder, word hashing, packing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Characters that separate words in the `words` convention of the text operators (ASCII white space).
SPACE = r"[^\x20\x09-\x0D]+"
#: Bytes that a writer of a scratch table holds before they go to disk: packed cells are large.
ROW_GROUP = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/tidewheel-scratch"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors. The files go when the driver ends, or by discard()."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tw-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that materialize() made, once no result needs it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("tw-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Lets the driver drop what finished jobs of a loop left: shuffle files stay on the executors' disks until the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(c):
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash; `trim` keeps it small between batches."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.clear()

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, without copying: what is made of a slice in Python is small, whatever an Arrow batch holds."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; bytes.split() splits at exactly 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but x."""
    return ((mix64(x) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
