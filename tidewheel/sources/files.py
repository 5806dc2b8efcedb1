"""Parquet tables and schema fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_batches(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes the table; a table without columns is an error."""
    if not df.columns:
        raise ValueError("nothing to write: the table has no columns")
    df.write.mode(mode).parquet(path)


def schema_fingerprint(schema: StructType) -> str:
    """Depends on the fields' names, types and nullability, in order."""
    said = ";".join(f"{f.name}|{f.dataType.simpleString()}|{f.nullable}" for f in schema.fields)
    return hashlib.sha256(said.encode()).hexdigest()


def rows_as_named_values(df: DataFrame) -> DataFrame:
    """Each row as an array of (name, value) strings."""
    return df.select(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]).alias("row"))
