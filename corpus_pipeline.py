"""A training corpus from the documents table: five stages, each on all that the one before kept.

toxicity drops toxic documents, near_duplicates keeps one document of each group, decontamination drops
documents that hold benchmark items, mixing takes documents as often as their sources' targets say, and
sharding places what is left. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontamination, mixing, ngram_join, sharding, toxicity
from tidewheel.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more. Rows without text stay, repeated rows share their fate; without labels of both classes all stay or go by the labels' toxic share."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 80 %): the least id, null last. Texts without words stay; rows that share an id, or have none, are told by their texts."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item. Rows without text stay; without items all stay."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets say, nought to twice. Equal rows are taken together; rows without text may be taken, null sources are one source."""
    return mixing.mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row with shard and slot for each document; rows of one id share a shard, each with a slot of its own."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The toxicity models can't be expressed in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
