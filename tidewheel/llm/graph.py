"""Connected components of an edge table, without gathering links or labels on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b), both bigint; root is the least node of the component.

    Alternates large-star and small-star steps (each node's greater neighbours, then its lesser ones, are
    hung on the least node it knows) until the edges are stars; needs about log(diameter) rounds. A node
    with very many neighbours is an ordinary skewed join key, which adaptive execution splits.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        done = e
        e = materialize(small)
        discard(done)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
