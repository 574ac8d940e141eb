"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import scratch_path


def _stored(edges: DataFrame, label: str) -> DataFrame:
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, label)
    edges.write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v`` edges; the root is the least node reachable.

    Large-star and small-star steps in turn: every node tells its larger, then
    its smaller neighbours the least node it knows. The number of edges never
    grows, the least neighbour is a combinable aggregate, and a node with many
    edges is split by the skew join. Each round is written to the shared
    folder, so a lost executor costs a round at most.
    """
    larger, smaller = F.greatest("u", "v"), F.least("u", "v")
    current = edges.where("u <> v").select(larger.alias("u"), smaller.alias("v")).distinct()
    current = _stored(current, "edges")
    before = _state(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        told = large.join(least, "u")
        small = told.select("u", F.col("m").alias("v")).union(
            told.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        current = _stored(small.distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
