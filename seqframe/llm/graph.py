"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Each star is an aggregate and a join on the node, never a collected
    neighbourhood, so a node with very many edges is split like any skewed
    key. Rounds grow with the logarithm of the longest path; each is written to
    the shared folder. No edge, no row; an edge of a node to itself keeps it.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.where("u <> v").unionAll(now.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(now.where("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        last, now = now, written(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionAll(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        # the same edges again: every node points at its component's smallest
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = state
