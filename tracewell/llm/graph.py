"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import beside, written


def _with_least(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(a, b)``, some of ``edges``, with ``m``, the smallest neighbour of ``a`` in ``edges``."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    return beside(rows, least, "a", F.col("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges(a, b)``; the label is the smallest node of the component.

    Each step links the larger neighbours of a node to the smallest one of its neighbourhood, then the smaller
    ones; edges never grow in number, and it ends when neither step changes them, after a logarithmic number
    of steps in practice. The smallest neighbour is found by an aggregation that combines before its shuffle, and a node
    with very many neighbours meets it where its edges lie, so no task holds them all. Every step is written to the shared
    folder, so a lost executor costs one step. Self-loops give a node a label of its own; null ends are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    now = written(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = now
    now = now.where("a <> b")
    before = None
    while True:
        # Large star: every neighbour larger than the node is linked to the smallest of node and neighbours.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(_with_least(both, both.where("b > a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "large")
        # Small star: node and smaller neighbours are linked to the smallest of these.
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _with_least(large, large).select(F.explode(pair).alias("e")).select("e.*").where("a <> b").distinct()
        now = written(small, "edges")
        # Both are sets of edges; equal counts and sums of hashes mean equal sets.
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if after == before:
            break
        before = after
    # Now every edge leads from a node to the smallest node of its component.
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    ends = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return ends.join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
