"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge reaches.

    Every node hooks to its least neighbour if that is less than itself; the
    chains so made are shortened by pointer jumping until flat, the edges are
    carried over to the roots, and this repeats until no edge is left. At each
    level the roots left are at most half of the nodes that still have edges,
    so levels and jumps are logarithmic. Minima are partial aggregates and joins
    have a side that is unique by key, so a node with very many neighbours gathers
    nowhere. Each step ends in a table in the shared folder.
    """
    spark = edges.sparkSession
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    left = written(edges.select(low, high).where("a <> b").distinct(), "cc-edges")
    labels = None
    while left.take(1):
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-up")
        while True:
            top = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            nxt = written(up.select("node", "root").join(top, "root").select("node", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), "cc-up")
            moved = nxt.where("moved").take(1)
            forget(up)
            up = nxt
            if not moved:
                break
        if labels is None:
            labels = written(up.select("node", F.col("root").alias("component")), "cc-labels")
        else:
            over = up.select(F.col("node").alias("component"), "root")
            old, labels = labels, written(labels.join(over, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "cc-labels")
            forget(old)
        one = left.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        one = one.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, left = left, written(one, "cc-edges")
        forget(old, up)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
