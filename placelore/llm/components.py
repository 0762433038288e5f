"""Connected components of an edge list by contraction: every round at least halves what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids. Returns (node, comp): each node's smallest reachable id. Nothing is collected.

    A round: every node points to its smallest neighbour below it or to itself, pointers are followed once more, and edges
    move to where their ends point. Each round's pointers and edges are written tables, so lineage stays short.
    """
    left = table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = table(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b"), F.col("a")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up"))
        up = table(up, "up")
        higher = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = table(up.join(higher, "up", "left").select("node", F.coalesce("top", "up").alias("to")), "jump")
        labels = table(labels.join(jump.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        to_a, to_b = jump.select(F.col("node").alias("a"), F.col("to").alias("x")), jump.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = table(moved, "edges")
    return labels
