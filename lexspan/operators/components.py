"""Connected components by contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.sources.tables import materialise


def pointer_jump(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by its farthest ancestor; each round doubles the reach.

    `parents` has one row per non-root node and no cycles. Rounds: the logarithm of the longest chain.
    """
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        step = materialise(parents.join(up.hint("merge"), "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")))
        parents = step.select("node", "parent")
        if step.where("_moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the least node of the component.

    Rows with a null end are ignored; loops make a node of their own. In every round each node points to its least
    smaller neighbour, chains are shortened by pointer jumping, and edges are contracted to the roots, so at least half
    of the non-root nodes go. Only (node, node) pairs are shuffled, minima are taken before the shuffle, nothing is collected,
    and no side of a join is broadcast, as all of them grow with the edges.
    """
    clean = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = clean.select(F.col("a").alias("node")).union(clean.select(F.col("b").alias("node"))).distinct()
    rest = materialise(clean.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    while not rest.isEmpty():
        parents = pointer_jump(materialise(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))))
        if total is None:
            total = parents
        else:
            moved = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_to"))
            total = total.join(moved.hint("merge"), "parent", "left").select("node", F.coalesce("_to", "parent").alias("parent")).union(parents)
            total = materialise(total)
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        moved_edges = rest.join(pa.hint("merge"), "a", "left").join(pb.hint("merge"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        rest = materialise(moved_edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if total is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(total.hint("merge"), "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
