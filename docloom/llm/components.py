"""Connected components over an edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges(a, b); component is the smallest node that is reached.

    Each round hooks every node to its least neighbour, follows the hooks to their roots and renames
    the edges by the roots.  At least the nodes that are no local minimum disappear, and edges within a
    component go, so a few rounds do.  Neighbours are combined before the shuffle, never collected.
    """
    open_edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = materialise(open_edges.select(F.col("a").alias("node")).union(open_edges.select("b")).distinct().withColumn("component", F.col("node")), "cc-labels")
    while not open_edges.isEmpty():
        both = open_edges.union(open_edges.select("b", "a"))
        hooks = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")), "cc-hooks")
        while True:
            above = hooks.select(F.col("node").alias("mid"), F.col("up").alias("top"))
            higher = hooks.select(F.col("node").alias("mid2"), F.col("up").alias("top2"))
            two = hooks.join(above, F.col("up") == F.col("mid")).join(higher, F.col("top") == F.col("mid2"))
            next_hooks = materialise(two.select("node", F.col("top2").alias("up"), (F.col("top2") != F.col("up")).alias("moved")), "cc-hooks")
            moved = not next_hooks.filter("moved").isEmpty()
            release(hooks)
            hooks = next_hooks.select("node", "up")
            if not moved:
                break
        up = hooks.select(F.col("node").alias("at"), "up")
        known, seen = labels, open_edges
        labels = materialise(labels.join(up, labels.component == up["at"], "left").select("node", F.coalesce("up", "component").alias("component")), "cc-labels")
        left = open_edges.join(up, open_edges.a == up["at"]).select(F.col("up").alias("a"), "b")
        renamed = left.join(up, left.b == up["at"]).select("a", F.col("up").alias("b"))
        open_edges = materialise(renamed.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        release(known, seen, hooks)
    release(open_edges)
    return labels
