"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): for every node of `edges` (a, b), the least node of its component.

    Rounds of least-neighbour labels followed by pointer jumping, each cut to a durable
    table. Both the aggregate (a minimum) and the joins bear hub nodes: the first combines
    before its shuffle, the second is a plain equi-join that AQE can split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(both.where("a <> b").distinct(), f"{name}-links")
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        low = labels.join(near, labels.node == near.n, "left").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        root = labels.select(F.col("node").alias("r"), F.col("label").alias("up"))
        nxt = cut(low.join(root, low.label == root.r, "left").select("node", "was", F.least("label", "up").alias("label")), f"{name}-labels")
        if nxt.where("label <> was").isEmpty():
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def extended(labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of the graph that `labels` (of `components`, or of this) stands for, with new `edges`.

    Only labels are read again, no old edge: new edges become edges between the labels of their
    ends, whose components are few and small, and a label then stands for the least of its component.
    """
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))
    ends = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    lifted = cut(ends.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")), f"{name}-ends")
    joined = components(lifted.select(F.col("x").alias("a"), F.col("y").alias("b")), name).select(F.col("node").alias("was"), F.col("label").alias("now"))
    # New nodes, each under what stood for it so far: itself, as nothing knew it. A loop names no node, as in `components`.
    new = lifted.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    every = labels.select("node", "label").union(new)
    return cut(every.join(joined, every.label == joined.was, "left").select("node", F.coalesce("now", "label").alias("label")), f"{name}-labels")
