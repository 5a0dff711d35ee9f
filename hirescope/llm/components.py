"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.session import written


def _roots(tree: DataFrame) -> DataFrame:
    """Every node's root, by jumping from parent to grandparent: as many rounds as the
    logarithm of the depth, each a row a node."""
    while True:
        up = tree.filter("node <> parent").select(F.col("node").alias("_via"), F.col("parent").alias("_up"))
        step = tree.join(up, F.col("parent") == F.col("_via"), "left")
        tree = written(step.select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")), "tree")
        moved = tree.filter("_moved").limit(1).count()
        tree = tree.select("node", "parent")
        if not moved:
            return tree


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``links``
    (``a``, ``b``).

    Links are contracted. A round keeps each node's link to its smallest neighbour, if
    that is smaller than itself: a forest, one row a node however many links there are,
    whose roots are the smallest of their trees. The other links are then told by the
    roots of their ends; those within a tree drop out, equal ones become one, and what
    is left is the next round's. Every tree that has a link to a smaller one is gone
    after a round. A root with very many nodes is a hot key of the joins by parent, which
    Spark splits, as one of the sides has one row a key.
    """
    rest = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    alone = links.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    labels = None
    while True:
        ends = rest.select(F.col("b").alias("node"), F.col("a").alias("parent")).union(rest.select("a", "a"))
        tree = _roots(written(ends.groupBy("node").agg(F.min("parent").alias("parent")), "tree"))
        if labels is None:
            labels = tree.withColumnRenamed("parent", "component")
        else:
            to = tree.select(F.col("node").alias("_from"), F.col("parent").alias("_to"))
            labels = written(labels.join(to, F.col("component") == F.col("_from"), "left").select(
                "node", F.coalesce("_to", "component").alias("component")), "labels")
        a = tree.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        b = tree.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        between = rest.join(a, "a").join(b, "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        rest = written(between.distinct(), "links")
        if rest.isEmpty():
            return labels.union(alone.join(labels, "node", "left_anti"))
