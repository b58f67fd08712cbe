"""Connected components of an edge table, by smallest label with short-cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.tables import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so chains halve;
    all rounds run on written tables, of which the old ones are deleted, and only whether a label changed comes to the driver.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = written(labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        up = hooked.select(F.col("node").alias("parent"), F.col("root").alias("above"))
        jumped = hooked.join(up, hooked["root"] == up["parent"], "left").select("node", "old", F.least("root", "above").alias("root"))
        after = written(jumped, "labels")
        removed(hooked)
        removed(labels)
        if not after.where("root != old").limit(1).count():
            removed(both)
            return after.select("node", "root")
        labels = after.select("node", "root")
