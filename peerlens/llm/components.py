"""Connected components of an edge table by minimum labels with pointer jumping.

Every round is a few joins over (node, label); nothing is collected.  Lineage ends after each round in a
table of the shared folder, so a lost executor repeats one round at most.
"""

from pyspark.sql import functions as F

from peerlens.llm.common import cut


def components(edges):
    """(node, label) for every node of `edges` (a, b); label is the smallest node reachable."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("_l"))
        nearer = labels.join(heard, labels["node"] == heard["_n"]).select(
            "node", F.least("label", "_l").alias("label"), F.col("label").alias("old")
        )
        nearer = cut(nearer, "labels")
        # A label is itself a node of the same component: take that node's label.
        roots = nearer.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = cut(
            nearer.join(roots, nearer["label"] == roots["_n"]).select("node", F.least("label", "_l").alias("label"), "old"),
            "labels",
        )
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
