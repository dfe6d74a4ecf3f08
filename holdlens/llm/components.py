"""Connected components of a graph whose edges stay on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdlens.llm.cluster import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges(a, b)``; label: the smallest node reachable.

    Labels are hooked onto smaller labels of neighbours and short-cut each round,
    so the rounds grow with the logarithm of a component's diameter. The minima of hot nodes are
    partial before they meet; the joins before that read all edges of a node together, unless adaptive execution splits them. No edge: an empty table. Nulls must not occur.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        to = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        of = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        told = both.join(to, "b").join(of, "a")
        offers = told.select(F.explode(F.array("a", "la")).alias("node"), "lb").groupBy("node").agg(F.min("lb").alias("offer"))
        hooked = labels.join(offers, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        beyond = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = cut(hooked.join(beyond, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        labels = after.select("node", "label")
        if after.where(F.col("label") != F.col("old")).isEmpty():
            return labels
