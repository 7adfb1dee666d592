"""Connected components by repeated hooking and jumping of labels, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b: longs).

    Each round gives a node, and the node that it is labelled with, the smallest label two steps away of its
    neighbours; rounds are about the logarithm of the longest path. Only links and labels of their nodes move, as
    aggregates; nothing reaches the driver but whether anything changed.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("a", "b"), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        up = labels.select(F.col("node").alias("_up"), F.col("label").alias("jump"))
        two = labels.join(up, F.col("label") == F.col("_up")).select("node", "label", "jump")
        met = edges.join(two.select(F.col("node").alias("b"), F.col("jump").alias("theirs")), "b")
        of = met.groupBy("a").agg(F.min("theirs").alias("least"))
        mine = two.join(of, F.col("node") == F.col("a"), "left").select("node", "label", F.least("jump", "least").alias("least"))
        # a node, and the node above it, both take the least label seen
        offers = mine.select("node", "least").union(mine.select("label", "least"))
        new = offers.groupBy("node").agg(F.min("least").alias("new"))
        step = written(labels.join(new, "node").select("node", F.col("label").alias("old"), F.least("label", "new").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
