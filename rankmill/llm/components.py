"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.session import settle


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component. edges: `a`, `b` (whole numbers), any order, repeats allowed.

    In every round a node takes the least label around it, and then the label of
    its label, so long chains halve. Rounds go on until nothing changes; each is
    written to the shared folder, so a lost executor repeats one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both.where("a <> b"))
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        following = stepped.join(jump, F.col("next") == F.col("at"), "left").select(
            "node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")
        )
        following = settle(following)
        labels = following.select("node", "label")
        if following.where("moved").isEmpty():
            return labels
