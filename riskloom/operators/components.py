"""Connected components of a graph given as edges, for operators that group what is linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, settled


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node it is connected with), for every node of ``edges`` (a, b).

    Each round takes the smallest label among the neighbours, then the label of that label (pointer jumping), until
    none changes; labels only fall, so that this ends, and rounds grow with the logarithm of the longest path.  A hub
    is a neighbour, and a label, of many rows: the sides of both joins are written first, so that a join deals them
    out by itself and can split such a key over tasks.
    """
    pairs = edges.toDF("node", "to")
    both = durable(pairs.union(pairs.select("to", "node")).distinct())
    labels = settled(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")))
    while True:
        around = both.join(labels.toDF("to", "near"), "to").groupBy("node").agg(F.min("near").alias("near"))
        moved = settled(labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        top = moved.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = settled(moved.join(top, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "was"))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
