"""Communities of a weighted graph by modularity (Louvain), as rounds of joins over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, settled


def _around(links: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label, shared, loop: what links a node with the nodes of each community around it, and with itself."""
    loop = F.col("node") == F.col("to")
    sums = [F.sum(F.when(loop, 0.0).otherwise(F.col("w"))).alias("shared"), F.sum(F.when(loop, F.col("w")).otherwise(0.0)).alias("loop")]
    return links.join(labels.toDF("to", "label"), "to").groupBy("node", "label").agg(*sums)


def _value(around: DataFrame, here: DataFrame, total: float) -> float:
    """The modularity of the communities of ``here`` (node, label, k) over links that sum up to ``total``."""
    inside = around.join(here, ["node", "label"]).select((F.col("shared") + F.col("loop")).alias("w"))
    degrees = here.groupBy("label").agg(F.sum("k").alias("k"))
    parts = inside.select((F.col("w") / total).alias("x")).unionByName(degrees.select((-F.pow(F.col("k") / total, 2)).alias("x")))
    return float(parts.agg(F.sum("x")).first()[0])


def _moved(links: DataFrame, rounds: int, least: float) -> tuple[DataFrame, float]:
    """Labels of the nodes of one level after local moves, and their modularity.

    ``links`` has every edge both ways and loops twice their weight.  In a round half of the nodes, by a hash, go to the
    neighbouring community that gains most, if any does; neighbours that would swap for ever are parted so.  Moves of one
    round don't see each other, so the best labels are kept.  The links are joined once a round: what is around the nodes
    tells the modularity of their labels, then their moves.
    """
    degree = settled(links.groupBy("node").agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0]
    here = best = degree.withColumn("label", F.col("node"))
    if not total:
        return best.select("node", "label"), 0.0
    around = settled(_around(links, here.select("node", "label")))
    top = _value(around, here, total)
    idle = 0
    for r in range(rounds):
        own = here.withColumnRenamed("label", "own")
        whole = here.groupBy("label").agg(F.sum("k").alias("of_label"))
        # the own community is a choice, too, even without a link into it
        choices = around.select("node", "label", "shared").unionByName(here.select("node", "label", F.lit(0.0).alias("shared"))).groupBy("node", "label").agg(F.sum("shared").alias("shared"))
        gain = F.col("shared") - F.col("k") * (F.col("of_label") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / total
        rated = choices.join(own, "node").join(whole, "label").withColumn("gain", gain)
        picked = rated.groupBy("node").agg(
            F.min(F.struct((-F.col("gain")).alias("loss"), "label")).alias("x"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"), F.min("own").alias("own"), F.min("k").alias("k")
        )
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        goes = turn & (-F.col("x.loss") > F.col("stay") + 1e-12)
        here = settled(picked.select("node", "k", F.when(goes, F.col("x.label")).otherwise(F.col("own")).alias("label")))
        around = settled(_around(links, here.select("node", "label")))
        value = _value(around, here, total)
        idle = 0 if value > top + least else idle + 1
        if value > top:
            best, top = here, value
        if idle == 2:  # neither half of the nodes gains any more
            break
    return best.select("node", "label"), top


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 20, least: float = 1e-6) -> DataFrame:
    """node, label (smallest node of its community) for every node of ``edges`` (a, b, weight), each edge given once.

    Communities of a level are the nodes of the next one, until the modularity gains less than ``least``.  All state is
    a frame by node; weights must not be negative, null weights count as 0.
    """
    one = edges.toDF("node", "to", "w").select("node", "to", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    links = durable(one.unionByName(one.select(F.col("to").alias("node"), F.col("node").alias("to"), "w")).groupBy("node", "to").agg(F.sum("w").alias("w")))
    out, value = settled(links.select("node", F.col("node").alias("label")).distinct()), None
    for _ in range(levels):
        labels, new = _moved(links, rounds, least)
        if value is not None and new <= value + least or labels.where("node <> label").isEmpty():
            break
        value = new
        out = settled(out.withColumnRenamed("label", "at").join(labels.toDF("at", "label"), "at").select("node", "label"))
        links = settled(
            links.join(labels, "node").join(labels.toDF("to", "other"), "to").groupBy(F.col("label").alias("node"), F.col("other").alias("to")).agg(F.sum("w").alias("w"))
        )
    names = out.groupBy("label").agg(F.min("node").alias("name"))
    return out.join(names, "label").select("node", F.col("name").alias("label"))
