"""Rings of accounts: a user-user graph over shared addresses and devices, its components and their risk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..config import ClusterParams
from ..functions import micros
from .components import components as linked
from .durable import durable
from .louvain import louvain
from .pairs import shared
from .quantile import quantile, written


def nodes(events: DataFrame) -> DataFrame:
    """user_id, event_count, unique_ips, unique_devices."""
    return events.groupBy("user_id").agg(F.count("*").alias("event_count"), F.countDistinct("ip_address").alias("unique_ips"), F.countDistinct("device_id").alias("unique_devices"))


def signals(events: DataFrame, p: ClusterParams = ClusterParams()) -> DataFrame:
    """Distinct (kind, value, user_id) without nulls and excluded values."""
    one = lambda kind, c: events.select(F.lit(kind).alias("kind"), F.col(c).alias("value"), "user_id")
    both = one("ip", "ip_address").unionByName(one("device", "device_id")).where("value is not null and user_id is not null").distinct()
    return both.where(~F.col("value").isin(*p.exclude_signals)) if p.exclude_signals else both


def shared_signals(events: DataFrame, p: ClusterParams = ClusterParams(), heavy: int = 1000) -> DataFrame:
    """src < dst, shared_ips, shared_devices, total_shared for pairs with enough in common; signals of more than ``heavy`` users by classes."""
    found = shared(signals(events, p), p.min_shared_signals, heavy)
    return found.select("src", "dst", F.col("ip").alias("shared_ips"), F.col("device").alias("shared_devices"), (F.col("ip") + F.col("device")).alias("total_shared"))


@F.pandas_udf(LongType())
def _not_later(early: pd.Series, late: pd.Series) -> pd.Series:
    """Pairs of two sorted lists in which the second is not above the first: a binary search for each of the first."""
    return pd.Series([int(np.searchsorted(y, x, "right").sum()) for x, y in zip(early, late, strict=True)], dtype="int64")


#: Times of a user and bin that one row holds.
CHUNK = 4096


def temporal_overlap(events: DataFrame, pairs: DataFrame, hours: float) -> DataFrame:
    """src, dst, temporal_overlap: the share of event pairs of two users that lie within ``hours`` of each other.

    Times are dealt to bins of that width.  Two events of one bin are always near, so counts tell; those of neighbouring bins
    are near if the later one stands no later in its bin, which sorted offsets tell, ``CHUNK`` at most in a row; all others are
    too far apart.  No row holds all times of a user, and none stands for one pair of events.  Without times the share is 0.
    """
    width = int(hours * 3_600_000_000)
    if width <= 0:
        raise ValueError("hours has to be positive")
    timed = events.select("user_id", micros(F.col("timestamp")).alias("t")).where("t is not null")
    timed = timed.select("user_id", F.floor(F.col("t") / width).cast("long").alias("bin"), F.pmod("t", F.lit(width)).alias("offset"))
    bins = durable(timed.groupBy("user_id", "bin").agg(F.count("*").alias("n")))
    chunk = F.pmod(F.xxhash64("offset"), F.ceil(F.col("n") / CHUNK))
    lists = durable(timed.join(bins, ["user_id", "bin"]).groupBy("user_id", "bin", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("offset")).alias("offsets")))
    both = durable(pairs.select("src", "dst"))
    side = lambda df, user, *more: df.select(F.col("user_id").alias(user), "bin", *more)
    same = both.join(side(bins, "src", F.col("n").alias("a")), "src").join(side(bins, "dst", F.col("n").alias("b")), ["dst", "bin"]).select("src", "dst", (F.col("a") * F.col("b")).alias("near"))

    def neighbours(early: str, late: str) -> DataFrame:
        """Pairs of an event of ``early`` and one of ``late`` in the next bin."""
        first = both.join(side(lists, early, F.col("offsets").alias("x")), early).withColumn("bin", F.col("bin") + 1)
        return first.join(side(lists, late, F.col("offsets").alias("y")), [late, "bin"]).select("src", "dst", _not_later("x", "y").alias("near"))

    near = same.unionByName(neighbours("src", "dst")).unionByName(neighbours("dst", "src")).groupBy("src", "dst").agg(F.sum("near").alias("near"))
    total = bins.groupBy("user_id").agg(F.sum("n").cast("double").alias("n"))
    out = both.join(near, ["src", "dst"], "left").join(total.toDF("src", "na"), "src", "left").join(total.toDF("dst", "nb"), "dst", "left")
    return out.select("src", "dst", F.coalesce(F.try_divide(F.col("near").cast("double"), F.col("na") * F.col("nb")), F.lit(0.0)).alias("temporal_overlap"))


def edges(events: DataFrame, p: ClusterParams = ClusterParams()) -> DataFrame:
    """src, dst, shared_ips, shared_devices, total_shared, temporal_overlap, weight = tanh(total) * (0.5 + 0.5 * overlap)."""
    pairs = durable(shared_signals(events, p))  # read twice
    out = pairs.join(temporal_overlap(events, pairs, p.temporal_window_hours), ["src", "dst"])
    return out.withColumn("weight", F.tanh(F.col("total_shared").cast("double")) * (0.5 + 0.5 * F.col("temporal_overlap")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """user_id, cluster_id: the smallest user that one is connected with; nodes without edges stand alone."""
    label = linked(edges.select("src", "dst")).toDF("user_id", "label")
    return nodes.select("user_id").join(label, "user_id", "left").select("user_id", F.coalesce("label", "user_id").alias("cluster_id"))


def communities(nodes: DataFrame, edges: DataFrame, method: str = "components") -> DataFrame:
    """user_id, cluster_id by ``method``: connected components, or ``louvain`` communities within them by ``weight``."""
    if method == "components":
        return components(nodes, edges)
    if method != "louvain":
        raise ValueError(f"method is components or louvain, not {method}")
    label = louvain(edges.select("src", "dst", "weight")).toDF("user_id", "label")
    return nodes.select("user_id").join(label, "user_id", "left").select("user_id", F.coalesce("label", "user_id").alias("cluster_id"))


def signal_components(events: DataFrame, p: ClusterParams = ClusterParams()) -> DataFrame:
    """The same components for min_shared_signals = 1 without making pairs: users of a signal link to its smallest user.

    A signal shared by n users gives n rows instead of n * (n - 1) / 2, so very common signals do no harm.
    """
    if p.min_shared_signals > 1:
        raise ValueError("pairs have to be counted for more than one shared signal")
    seen = signals(events, p)
    hubs = seen.groupBy("kind", "value").agg(F.min("user_id").alias("dst"))
    links = seen.join(hubs, ["kind", "value"]).where("user_id <> dst").select(F.col("user_id").alias("src"), "dst").distinct()
    return components(events.select("user_id").distinct(), links)


def cluster_scores(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, size, density, mean_edge_weight, risk_score (0 to 100).

    Risk is 100 times the mean of size, density, mean weight and activity scores, each within 0 and 1.
    """
    p95 = quantile(written(nodes, "event_count"), "event_count", 0.95) or 1.0
    groups = members.join(nodes, "user_id").groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("event_count").alias("mean_events"))
    inner = edges.join(members.toDF("src", "cluster_id"), "src").groupBy("cluster_id").agg(F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight"))
    joined = groups.join(inner, "cluster_id", "left")
    size = F.col("size").cast("double")
    density = F.when(size > 1, 2 * F.coalesce("n_edges", F.lit(0)) / (size * F.greatest(size - 1, F.lit(1.0)))).otherwise(0.0)
    weight = F.coalesce("mean_weight", F.lit(0.0))
    parts = [F.least(F.log2(size + 1) / F.log2(F.lit(101.0)), F.lit(1.0)), density, weight, F.least(F.col("mean_events") / F.lit(p95), F.lit(1.0))]
    risk = F.lit(100.0) * (parts[0] + parts[1] + parts[2] + parts[3]) / 4
    return joined.select("cluster_id", "size", F.bround(density, 4).alias("density"), F.bround(weight, 4).alias("mean_edge_weight"), F.bround(risk, 2).alias("risk_score"))


def with_members(scores: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``members``, sorted."""
    return scores.join(members.groupBy("cluster_id").agg(F.array_sort(F.collect_set("user_id")).alias("members")), "cluster_id")


def escalate(scores: DataFrame, p: ClusterParams = ClusterParams(), threshold: float | None = None) -> DataFrame:
    """Clusters at the threshold or above, marked ``escalated``, highest first."""
    limit = p.risk_threshold if threshold is None else threshold
    return scores.where(F.col("risk_score") >= limit).withColumn("escalated", F.lit(True)).orderBy(F.desc("risk_score"), "cluster_id")
