"""Per-user features of an event log (user_id, timestamp, action, ip_address, device_id, optional enforced, event_id).

Every group returns one row a user.  The groups that need an order within a
user look at slices of a user's time (``sliced``), so that a user with very many
events is the work of many tasks; ``feature_matrix`` joins the groups on user_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FeatureParams
from ..functions import micros
from . import sliced

MINUTE = 60_000_000


def _tie(df: DataFrame) -> list[str]:
    return ["event_id"] if "event_id" in df.columns else [c for c in ("action", "ip_address", "device_id") if c in df.columns]


def sliced_events(df: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Events in slices of (user, time), with the halo that the widest window needs: what the groups below share."""
    widest = max(*p.windows, p.session_gap_minutes) * MINUTE
    return sliced.cut(df, micros(F.col("timestamp")), sliced.SLICES_PER_WINDOW * widest, widest)


def _sliced(df: DataFrame, p: FeatureParams) -> DataFrame:
    return df if "_halo" in df.columns else sliced_events(df, p)


def _whole(df: DataFrame) -> DataFrame:
    """Each event once."""
    return df.where(~F.col("_halo")) if "_halo" in df.columns else df


def rolling_counts(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Adds ``n_<w>m``: non-null actions in (t - w minutes, t]; of rows with equal times only those not later in order count."""
    own = [c for c in df.columns if c not in ("_t", "_slice", "_halo")]
    # a user's events of one time stand in one slice
    peers = Window.partitionBy("user_id", "_slice", "_t")
    upto = peers.orderBy(*_tie(df)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sliced.trailing(_sliced(df, FeatureParams(windows=windows)), "user_id", **{f"n_{w}m": (F.col("action"), w * MINUTE - 1) for w in windows})
    later = F.count("action").over(peers) - F.count("action").over(upto)
    return counted.withColumn("_later", later).select(*own, *((F.col(f"n_{w}m") - F.col("_later")).alias(f"n_{w}m") for w in windows))


def action_frequency(df: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """action_freq_<w>m_mean and _max for each rolling window."""
    counted = rolling_counts(df, p.windows)
    parts = [f(f"n_{w}m").cast("double").alias(f"action_freq_{w}m_{name}") for w in p.windows for name, f in (("mean", F.avg), ("max", F.max))]
    return counted.groupBy("user_id").agg(*parts)


def ip_entropy(df: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """ip_entropy (bits; 0 below the minimum of events) and unique_ip_count.

    Shares are of all events, those without address included, so they may sum to less than 1.
    """
    n, held = F.col("n").cast("double"), F.col("ip_address").isNotNull() & (F.col("n") > 0)
    sums = _whole(df).groupBy("user_id", "ip_address").agg(F.count("action").alias("n")).groupBy("user_id").agg(
        F.sum("n").alias("_total"), F.sum(F.when(held, n)).alias("_held"), F.sum(F.when(held, n * F.log2(n))).alias("_spread"), F.count("ip_address").alias("unique_ip_count"), F.count(F.when(held, 1)).alias("_kinds")
    )
    # the sum of -n/N log2(n/N), in sums that need no order and no second look at a user's addresses
    bits = F.when((F.col("_kinds") == 1) & (F.col("_held") == F.col("_total")), 0.0).otherwise((F.log2(F.col("_total").cast("double")) * F.col("_held") - F.col("_spread")) / F.col("_total"))
    return sums.select("user_id", F.when(F.col("_total") >= p.min_events_for_entropy, F.coalesce(bits, F.lit(0.0))).otherwise(0.0).alias("ip_entropy"), "unique_ip_count")


def device_reuse(df: DataFrame) -> DataFrame:
    """device_reuse_score and max_device_sharing, over the distinct devices of a user.

    A device's excess is the number of its users less one; the mean over a user's devices is divided by the largest mean.
    """
    owned = _whole(df).select("user_id", "device_id").distinct()
    sharing = owned.where("device_id is not null").groupBy("device_id").agg((F.count("*") - 1).alias("excess"))
    per_user = owned.join(sharing, "device_id", "left").groupBy("user_id").agg(F.avg("excess").alias("_mean"), F.max("excess").cast("double").alias("max_device_sharing"))
    top = per_user.agg(F.max("_mean").alias("_top")).withColumn("_one", F.lit(1))
    score = F.when(F.col("_top") > 0, F.col("_mean") / F.col("_top")).otherwise(F.col("_mean"))
    # one row on the broadcast side
    return per_user.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").select("user_id", score.alias("device_reuse_score"), "max_device_sharing")


def sessions(df: DataFrame, gap_minutes: int) -> DataFrame:
    """user_id, session_start, n_events, duration_s; a gap of exactly ``gap_minutes`` still belongs to the session."""
    gap = gap_minutes * MINUTE
    found = sliced.sessions(_whole(df) if "_halo" in df.columns else sliced.cut(df, micros(F.col("timestamp")), 24 * gap), "user_id", gap, F.col("action"))
    return found.select("user_id", F.timestamp_micros("_start").alias("session_start"), F.col("_n").alias("n_events"), ((F.col("_end") - F.col("_start")) / 1e6).alias("duration_s"))


def session_velocity(df: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """session_velocity_mean, _max (events a second, capped) and session_count."""
    speed = F.when(F.col("duration_s") > 0, (F.col("n_events") - 1) / F.col("duration_s")).otherwise(0.0)
    capped = sessions(df, p.session_gap_minutes).withColumn("v", F.least(speed, F.lit(p.velocity_cap)))
    return capped.groupBy("user_id").agg(F.avg("v").alias("session_velocity_mean"), F.max("v").alias("session_velocity_max"), F.count("*").alias("session_count"))


def enforcement_rate(df: DataFrame) -> DataFrame:
    """enforcement_rate, total_enforcements, total_events; zeros where the log has no ``enforced``."""
    enforced: Column = F.coalesce(F.sum("enforced"), F.lit(0)) if "enforced" in df.columns else F.lit(0)
    out = _whole(df).groupBy("user_id").agg(enforced.cast("long").alias("total_enforcements"), F.count("action").alias("total_events"))
    return out.select("user_id", F.when(F.col("total_events") > 0, F.col("total_enforcements") / F.col("total_events")).otherwise(0.0).alias("enforcement_rate"), "total_enforcements", "total_events")


def feature_names(p: FeatureParams = FeatureParams()) -> list[str]:
    rolling = [f"action_freq_{w}m_{x}" for w in p.windows for x in ("mean", "max")]
    return [*rolling, "ip_entropy", "unique_ip_count", "device_reuse_score", "max_device_sharing", "session_velocity_mean", "session_velocity_max", "session_count", "enforcement_rate", "total_enforcements", "total_events"]


def feature_matrix(df: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """user_id and all features as doubles without nulls; one exchange of the events, by user and slice of time, serves all groups.

    No step needs all events of a user in one task: windows stay within slices, all else is sums of partial sums.
    """
    dealt = sliced_events(df, p).repartition("user_id", "_slice")
    groups = [action_frequency(dealt, p), ip_entropy(dealt, p), device_reuse(dealt), session_velocity(dealt, p), enforcement_rate(dealt)]
    out = groups[0]
    for group in groups[1:]:
        out = out.join(group, "user_id", "full_outer")
    return out.select("user_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_names(p)))
