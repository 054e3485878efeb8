"""The eighteen dashboard extracts.

Each takes the tables and ``as_of``, the moment that counts as now: reports
can be repeated for any past moment, and tests don't depend on the clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import age_cohort, ratio, rounded, width_bucket
from . import investigations as q


class Warehouse(Protocol):
    raw_events: DataFrame
    user_profiles: DataFrame
    aggregated_user_metrics: DataFrame
    time_window_activity: DataFrame
    anomaly_scores: DataFrame
    enforcement_actions: DataFrame
    abuse_clusters: DataFrame
    threshold_history: DataFrame


def _now(as_of: dt.datetime) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def _since(column: str, as_of: dt.datetime, **back: float) -> Column:
    """Rows of the last hours or days before ``as_of``, and any later ones."""
    return F.col(column) >= _now(as_of - dt.timedelta(**back))


def _flagged(column: str = "is_flagged") -> Column:
    return F.sum(F.when(F.col(column), 1).otherwise(0))


def _pct(part: Column, whole: Column) -> Column:
    return rounded(ratio(part * 100, whole), 2)


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def total_flagged_users(t: Warehouse, as_of: dt.datetime) -> DataFrame:
    return t.user_profiles.where("is_flagged").agg(F.countDistinct("user_id").alias("total_flagged_users")).withColumn("computed_at", _now(as_of))


def high_risk_rate_pct(t: Warehouse, as_of: dt.datetime) -> DataFrame:
    newest = q.latest_scores(t.anomaly_scores)
    return newest.agg(F.count("*").alias("total_scored_users"), _flagged().alias("flagged_users"), _pct(_flagged(), F.count("*")).alias("high_risk_rate_pct")).withColumn("computed_at", _now(as_of))


def enforcement_actions_24h(t: Warehouse, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    recent = t.enforcement_actions.where(_since("triggered_at", as_of, hours=hours))
    return recent.groupBy("action_type").agg(F.count("*").alias("action_count"), F.min("triggered_at").alias("earliest"), F.max("triggered_at").alias("latest"))


def false_positive_rate_latest(t: Warehouse, as_of: dt.datetime) -> DataFrame:
    columns = ["metric_name", "threshold_value", "false_positive_rate", "false_negative_rate", "updated_at", "updated_by"]
    return t.threshold_history.where("metric_name = 'combined_risk_score'").orderBy(F.desc_nulls_first("updated_at"), F.desc("threshold_id")).limit(1).select(*columns)


def active_abuse_clusters(t: Warehouse, as_of: dt.datetime, days: int = 7) -> DataFrame:
    recent = t.abuse_clusters.where(_since("detected_at", as_of, days=days) & (F.col("avg_risk_score") > 0.5))
    return recent.select("cluster_id", "detected_at", "cluster_size", rounded(F.col("avg_risk_score"), 4).alias("avg_risk_score"), "cluster_label", "shared_ips", "shared_devices")


def avg_risk_score_all_users(t: Warehouse, as_of: dt.datetime) -> DataFrame:
    s = "combined_risk_score"
    newest = q.latest_scores(t.anomaly_scores)
    return newest.agg(rounded(F.avg(s), 6).alias("avg_risk_score"), rounded(F.stddev_pop(s), 6).alias("stddev_risk_score"), F.min(s).alias("min_risk_score"), F.max(s).alias("max_risk_score"), F.count("*").alias("scored_users")).withColumn("computed_at", _now(as_of))


def new_account_abuse_rate_pct(t: Warehouse, as_of: dt.datetime) -> DataFrame:
    cohort = age_cohort(F.col("account_age_days"), ("0-6 days", "7-29 days", "30+ days"), (7, 30))
    return t.user_profiles.groupBy(cohort.alias("age_cohort")).agg(F.count("*").alias("total_users"), _flagged().alias("flagged_users"), _pct(_flagged(), F.count("*")).alias("abuse_rate_pct"))


def enforcement_false_positive_outcomes_pct(t: Warehouse, as_of: dt.datetime, days: int = 30) -> DataFrame:
    resolved = t.enforcement_actions.where(F.col("resolved_at").isNotNull() & _since("triggered_at", as_of, days=days))
    wrong = F.sum(F.when(F.col("outcome") == "false_positive", 1).otherwise(0))
    return resolved.agg(F.count("*").alias("total_resolved"), wrong.alias("false_positive_count"), _pct(wrong, F.count("*")).alias("fp_outcome_rate_pct"))


def top_risk_users_live(t: Warehouse, as_of: dt.datetime, top: int = 50) -> DataFrame:
    """The top users by rank; only they are joined with their enforcement history."""
    known = q.latest_scores(t.anomaly_scores).join(t.user_profiles.withColumnRenamed("is_flagged", "profile_flagged"), "user_id")
    best = known.orderBy(F.desc_nulls_first("combined_risk_score"), "user_id").limit(top)
    ranked = best.withColumn("risk_rank", F.rank().over(Window.orderBy(F.desc_nulls_first("combined_risk_score"))))
    still_open = t.enforcement_actions.where("resolved_at is null").join(F.broadcast(best.select("user_id")), "user_id", "left_semi").groupBy("user_id").agg(F.count("action_id").alias("n"))  # at most ``top`` rows
    four = lambda c: rounded(F.col(c), 4).alias(c)
    return ranked.join(still_open, "user_id", "left").select("risk_rank", "user_id", "country", "account_age_days", "profile_flagged", four("combined_risk_score"), four("zscore_value"), four("isolation_score"), "computed_at", "model_version", F.coalesce("n", F.lit(0)).alias("open_enforcements"))


def anomaly_score_distribution(t: Warehouse, as_of: dt.datetime) -> DataFrame:
    newest = q.latest_scores(t.anomaly_scores)
    counted = newest.groupBy(width_bucket(F.col("combined_risk_score"), 0.0, 1.0, 20).alias("bucket_num")).agg(F.count("*").alias("user_count"))
    return counted.select("bucket_num", rounded((F.col("bucket_num") - 1) * F.lit(0.05), 2).alias("bucket_low"), rounded(F.col("bucket_num") * F.lit(0.05), 2).alias("bucket_high"), "user_count")


def enforcement_action_breakdown(t: Warehouse, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    resolved, wrong = F.col("resolved_at").isNotNull(), F.col("outcome") == "false_positive"
    return t.enforcement_actions.where(_since("triggered_at", as_of, hours=hours)).groupBy("action_type").agg(
        F.count("*").alias("total_actions"), _count_if(resolved).alias("resolved_actions"), _count_if(~resolved).alias("open_actions"),
        _count_if(F.col("outcome") == "confirmed_abuse").alias("confirmed_abuse"), _count_if(wrong).alias("false_positives"), _pct(_count_if(wrong), _count_if(resolved)).alias("fp_rate_pct"),
    )


def burst_activity_heatmap(t: Warehouse, as_of: dt.datetime, window_type: str = "5min", hours: int = 1, above: float = 0.75) -> DataFrame:
    hot = t.time_window_activity.where(_since("window_start", as_of, hours=hours) & (F.col("window_type") == window_type) & (F.col("burst_score") > above))
    return hot.join(t.user_profiles, "user_id").select("user_id", "country", "window_start", "window_end", "window_type", "action_count", rounded(F.col("burst_score"), 4).alias("burst_score"))


def cluster_risk_leaderboard(t: Warehouse, as_of: dt.datetime, days: int = 7, top: int = 100) -> DataFrame:
    recent = t.abuse_clusters.where(_since("detected_at", as_of, days=days)).orderBy(F.desc_nulls_first("avg_risk_score"), F.desc("cluster_size"), "cluster_id").limit(top)
    ranked = recent.withColumn("cluster_rank", F.rank().over(Window.orderBy(F.desc_nulls_first("avg_risk_score"))))
    return ranked.select("cluster_rank", "cluster_id", "detected_at", "cluster_size", rounded(F.col("avg_risk_score"), 4).alias("avg_risk_score"), "cluster_label", "shared_ips", "shared_devices")


def ip_multi_account_signals(t: Warehouse, as_of: dt.datetime, hours: int = 24, width: str = "10 minutes", min_accounts: int = 3) -> DataFrame:
    """Like the investigation, but buckets without a score stay and no risk limit applies."""
    buckets = q.ip_buckets(t.raw_events.where(_since("ts", as_of, hours=hours)), width, min_accounts)
    risk = q.bucket_risk(buckets, t.anomaly_scores)
    return buckets.join(risk, ["ip_address", "bucket_start"], "left").select(
        "ip_address", "bucket_start", (F.col("bucket_start") + F.expr(f"interval {width}")).alias("bucket_end"), "distinct_accounts", "total_events",
        rounded(F.col("risk"), 4).alias("avg_risk_score"), q.accounts_text("accounts").alias("account_list"),
    )


def device_reuse_signals(t: Warehouse, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    out = q.switch_summary(q.device_switches(t.raw_events.where(_since("ts", as_of, hours=hours)), 1800), 2)
    return out.withColumnsRenamed({"first_switch_ts": "first_switch", "last_switch_ts": "last_switch", "avg_seconds_between_switches": "avg_seconds_between"})


def threshold_drift_monitor(t: Warehouse, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Changes between neighbouring entries; the time filter comes first, so the oldest entry in range has no predecessor."""
    w = Window.partitionBy("metric_name").orderBy("updated_at", "threshold_id")
    change = lambda c: F.col(c) - F.lag(c).over(w)
    recent = t.threshold_history.where(_since("updated_at", as_of, days=days))
    return recent.select("threshold_id", "metric_name", "threshold_value", "false_positive_rate", "false_negative_rate", "updated_at", "updated_by", F.lag("threshold_value").over(w).alias("prev_threshold"), change("threshold_value").alias("threshold_delta"), change("false_positive_rate").alias("fpr_delta"))


def session_success_rate_anomalies(t: Warehouse, as_of: dt.datetime, hours: int = 24, baseline_days: int = 30, min_events: int = 10, below: float = -2.0) -> DataFrame:
    metrics = t.aggregated_user_metrics.where(_since("window_start", as_of, days=baseline_days))
    found = q.session_scores(t.raw_events.where(_since("ts", as_of, hours=hours)), metrics, min_events).where(F.col("success_zscore") < below)
    return found.join(t.user_profiles.select("user_id", "country", "is_flagged"), "user_id")


def cohort_abuse_comparison(t: Warehouse, as_of: dt.datetime, days: int = 30) -> DataFrame:
    recent = t.enforcement_actions.where(_since("triggered_at", as_of, days=days))
    names = ("0-6 days", "7-29 days", "30-89 days", "90+ days")
    return q.cohort_rows(t.user_profiles, t.anomaly_scores, recent, names).drop("total_enforcements")


EXECUTIVE: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (total_flagged_users, high_risk_rate_pct, enforcement_actions_24h, false_positive_rate_latest, active_abuse_clusters, avg_risk_score_all_users, new_account_abuse_rate_pct, enforcement_false_positive_outcomes_pct)}
ANALYST: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (top_risk_users_live, anomaly_score_distribution, enforcement_action_breakdown, burst_activity_heatmap, cluster_risk_leaderboard, ip_multi_account_signals, device_reuse_signals, threshold_drift_monitor, session_success_rate_anomalies, cohort_abuse_comparison)}
EXTRACTS = {**EXECUTIVE, **ANALYST}
