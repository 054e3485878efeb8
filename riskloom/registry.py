"""Registered queries: each operator applied to the derived tables of a data folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import AlertParams, AnomalyParams, ClusterParams, Config
from .functions import rounded
from .operators import alerts, calibration, features, graph, scoring
from .operators.durable import durable
from .plans import dashboards, metadata
from .plans import investigations as q
from .sources import events as ev
from .sources import producers, sinks
from .sources.fixtures import Tables
from .streaming import jobs

EVENTS = q.Lookback(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))
ORDERS = q.Lookback(dt.datetime(2000, 1, 1), dt.datetime(2000, 12, 31))
NOW_EVENTS, NOW_ORDERS = dt.datetime(2024, 1, 31), dt.datetime(2001, 6, 1)
CLUSTERS = ClusterParams(exclude_signals=("unknown",))
Z_ONLY = AnomalyParams(isolation_weight=0.0)

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: _long_ranks(f(Tables(spark, folder)))


def _long_ranks(df: DataFrame) -> DataFrame:
    """Ranks as long, as SQL has them."""
    return df.select(*(F.col(c).cast("long").alias(c) if "rank" in c and t == "int" else F.col(c) for c, t in df.dtypes))


def _view(t: Tables) -> DataFrame:
    return ev.feature_view(t.raw_events)


def _digits(df: DataFrame, n: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*(rounded(F.col(c), n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _dashboard(name: str) -> Query:
    on_orders = {"high_risk_rate_pct", "enforcement_actions_24h", "false_positive_rate_latest", "enforcement_false_positive_outcomes_pct", "enforcement_action_breakdown", "threshold_drift_monitor", "top_risk_users_live", "cohort_abuse_comparison"}
    wider = {
        "burst_activity_heatmap": {"window_type": "1hr", "hours": 24 * 31},
        "ip_multi_account_signals": {"width": "1 day", "hours": 24 * 7},
        "device_reuse_signals": {"hours": 24 * 31},
        "session_success_rate_anomalies": {"hours": 24 * 31, "baseline_days": 31, "below": -1.0},
    }
    as_of = NOW_ORDERS if name in on_orders else NOW_EVENTS
    return _on(lambda t: dashboards.EXTRACTS[name](t, as_of, **wider.get(name, {})))


def _scores(t: Tables) -> DataFrame:
    """Blended scores of all users without a forest."""
    shares = scoring.zscores(features.feature_matrix(_view(t)), features.feature_names(), Z_ONLY)
    return shares.select("user_id", "zscore_share", scoring.blend(F.lit(0.0), F.col("zscore_share"), Z_ONLY).alias("risk_score"))


def _score_blend(t: Tables) -> DataFrame:
    return _digits(_scores(t).withColumn("risk_score", F.col("risk_score").cast("double")), 4)


def _score_threshold(t: Tables) -> DataFrame:
    return _digits(scoring.calibrated_threshold(_scores(t), AnomalyParams(isolation_weight=0.0, risk_score_high=0.0)), 4)


def _scored_events(t: Tables) -> DataFrame:
    scores = _scores(t).select("user_id", F.col("risk_score").cast("double").alias("risk_score"), (F.col("risk_score") >= 2.0).alias("is_anomaly"))
    return _digits(sinks.merge_scores(_view(t).select("event_id", "user_id"), scores), 4)


def _score_iforest(t: Tables) -> DataFrame:
    matrix = durable(features.feature_matrix(_view(t)))  # read to fit and to score
    return scoring.RiskModel.fit(matrix, Config()).predict(matrix)


def _members(t: Tables) -> DataFrame:
    return graph.signal_components(_view(t), CLUSTERS)  # one shared signal is enough, so no pairs are needed


def _communities(t: Tables) -> DataFrame:
    return graph.communities(graph.nodes(_view(t)), graph.edges(_view(t), CLUSTERS), "louvain")


def _cluster_scores(t: Tables) -> DataFrame:
    nodes, edges = graph.nodes(_view(t)), graph.edges(_view(t), CLUSTERS)
    return graph.cluster_scores(nodes, edges, graph.components(nodes, edges))


def _escalated(t: Tables) -> DataFrame:
    return graph.escalate(_cluster_scores(t), threshold=40.0)


def _auto_adjust(t: Tables) -> DataFrame:
    """What the next threshold would be after each entry of the history, for a target of 2 % false positives."""
    now, rate = F.col("threshold_value"), F.col("false_positive_rate")
    return t.threshold_history.select("threshold_id", "metric_name", now.alias("current"), rate.alias("observed"), F.lit(0.02).alias("target"), calibration.adjusted(now, rate, 0.02).alias("adjusted"))


def _alert_users(t: Tables) -> DataFrame:
    newest = q.latest_scores(t.anomaly_scores).select("user_id", (F.col("combined_risk_score") * 100).alias("risk_score"))
    return alerts.user_candidates(newest).select("alert_type", "entity", "at")


def _alert_clusters(t: Tables) -> DataFrame:
    return alerts.cluster_candidates(t.abuse_clusters.select("cluster_id", F.col("avg_risk_score").alias("cluster_score"))).select("alert_type", "entity", "at")


def _daily(t: Tables) -> DataFrame:
    return t.enforcement_actions.groupBy(F.date_trunc("month", "triggered_at").cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("enforcement_count"))


def _alert_fold(t: Tables) -> DataFrame:
    scored = t.anomaly_scores.select("user_id", (F.col("combined_risk_score") * 100).alias("risk_score"), F.unix_seconds(F.col("computed_at").cast("timestamp")).alias("at"))
    return alerts.fold(alerts.user_candidates(scored, at=F.col("at")), AlertParams(rate_limit_per_minute=5, dedup_window_seconds=30 * 86_400.0))


def _valid(t: Tables) -> DataFrame:
    from . import schemas

    bad = [schemas.violations(n, getattr(t, n)).groupBy().agg(F.count("*").alias("violations")).withColumn("table_name", F.lit(n)) for n in ("user_profiles", "aggregated_user_metrics", "anomaly_scores", "enforcement_actions", "abuse_clusters", "threshold_history")]
    out = bad[0]
    for x in bad[1:]:
        out = out.unionByName(x)
    return out.select("table_name", "violations")


def _normalised(t: Tables) -> DataFrame:
    """Events coarsened to whole days, so that there is something to remove."""
    coarse = _view(t).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return ev.normalise(coarse).select("event_id", "user_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "action", "ip_address", "device_id", "enforced")


QUERIES: dict[str, Query] = {
    "q1_burst": _on(lambda t: q.q1_burst(t.raw_events, t.user_profiles, EVENTS, min_window_count=2)),
    "q2_ip_clusters": _on(lambda t: q.q2_ip_clusters(t.raw_events, t.anomaly_scores, EVENTS, width="1 day")),
    # the defaults, over events that follow each other so closely that short windows hold several
    "q1_burst_defaults": _on(lambda t: q.q1_burst(t.dense_events(20), t.user_profiles, EVENTS)),
    "q2_ip_clusters_defaults": _on(lambda t: q.q2_ip_clusters(t.dense_events(200), t.anomaly_scores, EVENTS)),
    "q4_session_success_defaults": _on(lambda t: q.q4_session_success(t.raw_events, t.aggregated_user_metrics, t.user_profiles, EVENTS)),
    "q5_resource_density_defaults": _on(lambda t: q.q5_resource_density(t.dense_events(5000), t.aggregated_user_metrics, t.user_profiles, EVENTS)),
    "q3_device_reuse": _on(lambda t: q.q3_device_reuse(t.raw_events, EVENTS)),
    "q4_session_success": _on(lambda t: q.q4_session_success(t.raw_events, t.aggregated_user_metrics, t.user_profiles, EVENTS, below=-0.5)),
    "q5_resource_density": _on(lambda t: q.q5_resource_density(t.raw_events, t.aggregated_user_metrics, t.user_profiles, EVENTS, width="1 day", min_resources=5, factor=2.0)),
    "q6_cohort_abuse": _on(lambda t: q.q6_cohort_abuse(t.user_profiles, t.anomaly_scores, t.enforcement_actions, ORDERS)),
    "q7_weekly_enforcement": _on(lambda t: q.q7_weekly_enforcement(t.enforcement_actions, t.user_profiles, ORDERS, NOW_ORDERS)),
    **{f"dash_{name}": _dashboard(name) for name in dashboards.EXTRACTS},
    "dash_alert_rules": _on(lambda t: _digits(metadata.evaluate_rules(t, NOW_EVENTS))),
    "dash_alert_messages": _on(lambda t: metadata.alert_messages(t, NOW_EVENTS)),
    "feat_action_frequency": _on(lambda t: _digits(features.action_frequency(_view(t)))),
    "feat_ip_entropy": _on(lambda t: _digits(features.ip_entropy(_view(t)))),
    "feat_device_reuse": _on(lambda t: _digits(features.device_reuse(_view(t)))),
    "feat_session_velocity": _on(lambda t: _digits(features.session_velocity(_view(t)))),
    "feat_enforcement_rate": _on(lambda t: _digits(features.enforcement_rate(_view(t)))),
    "feature_matrix": _on(lambda t: _digits(features.feature_matrix(_view(t)))),
    "score_zscore": _on(lambda t: _digits(scoring.zscores(features.feature_matrix(_view(t)), features.feature_names(), AnomalyParams(zscore_threshold=1.5)))),
    "score_blend_z_only": _on(_score_blend),
    "score_threshold": _on(_score_threshold),
    "scored_events": _on(_scored_events),
    "score_iforest": _on(_score_iforest),
    "graph_nodes": _on(lambda t: graph.nodes(_view(t))),
    "graph_edges": _on(lambda t: _digits(graph.edges(_view(t), CLUSTERS))),
    "graph_components": _on(_members),
    "graph_signal_components": _on(lambda t: graph.signal_components(_view(t), CLUSTERS)),
    "graph_louvain": _on(_communities),
    "graph_cluster_scores": _on(_cluster_scores),
    "graph_escalated": _on(_escalated),
    "cal_rates_at_threshold": _on(lambda t: calibration.rates_at(t.scored_labels, 50.0)),
    "cal_roc": _on(lambda t: calibration.roc_curve(t.scored_labels)),
    "cal_pr": _on(lambda t: calibration.pr_curve(t.scored_labels)),
    "cal_auc_ap": _on(lambda t: _digits(calibration.auc_ap(t.scored_labels))),
    "cal_optimal_threshold": _on(lambda t: calibration.optimal_threshold(t.scored_labels, 0.2)),
    "cal_auto_adjust": _on(_auto_adjust),
    "cal_report": _on(lambda t: calibration.report(t.scored_labels, 0.2).summary),
    "alert_candidates_user": _on(_alert_users),
    "alert_candidates_cluster": _on(_alert_clusters),
    "alert_spike": _on(lambda t: alerts.spike(_daily(t))),
    "alert_fold": _on(_alert_fold),
    "src_validate": _on(_valid),
    "src_dedup_events": _on(_normalised),
    "src_weekly_spine": _on(lambda t: ev.weekly_counts(t.enforcement_actions, "triggered_at")),
    "ext_aum_daily": _on(lambda t: producers.daily_metrics(t.raw_events)),
    "ext_window_activity": _on(lambda t: producers.window_activity(t.raw_events)),
    "ext_stream_windows": jobs.stream_windows_query,
    "ext_stream_alerts": jobs.stream_alerts_query,
}
