"""Dashboard metadata as data: metrics, charts and alert rules; an evaluator of the rules; JSON export."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dashboards, sqltext


@dataclass(frozen=True)
class Metric:
    metric_id: str
    label: str
    unit: str
    category: str
    refresh_seconds: int


@dataclass(frozen=True)
class Chart:
    metric_id: str
    chart_type: str
    fields: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    metric_id: str
    condition: str
    threshold: float
    severity: str
    evaluation_interval_seconds: int
    message_template: str
    channels: tuple[str, ...] = ("webhook",)
    value_field: str = ""


#: Id, label, unit, category, seconds between refreshes.
EXECUTIVE = [
    Metric("total_flagged_users", "Total Flagged Users", "users", "risk_overview", 900),
    Metric("high_risk_rate_pct", "High-Risk Rate (%)", "percent", "risk_overview", 900),
    Metric("enforcement_actions_24h", "Enforcement Actions (24 h)", "actions", "enforcement", 900),
    Metric("false_positive_rate_latest", "False-Positive Rate (latest)", "rate [0–1]", "model_health", 3600),
    Metric("active_abuse_clusters", "Active Abuse Clusters", "clusters", "cluster_risk", 900),
    Metric("avg_risk_score_all_users", "Average Risk Score", "score [0–1]", "risk_overview", 900),
    Metric("new_account_abuse_rate_pct", "New-Account Abuse Rate (%)", "percent", "cohort_risk", 900),
    Metric("enforcement_false_positive_outcomes_pct", "False-Positive Outcomes (%)", "percent", "model_health", 3600),
]
ANALYST = [
    Metric("top_risk_users_live", "Top 50 Highest-Risk Users (live)", "user list", "user_drilldown", 300),
    Metric("anomaly_score_distribution", "Risk Score Distribution (histogram)", "user count per bucket", "model_diagnostics", 300),
    Metric("enforcement_action_breakdown", "Enforcement Actions by Type (rolling 24 h)", "action count", "enforcement", 300),
    Metric("burst_activity_heatmap", "High-Burst Users Heatmap (last 1 h)", "burst_score [0–1]", "burst_detection", 300),
    Metric("cluster_risk_leaderboard", "Abuse Cluster Risk Leaderboard", "cluster list", "cluster_risk", 300),
    Metric("ip_multi_account_signals", "Multi-Account IP Signals (last 24 h)", "IP address list", "network_signals", 300),
    Metric("device_reuse_signals", "Device Fingerprint Reuse Signals (last 24 h)", "device list", "network_signals", 300),
    Metric("threshold_drift_monitor", "Threshold Drift Monitor", "rate [0–1]", "model_health", 3600),
    Metric("session_success_rate_anomalies", "Abnormal Session Success Rates", "session list", "session_analysis", 300),
    Metric("cohort_abuse_comparison", "Cohort Abuse Rate Comparison", "percent / score", "cohort_risk", 900),
]
CHARTS = [
    Chart("total_flagged_users", "kpi_tile", {"value_field": "total_flagged_users"}),
    Chart("high_risk_rate_pct", "kpi_tile", {"value_field": "high_risk_rate_pct", "warn": 1.0, "critical": 2.0}),
    Chart("enforcement_actions_24h", "bar", {"x_field": "action_type", "y_field": "action_count"}),
    Chart("false_positive_rate_latest", "kpi_tile", {"value_field": "false_positive_rate", "warn": 0.02, "critical": 0.05}),
    Chart("active_abuse_clusters", "kpi_tile", {"value_field": "row_count"}),
    Chart("avg_risk_score_all_users", "kpi_tile", {"value_field": "avg_risk_score"}),
    Chart("new_account_abuse_rate_pct", "bar", {"x_field": "age_cohort", "y_field": "abuse_rate_pct"}),
    Chart("enforcement_false_positive_outcomes_pct", "kpi_tile", {"value_field": "fp_outcome_rate_pct"}),
    Chart("top_risk_users_live", "table", {"sort_field": "risk_rank"}),
    Chart("anomaly_score_distribution", "histogram", {"x_field": "bucket_low", "y_field": "user_count"}),
    Chart("enforcement_action_breakdown", "bar", {"x_field": "action_type", "y_field": "total_actions"}),
    Chart("burst_activity_heatmap", "heatmap", {"x_field": "window_start", "y_field": "user_id", "color_field": "burst_score"}),
    Chart("cluster_risk_leaderboard", "table", {"sort_field": "cluster_rank"}),
    Chart("ip_multi_account_signals", "scatter", {"x_field": "distinct_accounts", "y_field": "avg_risk_score"}),
    Chart("device_reuse_signals", "scatter", {"x_field": "accounts_seen", "y_field": "total_switches"}),
    Chart("threshold_drift_monitor", "line", {"x_field": "updated_at", "y_field": "threshold_value", "color_field": "metric_name"}),
    Chart("session_success_rate_anomalies", "scatter", {"x_field": "session_start", "y_field": "success_zscore"}),
    Chart("cohort_abuse_comparison", "bar", {"x_field": "age_cohort", "y_field": "flagged_rate_pct"}),
]
#: Id, metric, condition, threshold, severity, seconds; messages are this library's.
RULES = [
    Rule("exec_high_risk_rate", "high_risk_rate_pct", "gt", 2.0, "critical", 900, "High-risk users are {value:.2f}% of all", ("webhook", "email"), "high_risk_rate_pct"),
    Rule("exec_enforcement_spike", "enforcement_actions_24h", "zscore_gt", 3.0, "warning", 900, "Enforcement volume is {value:.2f} deviations above usual"),
    Rule("exec_fpr_breach", "false_positive_rate_latest", "gt", 0.05, "critical", 3600, "The false-positive rate is {value:.4f}: recalibrate", ("webhook", "email"), "false_positive_rate"),
    Rule("analyst_cluster_surge", "active_abuse_clusters", "gt", 10, "warning", 300, "{value:.0f} active abuse clusters"),
    Rule("analyst_new_account_abuse", "new_account_abuse_rate_pct", "gt", 5.0, "warning", 900, "{value:.2f}% of the newest accounts are flagged", ("webhook",), "abuse_rate_pct"),
    Rule("analyst_burst_heatmap_saturation", "burst_activity_heatmap", "row_count_gt", 500, "warning", 300, "{value:.0f} high-burst windows in the last hour"),
    Rule("analyst_device_reuse_surge", "device_reuse_signals", "row_count_gt", 50, "warning", 300, "{value:.0f} devices used by several accounts"),
    Rule("analyst_ip_multi_account_surge", "ip_multi_account_signals", "row_count_gt", 20, "warning", 300, "{value:.0f} addresses with three or more accounts"),
]


def _value(rule: Rule, t: dashboards.Warehouse, as_of: dt.datetime) -> DataFrame:
    """One row: the value that a rule compares."""
    if rule.condition == "zscore_gt":  # the last day against the 30 days before it
        days = F.floor((F.unix_seconds(F.lit(str(as_of)).cast("timestamp")) - F.unix_seconds(F.col("triggered_at").cast("timestamp"))) / 86_400)
        w = t.enforcement_actions.withColumn("back", days).where("back between 0 and 30").groupBy("back").agg(F.count("*").cast("double").alias("n"))
        last, rest = F.coalesce(F.max(F.when(F.col("back") == 0, F.col("n"))), F.lit(0.0)), F.when(F.col("back") > 0, F.col("n"))
        spread = F.stddev_samp(rest)
        return w.agg(F.when(spread >= 1e-9, (last - F.avg(rest)) / F.when(spread >= 1e-9, spread).otherwise(1.0)).alias("value"))
    found = dashboards.EXTRACTS[rule.metric_id](t, as_of)
    if rule.metric_id == "new_account_abuse_rate_pct":
        found = found.where("age_cohort = '0-6 days'")
    return found.agg((F.max(rule.value_field) if rule.value_field else F.count("*")).cast("double").alias("value"))


def evaluate_rules(t: dashboards.Warehouse, as_of: dt.datetime, rules: list[Rule] | None = None) -> DataFrame:
    """rule_id, metric_id, severity, value, threshold, fires.  An addition of this library: the rules were metadata only."""
    out = None
    for rule in rules or RULES:
        row = _value(rule, t, as_of).select(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.metric_id).alias("metric_id"), F.lit(rule.severity).alias("severity"), "value", F.lit(float(rule.threshold)).alias("threshold"), F.coalesce(F.col("value") > rule.threshold, F.lit(False)).alias("fires"))
        out = row if out is None else out.unionByName(row)
    return out


def _rendered(template: str) -> Column:
    """The template with ``value`` in the place and number of digits that it names."""
    pattern = re.sub(r"\{value:(\.\d+)f\}", r"%\1f", template.replace("%", "%%"))
    return F.format_string(pattern, F.col("value"))


def alert_messages(t: dashboards.Warehouse, as_of: dt.datetime, rules: list[Rule] | None = None) -> DataFrame:
    """rule_id, severity, channel, message: a row for each channel of each rule that fires."""
    rules = rules or RULES
    found = evaluate_rules(t, as_of, rules).where("fires")
    by_rule = lambda f: F.coalesce(*(F.when(F.col("rule_id") == r.rule_id, f(r)) for r in rules))
    channels = by_rule(lambda r: F.array(*map(F.lit, r.channels)))
    return found.select("rule_id", "severity", F.explode(channels).alias("channel"), by_rule(lambda r: _rendered(r.message_template)).alias("message"))


def spec(at: dt.datetime) -> dict:
    return {
        "schema_version": "1.0.0",
        "generated_at": at.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "executive_metrics": {m.metric_id: asdict(m) for m in EXECUTIVE},
        "analyst_metrics": {m.metric_id: asdict(m) for m in ANALYST},
        "extracts": {name: {"sql": text, "parameters": {"as_of": None, **sqltext.DEFAULTS.get(name, {})}} for name, text in sqltext.SQL.items()},
        "visualization_mapping": {c.metric_id: asdict(c) for c in CHARTS},
        "alert_rules": [asdict(r) for r in RULES],
    }


def export(path: str | Path, at: dt.datetime) -> None:
    """Writes the whole specification as JSON; parent folders are made."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(spec(at), indent=2, ensure_ascii=False), encoding="utf-8")
