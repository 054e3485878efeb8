"""The eight tables: schemas, and checks that return the rows that break a constraint."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_DDL = {
    "raw_events": "event_id string, user_id string, session_id string, ts timestamp, ip_address string, device_id string, action_type string, resource_id string, geo_location string, user_agent string, success_flag boolean, enforcement_action string",
    "user_profiles": "user_id string, created_at timestamp, account_age_days int, country string, is_flagged boolean",
    "aggregated_user_metrics": "user_id string, window_start timestamp, window_end timestamp, action_count int, unique_ips int, unique_devices int, success_rate decimal(5,4), enforcement_count int",
    "time_window_activity": "user_id string, window_start timestamp, window_end timestamp, window_type string, action_count int, burst_score decimal(5,4)",
    "anomaly_scores": "score_id string, user_id string, computed_at timestamp, zscore_value decimal(8,4), isolation_score decimal(6,4), combined_risk_score decimal(5,4), is_flagged boolean, model_version string",
    "enforcement_actions": "action_id string, user_id string, action_type string, triggered_at timestamp, resolved_at timestamp, outcome string",
    "abuse_clusters": "cluster_id string, detected_at timestamp, cluster_size int, avg_risk_score decimal(5,4), shared_ips string, shared_devices string, cluster_label string",
    "threshold_history": "threshold_id long, metric_name string, threshold_value decimal(10,4), false_positive_rate decimal(6,4), false_negative_rate decimal(6,4), updated_at timestamp, updated_by string",
}
_PLAIN = {"string": StringType(), "timestamp": TimestampType(), "int": IntegerType(), "long": LongType(), "boolean": BooleanType()}


def _type(text: str) -> DataType:
    digits = re.fullmatch(r"decimal\((\d+),(\d+)\)", text)
    return DecimalType(int(digits[1]), int(digits[2])) if digits else _PLAIN[text]


SCHEMAS: dict[str, StructType] = {name: StructType([StructField(c, _type(t)) for c, t in (x.split() for x in re.split(r",\s+", ddl))]) for name, ddl in _DDL.items()}
KEYS = {
    "raw_events": ("event_id", "ts"), "user_profiles": ("user_id",), "aggregated_user_metrics": ("user_id", "window_start"),
    "time_window_activity": ("user_id", "window_start", "window_type"), "anomaly_scores": ("score_id",),
    "enforcement_actions": ("action_id",), "abuse_clusters": ("cluster_id",), "threshold_history": ("threshold_id",),
}
WINDOW_TYPES = ("1min", "5min", "15min", "1hr", "24hr")


def _share(name: str) -> Column:
    return F.col(name).between(0, 1)




def _checks() -> dict[str, dict[str, Column]]:
    return {
        "raw_events": {"key": F.col("event_id").isNotNull() & F.col("ts").isNotNull()},
        "user_profiles": {"account_age_days": F.col("account_age_days") >= 0},
        "aggregated_user_metrics": {
            "counts": (F.col("action_count") >= 0) & (F.col("unique_ips") >= 0) & (F.col("unique_devices") >= 0) & (F.col("enforcement_count") >= 0),
            "success_rate": _share("success_rate"),
            "window": F.col("window_start") < F.col("window_end"),
        },
        "time_window_activity": {"burst_score": _share("burst_score"), "window_type": F.col("window_type").isin(*WINDOW_TYPES)},
        "anomaly_scores": {"isolation_score": _share("isolation_score"), "combined_risk_score": _share("combined_risk_score"), "model_version": F.col("model_version").isNotNull()},
        "enforcement_actions": {"resolved_at": F.col("resolved_at") >= F.col("triggered_at")},
        "abuse_clusters": {"cluster_size": F.col("cluster_size") > 0, "avg_risk_score": _share("avg_risk_score")},
        "threshold_history": {"false_positive_rate": _share("false_positive_rate"), "false_negative_rate": _share("false_negative_rate")},
    }


def violations(name: str, df: DataFrame) -> DataFrame:
    """The rows of ``df`` that break a constraint of table ``name``, with ``violated``, the names of what they break."""
    rules = _checks()[name]
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(label)) for label, rule in rules.items())))
    return df.withColumn("violated", broken).where(F.size("violated") > 0)


def duplicate_keys(name: str, df: DataFrame) -> DataFrame:
    """Keys of table ``name`` that occur more than once, with ``n``."""
    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).where("n > 1")
