"""Materialisers for tables that the reports read; their definitions are this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket

WIDTHS = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "1hr": "1 hour", "24hr": "1 day"}


def daily_metrics(events: DataFrame) -> DataFrame:
    """aggregated_user_metrics, one row a user and day with events."""
    return events.groupBy("user_id", bucket(F.col("ts"), "1 day").alias("window_start")).agg(
        F.count("*").alias("action_count"), F.countDistinct("ip_address").alias("unique_ips"), F.countDistinct("device_id").alias("unique_devices"),
        F.avg(F.col("success_flag").cast("int").cast("double")).alias("success_rate"), F.count("enforcement_action").alias("enforcement_count"),
    ).withColumn("window_end", F.col("window_start") + F.expr("interval 1 day"))


def window_activity(events: DataFrame) -> DataFrame:
    """time_window_activity for all five window types; burst_score is the count over the largest count of the type.

    Counts of one minute are made first and rolled up, so the events are aggregated once.
    """
    minutes = events.groupBy("user_id", bucket(F.col("ts"), "1 minute").alias("m")).agg(F.count("*").alias("n"))
    kinds = F.array(*(F.struct(F.lit(k).alias("window_type"), bucket_start(k).alias("window_start")) for k in WIDTHS))
    counted = minutes.select("user_id", "n", F.inline(kinds)).groupBy("user_id", "window_type", "window_start").agg(F.sum("n").alias("action_count"))
    most = counted.groupBy("window_type").agg(F.max("action_count").alias("most"))  # five rows
    return counted.join(F.broadcast(most), "window_type").select("user_id", "window_type", "window_start", "action_count", (F.col("action_count") / F.col("most")).alias("burst_score"))


def bucket_start(kind: str):
    """Start of the window of a type that a minute ``m`` lies in."""
    seconds = {"1min": 60, "5min": 300, "15min": 900, "1hr": 3600, "24hr": 86400}[kind]
    at = F.unix_seconds(F.col("m").cast("timestamp"))
    return F.timestamp_seconds(at - at % seconds).cast("timestamp_ntz")
