"""The eight tables derived from a folder of generic star-schema tables, for tests and benchmarks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import start_of


class Tables:
    """Lazy derived tables; each is a plan over Parquet scans, so filters and column choices reach the files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw_events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        user = F.col("user_id")
        text = lambda x: x.cast("string")
        return self.raw("events").withColumn("k", k).select(
            "event_id", "user_id", "ts",
            F.concat(F.lit("s"), text(user), F.lit("_"), text(F.date_trunc("week", "ts").cast("date"))).alias("session_id"),
            F.concat(F.lit("10.0."), text(F.floor(user / 5)), F.lit("."), text(F.col("k") % 4)).alias("ip_address"),
            F.when(F.col("k") < 3, "unknown").otherwise(F.concat(F.lit("dev_"), text(F.floor(user / 10)), F.lit("_"), text(F.col("k") % 8))).alias("device_id"),
            F.col("event_type").alias("action_type"),
            F.when(F.col("event_type") != "signup", F.concat(F.lit("res_"), text(F.col("k")))).alias("resource_id"),
            (F.col("event_type") != "error").alias("success_flag"),
            F.when(F.col("value") > 150, "rate_limit").alias("enforcement_action"),
        )

    def dense_events(self, times: int) -> DataFrame:
        """``raw_events`` with all distances of time from the start of 2024 divided by ``times``."""
        start = "timestamp_ntz'2024-01-01 00:00:00'"
        return self.raw_events.withColumn("ts", F.expr(f"timestampadd(microsecond, timestampdiff(microsecond, {start}, ts) div {times}, {start})"))

    @cached_property
    def user_profiles(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("country"))
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("user_id"), "country",
            ((F.col("c_custkey") * 37) % 120).cast("int").alias("account_age_days"), (F.col("c_acctbal") < 0).alias("is_flagged"),
        )

    @cached_property
    def enforcement_actions(self) -> DataFrame:
        kinds = {"1-URGENT": "ban", "2-HIGH": "suspend", "3-MEDIUM": "rate_limit", "4-NOT SPECIFIED": "warning"}
        action, outcome = F.lit("captcha"), F.when(F.col("o_orderstatus") == "F", "confirmed_abuse").when(F.col("o_orderstatus") == "P", "false_positive")
        for priority, name in kinds.items():
            action = F.when(F.col("o_orderpriority") == priority, name).otherwise(action)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("action_id"), F.col("o_custkey").alias("user_id"), action.alias("action_type"), F.col("o_orderdate").alias("triggered_at"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("interval 3 days")).alias("resolved_at"), outcome.alias("outcome"),
        )

    @cached_property
    def anomaly_scores(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("score_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("computed_at"),
            (F.col("o_totalprice") / F.lit(100000.0) - F.lit(2.5)).alias("zscore_value"),
            ((F.col("o_orderkey") % 1000).cast("double") / F.lit(1000.0)).alias("isolation_score"),
            F.least(F.lit(1.0), F.col("o_totalprice") / F.lit(500000.0)).alias("combined_risk_score"),
            (F.col("o_totalprice") >= 350000).alias("is_flagged"), F.lit("v1").alias("model_version"),
        )

    @cached_property
    def aggregated_user_metrics(self) -> DataFrame:
        day = start_of("day", F.col("ts"))
        return (
            self.raw_events.groupBy("user_id", day.alias("window_start")).agg(
                F.count("*").alias("action_count"), F.countDistinct("ip_address").alias("unique_ips"), F.countDistinct("device_id").alias("unique_devices"),
                F.avg(F.col("success_flag").cast("int").cast("double")).alias("success_rate"), F.count("enforcement_action").alias("enforcement_count"),
            ).withColumn("window_end", F.col("window_start") + F.expr("interval 1 day"))
        )

    @cached_property
    def time_window_activity(self) -> DataFrame:
        hours = self.raw_events.groupBy("user_id", start_of("hour", F.col("ts")).alias("window_start")).agg(F.count("*").alias("action_count")).withColumn("window_type", F.lit("1hr"))
        most = hours.groupBy("window_type").agg(F.max("action_count").alias("most"))
        return hours.join(F.broadcast(most), "window_type").select(  # one row
            "user_id", "window_start", (F.col("window_start") + F.expr("interval 1 hour")).alias("window_end"), "window_type",
            "action_count", (F.col("action_count").cast("double") / F.col("most")).alias("burst_score"),
        )

    @cached_property
    def abuse_clusters(self) -> DataFrame:
        label = F.when(F.col("s_nationkey") % 3 == 0, "credential_stuffing").when(F.col("s_nationkey") % 3 == 1, "scraping_ring").otherwise("fake_reviews")
        detected = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(days=(F.col("s_suppkey") % 30).cast("int"))
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("cluster_id"), detected.alias("detected_at"), (F.lit(2) + F.col("s_suppkey") % 9).alias("cluster_size"),
            ((F.col("s_acctbal") + F.lit(1000.0)) / F.lit(11000.0)).alias("avg_risk_score"), label.alias("cluster_label"),
            F.lit(None).cast("string").alias("shared_ips"), F.lit(None).cast("string").alias("shared_devices"),
        )

    @cached_property
    def threshold_history(self) -> DataFrame:
        name = F.when(F.col("o_orderstatus") == "F", "combined_risk_score").when(F.col("o_orderstatus") == "O", "zscore_value").otherwise("burst_score")
        rate = lambda n: (F.col("o_orderkey") % n).cast("double") / F.lit(1000.0)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("threshold_id"), name.alias("metric_name"), (F.col("o_totalprice") / F.lit(5000.0)).alias("threshold_value"),
            rate(50).alias("false_positive_rate"), rate(70).alias("false_negative_rate"), F.col("o_orderdate").alias("updated_at"), F.lit("calibrator").alias("updated_by"),
        )

    @cached_property
    def scored_labels(self) -> DataFrame:
        score = ((F.col("n_chars") * 37 + F.col("doc_id") * 11) % 1000).cast("double") / F.lit(10.0)
        return self.raw("labels").join(self.raw("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("toxic").alias("y_true"), score.alias("y_score"))
