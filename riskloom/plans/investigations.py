"""The seven investigation queries.  Each takes frames and parameters and returns a frame.

Rankings without a partition are made by ranges (``order.ranks``), windows over
time in slices (``sliced``).  Every order has a unique tie-break, so that results
don't depend on the physical plan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import age_cohort, bucket, micros, ratio, rounded, seconds_between, start_of
from ..operators import sliced
from ..operators.durable import durable
from ..operators.order import ranks as global_ranks
from ..sources.events import between, weekly_spine


@dataclass(frozen=True)
class Lookback:
    start: dt.datetime = dt.datetime(2024, 1, 1)
    end: dt.datetime = dt.datetime(2024, 1, 31)

    @property
    def hours(self) -> float:
        return (self.end - self.start).total_seconds() / 3600

    def covers(self, column: str) -> Column:
        return between(F.col(column), self.start, self.end)

    def since(self, column: str, **back: float) -> Column:
        return F.col(column) >= F.lit(str(self.start - dt.timedelta(**back))).cast("timestamp_ntz")


def latest_scores(scores: DataFrame) -> DataFrame:
    """The newest score row of every user, by one aggregation with partial results (no sort of the history)."""
    rest = [c for c in scores.columns if c != "user_id"]
    order = F.struct(F.col("computed_at"), F.col("score_id"))
    return scores.groupBy("user_id").agg(F.max_by(F.struct(*rest), order).alias("x")).select("user_id", "x.*")


def q1_burst(events: DataFrame, profiles: DataFrame, when: Lookback = Lookback(), minutes: int = 5, factor: float = 3.0, min_events: int = 5, min_window_count: int = 1) -> DataFrame:
    """Events whose trailing window (both ends closed, equal times included) holds more than ``factor`` times what the user's hourly rate predicts."""
    seen = events.where(when.covers("ts")).select("user_id", "ts")
    width = minutes * 60_000_000
    cut = sliced.cut(seen, micros(F.col("ts")), sliced.SLICES_PER_WINDOW * 12 * width, width)
    per_user = seen.groupBy("user_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_events)
    counted = sliced.trailing(cut, "user_id", events_in_5min_window=(F.lit(1), width)).join(per_user, "user_id")
    expected = F.col("_n") / F.lit(when.hours) / F.lit(60.0 / minutes)
    found = (
        counted.withColumn("_expected", expected)
        .where((F.col("events_in_5min_window") > F.col("_expected") * factor) & (F.col("events_in_5min_window") >= min_window_count))
        .withColumn("_ratio", F.col("events_in_5min_window") / F.nullif("_expected", F.lit(0.0)))
    )
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("_ratio"), "ts"))  # over bursts only
    return (
        found.withColumn("rank_within_user", rank).join(profiles, "user_id")
        .select("user_id", "country", F.col("is_flagged").alias("already_flagged"), F.col("ts").alias("burst_peak_ts"), "events_in_5min_window",
                rounded(F.col("_expected"), 2).alias("expected_per_5min"), rounded(F.col("_ratio"), 2).alias("burst_ratio"), "rank_within_user")
    )


def ip_buckets(events: DataFrame, width: str, min_accounts: int) -> DataFrame:
    """ip_address, bucket_start, distinct_accounts, total_events, accounts (sorted) of buckets with enough users."""
    per_user = events.groupBy("ip_address", bucket(F.col("ts"), width).alias("bucket_start"), "user_id").agg(F.count("*").alias("n"))
    out = per_user.groupBy("ip_address", "bucket_start").agg(F.count("user_id").alias("distinct_accounts"), F.sum("n").alias("total_events"), F.array_sort(F.collect_list("user_id")).alias("accounts"))
    return out.where(F.col("distinct_accounts") >= min_accounts)


def bucket_risk(buckets: DataFrame, scores: DataFrame, mode: str = "latest_of_any") -> DataFrame:
    """ip_address, bucket_start, risk.  'latest_of_any': the newest score of any account in the bucket; 'mean_latest': the mean of each account's newest."""
    newest = latest_scores(scores).select("user_id", "computed_at", "score_id", "combined_risk_score")
    joined = buckets.select("ip_address", "bucket_start", F.explode("accounts").alias("user_id")).join(newest, "user_id")
    risk = F.max_by("combined_risk_score", F.struct("computed_at", "score_id")) if mode == "latest_of_any" else F.avg("combined_risk_score")
    return joined.groupBy("ip_address", "bucket_start").agg(risk.alias("risk"))


def accounts_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def q2_ip_clusters(events: DataFrame, scores: DataFrame, when: Lookback = Lookback(), width: str = "10 minutes", min_accounts: int = 3, min_risk: float = 0.4, mode: str = "latest_of_any") -> DataFrame:
    """Addresses with several accounts in one time bucket, by severity."""
    buckets = ip_buckets(events.where(when.covers("ts")), width, min_accounts)
    risky = buckets.join(bucket_risk(buckets, scores, mode), ["ip_address", "bucket_start"]).where(F.col("risk") >= min_risk)
    risky = durable(risky)  # ranked and joined with the ranks
    values = ["distinct_accounts", "risk"]
    return risky.join(global_ranks(risky, dict.fromkeys(values, True)).withColumnRenamed("dense_rank", "_rank"), values).select(
        "ip_address", "bucket_start", (F.col("bucket_start") + F.expr(f"interval {width}")).alias("bucket_end"), "distinct_accounts", "total_events",
        rounded(F.col("risk"), 4).alias("avg_risk_score"), F.col("_rank").alias("severity_rank"), accounts_text("accounts").alias("account_list"),
    )


GENERIC_DEVICES = ("", "unknown", "N/A")
DEVICE_SLICE = 6 * 3600 * 1_000_000  # microseconds of a device's time that one task looks at


def device_switches(events: DataFrame, seconds: int, generic: tuple[str, ...] = GENERIC_DEVICES) -> DataFrame:
    """device_id, user_from, switch_ts, gap: neighbouring events of one device by different accounts."""
    named = events.where(~F.col("device_id").isin(*generic)).select("device_id", "user_id", "ts", "event_id")
    seen = sliced.before(sliced.cut(named, micros(F.col("ts")), DEVICE_SLICE), "device_id", ["ts", "event_id"], user_from="user_id", _previous="ts")
    gap = seconds_between(F.col("ts"), F.col("_previous"))
    return seen.where((F.col("user_from") != F.col("user_id")) & (gap <= seconds)).select("device_id", "user_from", F.col("ts").alias("switch_ts"), gap.alias("gap"))


def switch_summary(switches: DataFrame, min_accounts: int) -> DataFrame:
    out = switches.groupBy("device_id").agg(
        F.countDistinct("user_from").alias("accounts_seen"), F.count("*").alias("total_switches"), F.min("switch_ts").alias("first_switch_ts"), F.max("switch_ts").alias("last_switch_ts"),
        rounded(F.avg("gap"), 1).alias("avg_seconds_between_switches"), F.array_sort(F.collect_set("user_from")).alias("_accounts"),
    )
    return out.where(F.col("accounts_seen") >= min_accounts).withColumn("involved_accounts", accounts_text("_accounts")).drop("_accounts")


def q3_device_reuse(events: DataFrame, when: Lookback = Lookback(), seconds: int = 1800, min_accounts: int = 2) -> DataFrame:
    """Devices on which accounts take turns within ``seconds``; accounts seen are those switched from."""
    summary = switch_summary(device_switches(events.where(when.covers("ts")), seconds), min_accounts)
    values = ["accounts_seen", "total_switches"]  # only distinct ones are ranked, by how many devices stand above
    above = Window.orderBy(*(F.desc(c) for c in values)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = summary.groupBy(*values).agg(F.count("*").alias("_n")).select(*values, (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("risk_rank"))
    return summary.join(ranks, values)


def session_scores(events: DataFrame, metrics: DataFrame, min_events: int) -> DataFrame:
    """Success rate of every long enough session against the user's own daily rates; z is rounded to 4 digits, null without spread."""
    ok = F.col("success_flag")
    stats = events.groupBy("user_id", "session_id").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("total_events"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("success_count"), F.sum(F.when(~ok, 1).otherwise(0)).alias("failure_count"), F.avg(ok.cast("int").cast("double")).alias("_rate"),
    ).where(F.col("total_events") >= min_events)
    base = metrics.groupBy("user_id").agg(F.avg("success_rate").alias("_mean"), F.stddev_pop("success_rate").alias("_std"))
    z = (F.col("_rate") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    return stats.join(base, "user_id").select(
        "user_id", "session_id", "session_start", "session_end", "total_events", "success_count", "failure_count",
        rounded(F.col("_rate"), 4).alias("session_success_rate"), rounded(F.col("_mean"), 4).alias("baseline_mean"), rounded(F.col("_std"), 4).alias("baseline_stddev"), rounded(z, 4).alias("success_zscore"),
    )


def q4_session_success(events: DataFrame, metrics: DataFrame, profiles: DataFrame, when: Lookback = Lookback(), min_events: int = 10, below: float = -2.0, baseline_days: int = 30) -> DataFrame:
    """Sessions whose success rate lies far below what is usual for the user.  The baseline has a lower bound only, so it includes the lookback itself."""
    found = session_scores(events.where(when.covers("ts")), metrics.where(when.since("window_start", days=baseline_days)), min_events).where(F.col("success_zscore") < below)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("success_zscore", "session_id"))
    return found.withColumn("rank_within_user", rank).join(profiles.select("user_id", "country", F.col("is_flagged").alias("account_flagged")), "user_id")


def q5_resource_density(events: DataFrame, metrics: DataFrame, profiles: DataFrame, when: Lookback = Lookback(), width: str = "2 minutes", min_resources: int = 10, factor: float = 3.0, baseline_days: int = 7, excluded: tuple[str, ...] = ("prefetch", "cdn_hit", "heartbeat")) -> DataFrame:
    """Short windows in which a user touches many different resources, against the median of daily actions; users without a median stay in."""
    counted = (
        events.where(when.covers("ts") & F.col("resource_id").isNotNull() & ~F.col("action_type").isin(*excluded))
        .groupBy("user_id", bucket(F.col("ts"), width).alias("window_start")).agg(F.countDistinct("resource_id").alias("distinct_resources"))
        .where(F.col("distinct_resources") >= min_resources)
    )
    medians = metrics.where(when.since("window_start", days=baseline_days)).groupBy("user_id").agg(F.percentile("action_count", F.lit(0.5)).alias("_median"))
    dense = counted.join(medians, "user_id", "left").where(F.col("_median").isNull() | (F.col("distinct_resources") >= F.col("_median") * factor))
    rank = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("distinct_resources")))
    return dense.withColumn("rank_within_user", rank).join(profiles, "user_id").select(
        "user_id", "country", "is_flagged", "window_start", (F.col("window_start") + F.expr(f"interval {width}")).alias("window_end"), "distinct_resources",
        rounded(F.col("_median"), 2).alias("baseline_median"), rounded(ratio(F.col("distinct_resources"), F.col("_median")), 2).alias("density_ratio"), "rank_within_user",
    )


COHORTS = ("0–6 days", "7–29 days", "30–89 days", "90+ days")


def cohort_rows(profiles: DataFrame, scores: DataFrame, actions: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """age_cohort with counts, flagged share in percent, mean risk and enforcements."""
    newest = latest_scores(scores).select("user_id", "combined_risk_score")
    done = actions.groupBy("user_id").agg(F.count("*").alias("_n"))
    users = profiles.join(newest, "user_id", "left").join(done, "user_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    flagged = F.sum(F.when(F.col("is_flagged"), 1).otherwise(0))
    return users.groupBy(age_cohort(F.col("account_age_days"), names).alias("age_cohort")).agg(
        F.count("*").alias("total_users"), flagged.alias("flagged_users"), rounded(ratio(flagged * 100, F.count("*")), 2).alias("flagged_rate_pct"),
        rounded(F.avg("combined_risk_score"), 4).alias("avg_risk_score"), rounded(F.avg("_n"), 4).alias("avg_enforcements"), F.sum("_n").alias("total_enforcements"),
    )


def q6_cohort_abuse(profiles: DataFrame, scores: DataFrame, actions: DataFrame, when: Lookback) -> DataFrame:
    """Abuse by account age; the comparison is with the unweighted mean of the cohorts' rates."""
    rows = cohort_rows(profiles, scores, actions.where(when.covers("triggered_at")), COHORTS).withColumnRenamed("avg_enforcements", "avg_enforcements_per_user")
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # four rows
    return rows.withColumn("flagged_rate_vs_global_avg", rounded(F.col("flagged_rate_pct") - F.avg("flagged_rate_pct").over(everyone), 2)).withColumn("abuse_rate_rank", F.rank().over(Window.orderBy(F.desc("flagged_rate_pct"))))


def q7_weekly_enforcement(actions: DataFrame, profiles: DataFrame, when: Lookback, as_of: dt.datetime, new_days: int = 30, weeks: int = 4, spike: float = 1.5) -> DataFrame:
    """Actions by week, cohort and type with a running mean over the rows present, change and spike; a week without actions is one row 'all'."""
    cohort = F.when(F.col("account_age_days") < new_days, "new").otherwise("aged")
    done = (
        actions.where(when.covers("triggered_at")).join(profiles.select("user_id", "account_age_days"), "user_id")
        .groupBy(start_of("week", F.col("triggered_at")).alias("week_start"), cohort.alias("account_cohort"), "action_type").agg(F.count("*").alias("n"))
    )
    counted = weekly_spine(actions.sparkSession, when.start, when.end).join(done, "week_start", "left").withColumn("enforcement_count", F.coalesce("n", F.lit(0))).drop("n")
    w = Window.partitionBy("account_cohort", "action_type").orderBy("week_start")
    before = F.lag("enforcement_count").over(w)
    out = counted.withColumn("rolling_4wk_avg", rounded(F.avg("enforcement_count").over(w.rowsBetween(1 - weeks, 0)), 2)).withColumn("prev_week_count", before)
    n, prev = F.col("enforcement_count"), F.col("prev_week_count")
    return out.select(
        "week_start", (F.col("week_start") + F.expr("interval 6 days")).alias("week_end"),
        F.coalesce("account_cohort", F.lit("all")).alias("account_cohort"), F.coalesce("action_type", F.lit("all")).alias("action_type"),
        "enforcement_count", "rolling_4wk_avg", "prev_week_count", rounded(ratio((n - prev) * 100, prev), 2).alias("wow_change_pct"),
        F.coalesce(n > prev * F.lit(spike), F.lit(False)).alias("is_spike_week"),
        (F.col("week_start") < F.date_trunc("week", F.lit(str(as_of)).cast("timestamp_ntz")).cast("timestamp_ntz")).alias("is_complete_week"),
    )
