"""The 18 dashboard extracts and the 7 investigations as Spark SQL with named parameter markers, for tools that take SQL.

``run`` binds the parameters and returns the rows that the plan of the same name in ``dashboards`` or ``investigations`` gives.
``views`` names the tables; the export of the metadata carries the extracts.  Now is ``:as_of``, and ranges of time are hours or
days before it; investigations look from ``:start`` to ``:end``, both included.  Plans cut the windows of very active users into
slices of time; these texts leave them to the engine.  Its frames take no markers, so that of bursts is fixed to five minutes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .dashboards import Warehouse
from .investigations import Lookback

TABLES = ("raw_events", "user_profiles", "aggregated_user_metrics", "time_window_activity", "anomaly_scores", "enforcement_actions", "abuse_clusters", "threshold_history")
NOW = "cast(:as_of as timestamp_ntz)"


def _round(x: str, digits: int) -> str:
    """Half-up in decimal arithmetic, as double."""
    return f"cast(round(cast({x} as decimal(38,12)), {digits}) as double)"


def _pct(part: str, whole: str) -> str:
    return _round(f"cast(100 * {part} as double) / nullif(cast({whole} as double), 0d)", 2)


def _since(column: str, unit: str) -> str:
    return f"{column} >= {NOW} - " + ("make_dt_interval(0, :hours)" if unit == "hours" else "make_dt_interval(:days)")


_LATEST = """latest as (
  select user_id, x.* from (
    select user_id, max_by(struct(score_id, computed_at, combined_risk_score, zscore_value, isolation_score, model_version, is_flagged), struct(computed_at, score_id)) as x
    from anomaly_scores group by user_id))"""
_FLAGGED = "sum(case when is_flagged then 1 else 0 end)"


def _age(*names: str) -> str:
    return " ".join(["case", *(f"when account_age_days < {limit} then '{name}'" for name, limit in zip(names, (7, 30, 90), strict=False) if name != names[-1]), f"else '{names[-1]}' end"])


#: The values that a marker takes unless the caller gives another.
DEFAULTS: dict[str, dict[str, object]] = {
    "enforcement_actions_24h": {"hours": 24},
    "active_abuse_clusters": {"days": 7},
    "enforcement_false_positive_outcomes_pct": {"days": 30},
    "top_risk_users_live": {"top": 50},
    "enforcement_action_breakdown": {"hours": 24},
    "burst_activity_heatmap": {"window_type": "5min", "hours": 1, "above": 0.75},
    "cluster_risk_leaderboard": {"days": 7, "top": 100},
    "ip_multi_account_signals": {"hours": 24, "width": "10 minutes", "min_accounts": 3},
    "device_reuse_signals": {"hours": 24},
    "threshold_drift_monitor": {"days": 30},
    "session_success_rate_anomalies": {"hours": 24, "baseline_days": 30, "min_events": 10, "below": -2.0},
    "cohort_abuse_comparison": {"days": 30},
}

SQL: dict[str, str] = {
    "total_flagged_users": f"select count(distinct user_id) as total_flagged_users, {NOW} as computed_at from user_profiles where is_flagged",
    "high_risk_rate_pct": f"with {_LATEST}\nselect count(*) as total_scored_users, {_FLAGGED} as flagged_users, {_pct(_FLAGGED, 'count(*)')} as high_risk_rate_pct, {NOW} as computed_at from latest",
    "enforcement_actions_24h": f"select action_type, count(*) as action_count, min(triggered_at) as earliest, max(triggered_at) as latest\nfrom enforcement_actions where {_since('triggered_at', 'hours')} group by action_type",
    "false_positive_rate_latest": "select metric_name, threshold_value, false_positive_rate, false_negative_rate, updated_at, updated_by\nfrom threshold_history where metric_name = 'combined_risk_score' order by updated_at desc nulls first, threshold_id desc limit 1",
    "active_abuse_clusters": f"select cluster_id, detected_at, cluster_size, {_round('avg_risk_score', 4)} as avg_risk_score, cluster_label, shared_ips, shared_devices\nfrom abuse_clusters where {_since('detected_at', 'days')} and avg_risk_score > 0.5",
    "avg_risk_score_all_users": f"""with {_LATEST}
select {_round('avg(combined_risk_score)', 6)} as avg_risk_score, {_round('stddev_pop(combined_risk_score)', 6)} as stddev_risk_score,
       min(combined_risk_score) as min_risk_score, max(combined_risk_score) as max_risk_score, count(*) as scored_users, {NOW} as computed_at from latest""",
    "new_account_abuse_rate_pct": f"select {_age('0-6 days', '7-29 days', '30+ days')} as age_cohort, count(*) as total_users, {_FLAGGED} as flagged_users, {_pct(_FLAGGED, 'count(*)')} as abuse_rate_pct\nfrom user_profiles group by 1",
    "enforcement_false_positive_outcomes_pct": f"""with resolved as (select case when outcome = 'false_positive' then 1 else 0 end as wrong from enforcement_actions where resolved_at is not null and {_since('triggered_at', 'days')})
select count(*) as total_resolved, sum(wrong) as false_positive_count, {_pct('sum(wrong)', 'count(*)')} as fp_outcome_rate_pct from resolved""",
    "top_risk_users_live": f"""with {_LATEST},
best as (
  select l.*, p.country, p.account_age_days, p.is_flagged as profile_flagged from latest l join user_profiles p on p.user_id = l.user_id
  order by l.combined_risk_score desc nulls first, l.user_id limit :top),
still_open as (select user_id, count(action_id) as n from enforcement_actions where resolved_at is null and user_id in (select user_id from best) group by user_id)
select rank() over (order by combined_risk_score desc nulls first) as risk_rank, b.user_id, country, account_age_days, profile_flagged, {_round('combined_risk_score', 4)} as combined_risk_score,
       {_round('zscore_value', 4)} as zscore_value, {_round('isolation_score', 4)} as isolation_score, computed_at, model_version, coalesce(n, 0) as open_enforcements
from best b left join still_open o on o.user_id = b.user_id""",
    "anomaly_score_distribution": f"""with {_LATEST},
counted as (select width_bucket(combined_risk_score, 0d, 1d, 20L) as bucket_num, count(*) as user_count from latest group by 1)
select bucket_num, {_round('(bucket_num - 1) * 0.05d', 2)} as bucket_low, {_round('bucket_num * 0.05d', 2)} as bucket_high, user_count from counted""",
    "enforcement_action_breakdown": f"""with recent as (
  select action_type, resolved_at is not null as resolved, outcome from enforcement_actions where {_since('triggered_at', 'hours')})
select action_type, count(*) as total_actions, count_if(resolved) as resolved_actions, count_if(not resolved) as open_actions, count_if(outcome = 'confirmed_abuse') as confirmed_abuse,
       count_if(outcome = 'false_positive') as false_positives, {_pct("count_if(outcome = 'false_positive')", 'count_if(resolved)')} as fp_rate_pct from recent group by action_type""",
    "burst_activity_heatmap": f"""select w.user_id, p.country, w.window_start, w.window_end, w.window_type, w.action_count, {_round('w.burst_score', 4)} as burst_score
from time_window_activity w join user_profiles p on p.user_id = w.user_id where {_since('w.window_start', 'hours')} and w.window_type = :window_type and w.burst_score > :above""",
    "cluster_risk_leaderboard": f"""with recent as (select * from abuse_clusters where {_since('detected_at', 'days')} order by avg_risk_score desc nulls first, cluster_size desc, cluster_id limit :top)
select rank() over (order by avg_risk_score desc nulls first) as cluster_rank, cluster_id, detected_at, cluster_size, {_round('avg_risk_score', 4)} as avg_risk_score, cluster_label, shared_ips, shared_devices from recent""",
    "ip_multi_account_signals": f"""with {_LATEST},
per_user as (select ip_address, window(ts, :width) as w, user_id, count(*) as n from raw_events where {_since('ts', 'hours')} group by 1, 2, 3),
buckets as (
  select ip_address, w, count(user_id) as distinct_accounts, sum(n) as total_events, array_sort(collect_list(user_id)) as accounts
  from per_user group by ip_address, w having count(user_id) >= :min_accounts),
risks as (
  select b.ip_address, b.w, max_by(l.combined_risk_score, struct(l.computed_at, l.score_id)) as risk
  from (select ip_address, w, explode(accounts) as user_id from buckets) b join latest l on l.user_id = b.user_id group by b.ip_address, b.w)
select b.ip_address, b.w.start as bucket_start, b.w.end as bucket_end, distinct_accounts, total_events, {_round('risk', 4)} as avg_risk_score,
       array_join(transform(accounts, x -> cast(x as string)), ',') as account_list
from buckets b left join risks r on r.ip_address = b.ip_address and r.w = b.w""",
    "device_reuse_signals": f"""with seen as (
  select device_id, user_id, ts, lag(user_id) over d as user_from, lag(ts) over d as earlier from raw_events
  where {_since('ts', 'hours')} and device_id not in ('', 'unknown', 'N/A') window d as (partition by device_id order by ts, event_id)),
switches as (select device_id, user_from, ts, timestampdiff(microsecond, earlier, ts) / 1000000d as gap from seen where user_from <> user_id and timestampdiff(microsecond, earlier, ts) <= 1800000000)
select device_id, count(distinct user_from) as accounts_seen, count(*) as total_switches, min(ts) as first_switch, max(ts) as last_switch, {_round('avg(gap)', 1)} as avg_seconds_between,
       array_join(transform(array_sort(collect_set(user_from)), x -> cast(x as string)), ',') as involved_accounts
from switches group by device_id having count(distinct user_from) >= 2""",
    "threshold_drift_monitor": f"""select threshold_id, metric_name, threshold_value, false_positive_rate, false_negative_rate, updated_at, updated_by, lag(threshold_value) over m as prev_threshold,
       threshold_value - lag(threshold_value) over m as threshold_delta, false_positive_rate - lag(false_positive_rate) over m as fpr_delta
from threshold_history where {_since('updated_at', 'days')} window m as (partition by metric_name order by updated_at, threshold_id)""",
    "session_success_rate_anomalies": f"""with stats as (
  select user_id, session_id, min(ts) as session_start, max(ts) as session_end, count(*) as total_events, sum(case when success_flag then 1 else 0 end) as success_count,
         sum(case when not success_flag then 1 else 0 end) as failure_count, avg(cast(cast(success_flag as int) as double)) as rate
  from raw_events where {_since('ts', 'hours')} group by user_id, session_id having count(*) >= :min_events),
base as (select user_id, avg(success_rate) as m, stddev_pop(success_rate) as s from aggregated_user_metrics where window_start >= {NOW} - make_dt_interval(:baseline_days) group by user_id),
scored as (
  select t.user_id, session_id, session_start, session_end, total_events, success_count, failure_count, {_round('rate', 4)} as session_success_rate, {_round('m', 4)} as baseline_mean,
         {_round('s', 4)} as baseline_stddev, {_round('(rate - m) / nullif(s, 0d)', 4)} as success_zscore from stats t join base b on b.user_id = t.user_id)
select s.*, p.country, p.is_flagged from scored s join user_profiles p on p.user_id = s.user_id where success_zscore < :below""",
    "cohort_abuse_comparison": f"""with {_LATEST},
done as (select user_id, count(*) as n from enforcement_actions where {_since('triggered_at', 'days')} group by user_id),
users as (
  select {_age('0-6 days', '7-29 days', '30-89 days', '90+ days')} as age_cohort, p.is_flagged, l.combined_risk_score, coalesce(d.n, 0) as n
  from user_profiles p left join latest l on l.user_id = p.user_id left join done d on d.user_id = p.user_id)
select age_cohort, count(*) as total_users, {_FLAGGED} as flagged_users, {_pct(_FLAGGED, 'count(*)')} as flagged_rate_pct, {_round('avg(combined_risk_score)', 4)} as avg_risk_score,
       {_round('avg(n)', 4)} as avg_enforcements from users group by age_cohort""",
}


_COVERED = "between cast(:start as timestamp_ntz) and cast(:end as timestamp_ntz)"
_TEXT = "array_join(transform({}, x -> cast(x as string)), ',')"

INVESTIGATION_DEFAULTS: dict[str, dict[str, object]] = {
    "q1_burst": {"factor": 3.0, "min_events": 5, "min_window_count": 1},
    "q2_ip_clusters": {"width": "10 minutes", "min_accounts": 3, "min_risk": 0.4},
    "q3_device_reuse": {"seconds": 1800, "min_accounts": 2},
    "q4_session_success": {"min_events": 10, "below": -2.0, "baseline_days": 30},
    "q5_resource_density": {"width": "2 minutes", "min_resources": 10, "factor": 3.0, "baseline_days": 7},
    "q6_cohort_abuse": {},
    "q7_weekly_enforcement": {"new_days": 30, "spike": 1.5},
}

INVESTIGATIONS: dict[str, str] = {
    "q1_burst": f"""with seen as (
  select user_id, ts, unix_micros(cast(ts as timestamp)) as t, timestampdiff(microsecond, cast(:start as timestamp_ntz), cast(:end as timestamp_ntz)) / 3.6e9d as hours
  from raw_events where ts {_COVERED}),
counted as (
  select user_id, ts, hours, count(*) over (partition by user_id order by t range between 300000000 preceding and current row) as in_window, count(*) over (partition by user_id) as n from seen),
found as (select *, n / hours / 12d as expected from counted where n >= :min_events),
bursts as (
  select *, in_window / nullif(expected, 0d) as ratio from found where in_window > expected * :factor and in_window >= :min_window_count)
select b.user_id, p.country, p.is_flagged as already_flagged, b.ts as burst_peak_ts, in_window as events_in_5min_window, {_round('expected', 2)} as expected_per_5min, {_round('ratio', 2)} as burst_ratio,
       row_number() over (partition by b.user_id order by ratio desc, b.ts) as rank_within_user
from bursts b join user_profiles p on p.user_id = b.user_id""",
    "q2_ip_clusters": f"""with {_LATEST},
per_user as (select ip_address, window(ts, :width) as w, user_id, count(*) as n from raw_events where ts {_COVERED} group by 1, 2, 3),
buckets as (
  select ip_address, w, count(user_id) as distinct_accounts, sum(n) as total_events, array_sort(collect_list(user_id)) as accounts
  from per_user group by ip_address, w having count(user_id) >= :min_accounts),
risks as (
  select b.ip_address, b.w, max_by(l.combined_risk_score, struct(l.computed_at, l.score_id)) as risk
  from (select ip_address, w, explode(accounts) as user_id from buckets) b join latest l on l.user_id = b.user_id group by b.ip_address, b.w)
select b.ip_address, b.w.start as bucket_start, b.w.end as bucket_end, distinct_accounts, total_events, {_round('risk', 4)} as avg_risk_score,
       dense_rank() over (order by distinct_accounts desc, risk desc) as severity_rank, {_TEXT.format('accounts')} as account_list
from buckets b join risks r on r.ip_address = b.ip_address and r.w = b.w where risk >= :min_risk""",
    "q3_device_reuse": f"""with seen as (
  select device_id, user_id, ts, lag(user_id) over d as user_from, lag(ts) over d as earlier from raw_events
  where ts {_COVERED} and device_id not in ('', 'unknown', 'N/A') window d as (partition by device_id order by ts, event_id)),
switches as (select device_id, user_from, ts, timestampdiff(microsecond, earlier, ts) / 1000000d as gap from seen where user_from <> user_id and timestampdiff(microsecond, earlier, ts) <= :seconds * 1000000L),
summary as (
  select device_id, count(distinct user_from) as accounts_seen, count(*) as total_switches, min(ts) as first_switch_ts, max(ts) as last_switch_ts, {_round('avg(gap)', 1)} as avg_seconds_between_switches,
         {_TEXT.format('array_sort(collect_set(user_from))')} as involved_accounts from switches group by device_id having count(distinct user_from) >= :min_accounts)
select *, rank() over (order by accounts_seen desc, total_switches desc) as risk_rank from summary""",
    "q4_session_success": f"""with stats as (
  select user_id, session_id, min(ts) as session_start, max(ts) as session_end, count(*) as total_events, sum(case when success_flag then 1 else 0 end) as success_count,
         sum(case when not success_flag then 1 else 0 end) as failure_count, avg(cast(cast(success_flag as int) as double)) as rate
  from raw_events where ts {_COVERED} group by user_id, session_id having count(*) >= :min_events),
base as (
  select user_id, avg(success_rate) as m, stddev_pop(success_rate) as s from aggregated_user_metrics where window_start >= cast(:start as timestamp_ntz) - make_dt_interval(:baseline_days) group by user_id),
scored as (
  select t.user_id, session_id, session_start, session_end, total_events, success_count, failure_count, {_round('rate', 4)} as session_success_rate, {_round('m', 4)} as baseline_mean,
         {_round('s', 4)} as baseline_stddev, {_round('(rate - m) / nullif(s, 0d)', 4)} as success_zscore from stats t join base b on b.user_id = t.user_id)
select s.*, row_number() over (partition by s.user_id order by success_zscore, session_id) as rank_within_user, p.country, p.is_flagged as account_flagged
from scored s join user_profiles p on p.user_id = s.user_id where success_zscore < :below""",
    "q5_resource_density": f"""with counted as (
  select user_id, window(ts, :width) as w, count(distinct resource_id) as distinct_resources from raw_events
  where ts {_COVERED} and resource_id is not null and action_type not in ('prefetch', 'cdn_hit', 'heartbeat') group by 1, 2 having count(distinct resource_id) >= :min_resources),
medians as (
  select user_id, percentile_cont(0.5) within group (order by action_count) as med from aggregated_user_metrics
  where window_start >= cast(:start as timestamp_ntz) - make_dt_interval(:baseline_days) group by user_id),
dense as (
  select c.user_id, c.w, c.distinct_resources, m.med, rank() over (partition by c.user_id order by distinct_resources desc) as rank_within_user
  from counted c left join medians m on m.user_id = c.user_id where m.med is null or c.distinct_resources >= m.med * :factor)
select d.user_id, p.country, p.is_flagged, d.w.start as window_start, d.w.end as window_end, distinct_resources, {_round('med', 2)} as baseline_median,
       {_round('cast(distinct_resources as double) / nullif(cast(med as double), 0d)', 2)} as density_ratio, rank_within_user
from dense d join user_profiles p on p.user_id = d.user_id""",
    "q6_cohort_abuse": f"""with {_LATEST},
done as (select user_id, count(*) as n from enforcement_actions where triggered_at {_COVERED} group by user_id),
users as (
  select {_age('0–6 days', '7–29 days', '30–89 days', '90+ days')} as age_cohort, p.is_flagged, l.combined_risk_score, coalesce(d.n, 0) as n
  from user_profiles p left join latest l on l.user_id = p.user_id left join done d on d.user_id = p.user_id),
cohorts as (
  select age_cohort, count(*) as total_users, {_FLAGGED} as flagged_users, {_pct(_FLAGGED, 'count(*)')} as flagged_rate_pct, {_round('avg(combined_risk_score)', 4)} as avg_risk_score,
         {_round('avg(n)', 4)} as avg_enforcements_per_user, sum(n) as total_enforcements from users group by age_cohort)
select *, {_round('flagged_rate_pct - avg(flagged_rate_pct) over ()', 2)} as flagged_rate_vs_global_avg, rank() over (order by flagged_rate_pct desc) as abuse_rate_rank from cohorts""",
    "q7_weekly_enforcement": f"""with spine as (
  select explode(sequence(cast(date_trunc('week', cast(:start as timestamp_ntz)) as timestamp_ntz), cast(date_trunc('week', cast(:end as timestamp_ntz)) as timestamp_ntz), interval '7' day)) as week_start),
done as (
  select cast(date_trunc('week', e.triggered_at) as timestamp_ntz) as week_start, case when p.account_age_days < :new_days then 'new' else 'aged' end as account_cohort, e.action_type, count(*) as n
  from enforcement_actions e join user_profiles p on p.user_id = e.user_id where e.triggered_at {_COVERED} group by 1, 2, 3),
counted as (select s.week_start, d.account_cohort, d.action_type, coalesce(d.n, 0) as enforcement_count from spine s left join done d on d.week_start = s.week_start),
rolled as (
  select *, {_round('avg(enforcement_count) over (partition by account_cohort, action_type order by week_start rows between 3 preceding and current row)', 2)} as rolling_4wk_avg,
         lag(enforcement_count) over (partition by account_cohort, action_type order by week_start) as prev_week_count from counted)
select week_start, week_start + interval '6' day as week_end, coalesce(account_cohort, 'all') as account_cohort, coalesce(action_type, 'all') as action_type, enforcement_count, rolling_4wk_avg, prev_week_count,
       {_pct('(enforcement_count - prev_week_count)', 'prev_week_count')} as wow_change_pct, coalesce(enforcement_count > prev_week_count * :spike, false) as is_spike_week,
       week_start < cast(date_trunc('week', {NOW}) as timestamp_ntz) as is_complete_week from rolled""",
}


def views(t: Warehouse) -> None:
    """Temporary views of the tables, under the names that the texts use."""
    for name in TABLES:
        getattr(t, name).createOrReplaceTempView(name)


def _bound(spark: SparkSession, name: str, text: str, known: dict[str, object], fixed: dict[str, str], given: dict[str, object]) -> DataFrame:
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
    args = {**fixed, **known, **given}
    return spark.sql(text, {k: v for k, v in args.items() if f":{k}" in text})


def run(spark: SparkSession, name: str, as_of: dt.datetime, **given: object) -> DataFrame:
    """The rows of extract ``name`` over the views of the session; ``given`` replaces defaults of its markers."""
    return _bound(spark, name, SQL[name], DEFAULTS.get(name, {}), {"as_of": str(as_of)}, given)


def investigate(spark: SparkSession, name: str, when: Lookback, as_of: dt.datetime | None = None, **given: object) -> DataFrame:
    """The rows of investigation ``name`` over the views of the session, from ``when.start`` to ``when.end``."""
    fixed = {"start": str(when.start), "end": str(when.end), "as_of": str(as_of or when.end)}
    return _bound(spark, name, INVESTIGATIONS[name], INVESTIGATION_DEFAULTS[name], fixed, given)
