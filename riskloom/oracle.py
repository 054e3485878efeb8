"""The registered queries as DuckDB SQL over the raw tables, written independently of the DataFrame plans."""

from __future__ import annotations

import re

from .plans.metadata import RULES

#: The derived tables as common table expressions.
FIXTURES = {
    "raw_events": """select event_id, user_id, ts,
        concat('s', cast(user_id as varchar), '_', cast(cast(date_trunc('week', ts) as date) as varchar)) as session_id,
        concat('10.0.', cast(user_id // 5 as varchar), '.', cast(k % 4 as varchar)) as ip_address,
        case when k < 3 then 'unknown' else concat('dev_', cast(user_id // 10 as varchar), '_', cast(k % 8 as varchar)) end as device_id,
        event_type as action_type, case when event_type = 'signup' then null else concat('res_', cast(k as varchar)) end as resource_id,
        event_type <> 'error' as success_flag, case when value > 150 then 'rate_limit' end as enforcement_action
        from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e""",
    "user_profiles": """select c_custkey as user_id, n_name as country, cast((c_custkey * 37) % 120 as int) as account_age_days, c_acctbal < 0 as is_flagged
        from customer join nation on c_nationkey = n_nationkey""",
    "enforcement_actions": """select o_orderkey as action_id, o_custkey as user_id,
        case o_orderpriority when '1-URGENT' then 'ban' when '2-HIGH' then 'suspend' when '3-MEDIUM' then 'rate_limit' when '4-NOT SPECIFIED' then 'warning' else 'captcha' end as action_type,
        o_orderdate as triggered_at, case when o_orderstatus = 'O' then null else o_orderdate + interval '3' day end as resolved_at,
        case o_orderstatus when 'F' then 'confirmed_abuse' when 'P' then 'false_positive' end as outcome from orders""",
    "anomaly_scores": """select o_orderkey as score_id, o_custkey as user_id, o_orderdate as computed_at,
        o_totalprice / cast(100000 as double) - cast(2.5 as double) as zscore_value, cast(o_orderkey % 1000 as double) / cast(1000 as double) as isolation_score,
        least(cast(1 as double), o_totalprice / cast(500000 as double)) as combined_risk_score, o_totalprice >= 350000 as is_flagged, 'v1' as model_version from orders""",
    "aggregated_user_metrics": """select user_id, date_trunc('day', ts) as window_start, count(*) as action_count, count(distinct ip_address) as unique_ips, count(distinct device_id) as unique_devices,
        avg(cast(cast(success_flag as int) as double)) as success_rate, count(enforcement_action) as enforcement_count from raw_events group by user_id, date_trunc('day', ts)""",
    "time_window_activity": """select user_id, window_start, window_start + interval '1' hour as window_end, '1hr' as window_type, action_count, cast(action_count as double) / max(action_count) over () as burst_score
        from (select user_id, date_trunc('hour', ts) as window_start, count(*) as action_count from raw_events group by user_id, date_trunc('hour', ts)) w""",
    "abuse_clusters": """select s_suppkey as cluster_id, timestamp '2024-01-01 00:00:00' + (s_suppkey % 30) * interval '1' day as detected_at, 2 + s_suppkey % 9 as cluster_size,
        (s_acctbal + cast(1000 as double)) / cast(11000 as double) as avg_risk_score,
        case s_nationkey % 3 when 0 then 'credential_stuffing' when 1 then 'scraping_ring' else 'fake_reviews' end as cluster_label,
        cast(null as varchar) as shared_ips, cast(null as varchar) as shared_devices from supplier""",
    "threshold_history": """select o_orderkey as threshold_id, case o_orderstatus when 'F' then 'combined_risk_score' when 'O' then 'zscore_value' else 'burst_score' end as metric_name,
        o_totalprice / cast(5000 as double) as threshold_value, cast(o_orderkey % 50 as double) / cast(1000 as double) as false_positive_rate,
        cast(o_orderkey % 70 as double) / cast(1000 as double) as false_negative_rate, o_orderdate as updated_at, 'calibrator' as updated_by from orders""",
    "scored_labels": """select l.doc_id, l.toxic as y_true, cast((d.n_chars * 37 + l.doc_id * 11) % 1000 as double) / cast(10 as double) as y_score
        from labels l join documents d on l.doc_id = d.doc_id""",
    "latest_scores": """select * exclude (rn) from (select *, row_number() over (partition by user_id order by computed_at desc, score_id desc) as rn from anomaly_scores) s where rn = 1""",
    "feature_events": """select event_id, user_id, ts, session_id, ip_address, device_id, action_type as action, case when enforcement_action is not null then 1 else 0 end as enforced from raw_events""",
}
_NEEDS = {"aggregated_user_metrics": ["raw_events"], "time_window_activity": ["raw_events"], "latest_scores": ["anomaly_scores"], "feature_events": ["raw_events"]}


def _with(names: str, *ctes_and_body: str) -> str:
    """A query with fixtures, more CTEs (``name as (...)``) and a body."""
    wanted: list[str] = []
    for name in names.split():
        for x in [*_NEEDS.get(name, []), name]:
            if x not in wanted:
                wanted.append(x)
    *ctes, body = ctes_and_body
    parts = [f"{x} as ({FIXTURES[x]})" for x in wanted] + list(ctes)
    return "with " + ",\n".join(parts) + "\n" + body


def _r(x: str, n: int) -> str:
    """Half-up rounding in decimal arithmetic."""
    return f"cast(round(cast({x} as decimal(38,12)), {n}) as double)"


def _sum(x: str) -> str:
    return f"cast(sum({x}) as bigint)"


EV = "ts between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-31 00:00:00'"
_micro = "(epoch_us({}) - epoch_us({}))"



def _dense(times: int) -> str:
    start = "epoch_us(timestamp '2024-01-01 00:00:00')"
    return f"dense as (select * replace (make_timestamp({start} + (epoch_us(ts) - {start}) // {times}) as ts) from raw_events)"


def _burst(events: str, least: int) -> list[str]:
    return [
        f"counted as (select user_id, ts, count(*) over (partition by user_id order by ts range between interval '5 minutes' preceding and current row) as events_in_5min_window, count(*) over (partition by user_id) as n from {events} where {EV})",
        "found as (select *, n / cast(720 as double) / cast(12 as double) as expected from counted where n >= 5)",
        f"kept as (select *, events_in_5min_window / expected as ratio from found where events_in_5min_window > expected * 3 and events_in_5min_window >= {least})",
        f"""select k.user_id, country, is_flagged as already_flagged, ts as burst_peak_ts, events_in_5min_window, {_r('expected', 2)} as expected_per_5min, {_r('ratio', 2)} as burst_ratio,
       row_number() over (partition by k.user_id order by ratio desc, ts) as rank_within_user from kept k join user_profiles p on k.user_id = p.user_id""",
    ]


_Q1 = _with("raw_events user_profiles", *_burst("raw_events", 2))


def _ip(where: str, events: str = "raw_events", bucket: str = "date_trunc('day', ts)") -> list[str]:
    return [
        f"per_user as (select ip_address, {bucket} as bucket_start, user_id, count(*) as n from {events} where {where} group by 1, 2, 3)",
        f"buckets as (select ip_address, bucket_start, count(*) as distinct_accounts, {_sum('n')} as total_events, string_agg(cast(user_id as varchar), ',' order by user_id) as account_list from per_user group by 1, 2 having count(*) >= 3)",
        "newest as (select p.ip_address, p.bucket_start, a.combined_risk_score as risk, row_number() over (partition by p.ip_address, p.bucket_start order by a.computed_at desc, a.score_id desc) as rn from per_user p join anomaly_scores a on p.user_id = a.user_id)",
    ]


def _clusters(events: str, bucket: str, width: str) -> list[str]:
    return [
        *_ip(EV, events, bucket),
        f"""select b.ip_address, b.bucket_start, b.bucket_start + interval '{width}' as bucket_end, distinct_accounts, total_events, {_r('risk', 4)} as avg_risk_score,
       dense_rank() over (order by distinct_accounts desc, risk desc) as severity_rank, account_list
       from buckets b join newest n on b.ip_address = n.ip_address and b.bucket_start = n.bucket_start and n.rn = 1 where risk >= 0.4""",
    ]


_Q2 = _with("raw_events anomaly_scores", *_clusters("raw_events", "date_trunc('day', ts)", "1 day"))


def _switches(where: str) -> list[str]:
    return [
        f"seen as (select device_id, user_id, ts, lag(user_id) over w as user_from, lag(ts) over w as before from raw_events where {where} and device_id not in ('', 'unknown', 'N/A') window w as (partition by device_id order by ts, event_id))",
        f"switches as (select *, {_micro.format('ts', 'before')} / cast(1000000 as double) as gap from seen where user_from <> user_id and {_micro.format('ts', 'before')} <= 1800000000)",
        f"summary as (select device_id, count(distinct user_from) as accounts_seen, count(*) as total_switches, min(ts) as first_switch, max(ts) as last_switch, {_r('avg(gap)', 1)} as avg_gap from switches group by device_id having count(distinct user_from) >= 2)",
        "who as (select device_id, string_agg(cast(user_from as varchar), ',' order by user_from) as involved_accounts from (select distinct device_id, user_from from switches) d group by device_id)",
    ]


_Q3 = _with("raw_events", *_switches(EV),
    "select s.device_id, accounts_seen, total_switches, first_switch as first_switch_ts, last_switch as last_switch_ts, avg_gap as avg_seconds_between_switches, involved_accounts, rank() over (order by accounts_seen desc, total_switches desc) as risk_rank from summary s join who w on s.device_id = w.device_id")


def _sessions(where: str, since: str) -> list[str]:
    return [
        f"stats as (select user_id, session_id, min(ts) as session_start, max(ts) as session_end, count(*) as total_events, {_sum('case when success_flag then 1 else 0 end')} as success_count, {_sum('case when not success_flag then 1 else 0 end')} as failure_count, avg(cast(cast(success_flag as int) as double)) as rate from raw_events where {where} group by user_id, session_id having count(*) >= 10)",
        f"base as (select user_id, avg(success_rate) as m, stddev_pop(success_rate) as s from aggregated_user_metrics where window_start >= {since} group by user_id)",
        f"scored as (select t.user_id, session_id, session_start, session_end, total_events, success_count, failure_count, {_r('rate', 4)} as session_success_rate, {_r('m', 4)} as baseline_mean, {_r('s', 4)} as baseline_stddev, {_r('(rate - m) / nullif(s, 0)', 4)} as success_zscore from stats t join base b on t.user_id = b.user_id)",
    ]


def _q4(below: float) -> str:
    return _with("raw_events aggregated_user_metrics user_profiles", *_sessions(EV, "timestamp '2023-12-02 00:00:00'"),
        f"select s.*, row_number() over (partition by s.user_id order by success_zscore, session_id) as rank_within_user, country, is_flagged as account_flagged from scored s join user_profiles p on s.user_id = p.user_id where success_zscore < {below}")


def _density(events: str, bucket: str, width: str, least: int, factor: int) -> list[str]:
    return [
        f"counted as (select user_id, {bucket} as window_start, count(distinct resource_id) as distinct_resources from {events} where {EV} and resource_id is not null and action_type not in ('prefetch', 'cdn_hit', 'heartbeat') group by 1, 2 having count(distinct resource_id) >= {least})",
        "medians as (select user_id, quantile_cont(action_count, 0.5) as med from aggregated_user_metrics where window_start >= timestamp '2023-12-25 00:00:00' group by user_id)",
        f"dense_windows as (select c.*, med, rank() over (partition by c.user_id order by distinct_resources desc) as rank_within_user from counted c left join medians m on c.user_id = m.user_id where med is null or distinct_resources >= med * {factor})",
        f"select d.user_id, country, is_flagged, window_start, window_start + interval '{width}' as window_end, distinct_resources, {_r('med', 2)} as baseline_median, {_r('distinct_resources / nullif(cast(med as double), 0)', 2)} as density_ratio, rank_within_user from dense_windows d join user_profiles p on d.user_id = p.user_id",
    ]


_Q4 = _q4(-0.5)
_Q5 = _with("raw_events aggregated_user_metrics user_profiles", *_density("raw_events", "date_trunc('day', ts)", "1 day", 5, 2))


def _cohorts(labels: tuple[str, str, str, str], where: str) -> list[str]:
    a, b, c, d = labels
    return [
        f"done as (select user_id, count(*) as n from enforcement_actions where {where} group by user_id)",
        f"""cohorts as (select case when account_age_days < 7 then '{a}' when account_age_days < 30 then '{b}' when account_age_days < 90 then '{c}' else '{d}' end as age_cohort,
            count(*) as total_users, {_sum('case when p.is_flagged then 1 else 0 end')} as flagged_users, {_r('cast(100 as double) * sum(case when p.is_flagged then 1 else 0 end) / count(*)', 2)} as flagged_rate_pct,
            {_r('avg(combined_risk_score)', 4)} as avg_risk_score, {_r('avg(cast(coalesce(n, 0) as double))', 4)} as avg_enf, {_sum('coalesce(n, 0)')} as total_enforcements
            from user_profiles p left join latest_scores s on p.user_id = s.user_id left join done e on p.user_id = e.user_id group by 1)""",
    ]


_Q6 = _with("user_profiles latest_scores enforcement_actions",
    *_cohorts(("0–6 days", "7–29 days", "30–89 days", "90+ days"), "triggered_at between timestamp '2000-01-01 00:00:00' and timestamp '2000-12-31 00:00:00'"),
    f"select age_cohort, total_users, flagged_users, flagged_rate_pct, avg_risk_score, avg_enf as avg_enforcements_per_user, total_enforcements, {_r('flagged_rate_pct - avg(flagged_rate_pct) over ()', 2)} as flagged_rate_vs_global_avg, rank() over (order by flagged_rate_pct desc) as abuse_rate_rank from cohorts")
_SPINE = "spine as (select unnest(generate_series(date_trunc('week', timestamp '2000-01-01 00:00:00'), date_trunc('week', timestamp '2000-12-31 00:00:00'), interval '7 days')) as week_start)"
_Q7 = _with("enforcement_actions user_profiles", _SPINE,
    """done as (select date_trunc('week', triggered_at) as week_start, case when account_age_days < 30 then 'new' else 'aged' end as account_cohort, action_type, count(*) as n
        from enforcement_actions e join user_profiles p on e.user_id = p.user_id where triggered_at between timestamp '2000-01-01 00:00:00' and timestamp '2000-12-31 00:00:00' group by 1, 2, 3)""",
    "counted as (select s.week_start, account_cohort, action_type, coalesce(n, 0) as enforcement_count from spine s left join done d on s.week_start = d.week_start)",
    f"rolled as (select *, {_r('avg(enforcement_count) over (partition by account_cohort, action_type order by week_start rows between 3 preceding and current row)', 2)} as rolling_4wk_avg, lag(enforcement_count) over (partition by account_cohort, action_type order by week_start) as prev_week_count from counted)",
    f"""select week_start, week_start + interval '6 days' as week_end, coalesce(account_cohort, 'all') as account_cohort, coalesce(action_type, 'all') as action_type, enforcement_count, rolling_4wk_avg, prev_week_count,
       {_r('cast(100 as double) * (enforcement_count - prev_week_count) / nullif(prev_week_count, 0)', 2)} as wow_change_pct, coalesce(enforcement_count > prev_week_count * cast(1.5 as double), false) as is_spike_week,
       week_start < date_trunc('week', timestamp '2001-06-01 00:00:00') as is_complete_week from rolled""")  # fmt: skip

_NOW_E, _NOW_O = "timestamp '2024-01-31 00:00:00'", "timestamp '2001-06-01 00:00:00'"
_DASH = {
    "total_flagged_users": _with("user_profiles", f"select count(distinct user_id) as total_flagged_users, {_NOW_E} as computed_at from user_profiles where is_flagged"),
    "high_risk_rate_pct": _with("latest_scores", f"select count(*) as total_scored_users, {_sum('case when is_flagged then 1 else 0 end')} as flagged_users, {_r('cast(100 as double) * sum(case when is_flagged then 1 else 0 end) / count(*)', 2)} as high_risk_rate_pct, {_NOW_O} as computed_at from latest_scores"),
    "enforcement_actions_24h": _with("enforcement_actions", f"select action_type, count(*) as action_count, min(triggered_at) as earliest, max(triggered_at) as latest from enforcement_actions where triggered_at >= {_NOW_O} - interval '24 hours' group by action_type"),
    "false_positive_rate_latest": _with("threshold_history", "select metric_name, threshold_value, false_positive_rate, false_negative_rate, updated_at, updated_by from threshold_history where metric_name = 'combined_risk_score' order by updated_at desc, threshold_id desc limit 1"),
    "active_abuse_clusters": _with("abuse_clusters", f"select cluster_id, detected_at, cluster_size, {_r('avg_risk_score', 4)} as avg_risk_score, cluster_label, shared_ips, shared_devices from abuse_clusters where detected_at >= {_NOW_E} - interval '7 days' and avg_risk_score > 0.5"),
    "avg_risk_score_all_users": _with("latest_scores", f"select {_r('avg(combined_risk_score)', 6)} as avg_risk_score, {_r('stddev_pop(combined_risk_score)', 6)} as stddev_risk_score, min(combined_risk_score) as min_risk_score, max(combined_risk_score) as max_risk_score, count(*) as scored_users, {_NOW_E} as computed_at from latest_scores"),
    "new_account_abuse_rate_pct": _with("user_profiles", f"select case when account_age_days < 7 then '0-6 days' when account_age_days < 30 then '7-29 days' else '30+ days' end as age_cohort, count(*) as total_users, {_sum('case when is_flagged then 1 else 0 end')} as flagged_users, {_r('cast(100 as double) * sum(case when is_flagged then 1 else 0 end) / count(*)', 2)} as abuse_rate_pct from user_profiles group by 1"),
    "enforcement_false_positive_outcomes_pct": _with("enforcement_actions", f"select count(*) as total_resolved, {_sum('case when outcome = ' + chr(39) + 'false_positive' + chr(39) + ' then 1 else 0 end')} as false_positive_count, {_r('cast(100 as double) * sum(case when outcome = ' + chr(39) + 'false_positive' + chr(39) + ' then 1 else 0 end) / nullif(count(*), 0)', 2)} as fp_outcome_rate_pct from enforcement_actions where resolved_at is not null and triggered_at >= {_NOW_O} - interval '30 days'"),
    "top_risk_users_live": _with("latest_scores user_profiles enforcement_actions",
        "still_open as (select user_id, count(action_id) as n from enforcement_actions where resolved_at is null group by user_id)",
        f"""select rank() over (order by s.combined_risk_score desc) as risk_rank, s.user_id, country, account_age_days, p.is_flagged as profile_flagged, {_r('combined_risk_score', 4)} as combined_risk_score, {_r('zscore_value', 4)} as zscore_value,
           {_r('isolation_score', 4)} as isolation_score, computed_at, model_version, coalesce(n, 0) as open_enforcements from latest_scores s join user_profiles p on s.user_id = p.user_id left join still_open o on s.user_id = o.user_id order by s.combined_risk_score desc, s.user_id limit 50"""),
    "anomaly_score_distribution": _with("latest_scores",
        "b as (select case when combined_risk_score >= 1 then 21 when combined_risk_score < 0 then 0 else cast(floor(combined_risk_score * 20) as bigint) + 1 end as bucket_num, count(*) as user_count from latest_scores group by 1)",
        f"select cast(bucket_num as bigint) as bucket_num, {_r('(bucket_num - 1) * cast(0.05 as double)', 2)} as bucket_low, {_r('bucket_num * cast(0.05 as double)', 2)} as bucket_high, user_count from b"),
    "enforcement_action_breakdown": _with("enforcement_actions", f"""select action_type, count(*) as total_actions, count(*) filter (where resolved_at is not null) as resolved_actions, count(*) filter (where resolved_at is null) as open_actions,
        count(*) filter (where outcome = 'confirmed_abuse') as confirmed_abuse, count(*) filter (where outcome = 'false_positive') as false_positives,
        {_r("cast(100 as double) * count(*) filter (where outcome = 'false_positive') / nullif(count(*) filter (where resolved_at is not null), 0)", 2)} as fp_rate_pct from enforcement_actions where triggered_at >= {_NOW_O} - interval '24 hours' group by action_type"""),
    "burst_activity_heatmap": _with("time_window_activity user_profiles", f"select w.user_id, country, window_start, window_end, window_type, action_count, {_r('burst_score', 4)} as burst_score from time_window_activity w join user_profiles p on w.user_id = p.user_id where window_start >= {_NOW_E} - interval '744 hours' and window_type = '1hr' and burst_score > 0.75"),
    "cluster_risk_leaderboard": _with("abuse_clusters", f"select rank() over (order by avg_risk_score desc) as cluster_rank, cluster_id, detected_at, cluster_size, {_r('avg_risk_score', 4)} as avg_risk_score, cluster_label, shared_ips, shared_devices from abuse_clusters where detected_at >= {_NOW_E} - interval '7 days' order by abuse_clusters.avg_risk_score desc, cluster_size desc, cluster_id limit 100"),
    "ip_multi_account_signals": _with("raw_events anomaly_scores", *_ip(f"ts >= {_NOW_E} - interval '168 hours'"),
        f"select b.ip_address, b.bucket_start, b.bucket_start + interval '1' day as bucket_end, distinct_accounts, total_events, {_r('risk', 4)} as avg_risk_score, account_list from buckets b left join newest n on b.ip_address = n.ip_address and b.bucket_start = n.bucket_start and n.rn = 1"),
    "device_reuse_signals": _with("raw_events", *_switches(f"ts >= {_NOW_E} - interval '744 hours'"),
        "select s.device_id, accounts_seen, total_switches, first_switch, last_switch, avg_gap as avg_seconds_between, involved_accounts from summary s join who w on s.device_id = w.device_id"),
    "threshold_drift_monitor": _with("threshold_history", f"""select threshold_id, metric_name, threshold_value, false_positive_rate, false_negative_rate, updated_at, updated_by, lag(threshold_value) over w as prev_threshold,
        threshold_value - lag(threshold_value) over w as threshold_delta, false_positive_rate - lag(false_positive_rate) over w as fpr_delta from threshold_history where updated_at >= {_NOW_O} - interval '30 days' window w as (partition by metric_name order by updated_at, threshold_id)"""),
    "session_success_rate_anomalies": _with("raw_events aggregated_user_metrics user_profiles", *_sessions(f"ts >= {_NOW_E} - interval '744 hours'", f"{_NOW_E} - interval '31 days'"),
        "select s.*, country, is_flagged from scored s join user_profiles p on s.user_id = p.user_id where success_zscore < -1"),
    "cohort_abuse_comparison": _with("user_profiles latest_scores enforcement_actions", *_cohorts(("0-6 days", "7-29 days", "30-89 days", "90+ days"), f"triggered_at >= {_NOW_O} - interval '30 days'"),
        "select age_cohort, total_users, flagged_users, flagged_rate_pct, avg_risk_score, avg_enf as avg_enforcements from cohorts"),
}

_DAY_BACK = f"cast(floor((epoch({_NOW_E}) - epoch(triggered_at)) / 86400) as bigint)"
_RULE_VALUES = {
    "exec_high_risk_rate": f"select {_r('cast(100 as double) * sum(case when is_flagged then 1 else 0 end) / count(*)', 2)} from latest_scores",
    "exec_enforcement_spike": "select case when stddev_samp(n) filter (where back > 0) >= 1e-9 then (coalesce(max(n) filter (where back = 0), 0) - avg(n) filter (where back > 0)) / stddev_samp(n) filter (where back > 0) end from days",
    "exec_fpr_breach": "select false_positive_rate from (select * from threshold_history where metric_name = 'combined_risk_score' order by updated_at desc, threshold_id desc limit 1) h",
    "analyst_cluster_surge": f"select count(*) from abuse_clusters where detected_at >= {_NOW_E} - interval '7 days' and avg_risk_score > 0.5",
    "analyst_new_account_abuse": f"select {_r('cast(100 as double) * sum(case when is_flagged then 1 else 0 end) / count(*)', 2)} from user_profiles where account_age_days < 7",
    "analyst_burst_heatmap_saturation": f"select count(*) from time_window_activity w join user_profiles p on w.user_id = p.user_id where window_start >= {_NOW_E} - interval '1 hour' and window_type = '5min' and burst_score > 0.75",
    "analyst_device_reuse_surge": "select count(*) from summary",
    "analyst_ip_multi_account_surge": "select count(*) from buckets",
}
_RULES = [
    *_switches(f"ts >= {_NOW_E} - interval '24 hours'"), *_ip(f"ts >= {_NOW_E} - interval '24 hours'", "raw_events", "time_bucket(interval '10 minutes', ts)"),
    f"days as (select {_DAY_BACK} as back, cast(count(*) as double) as n from enforcement_actions where {_DAY_BACK} between 0 and 30 group by 1)",
    "ruled as (" + " union all ".join(
        f"select '{r.rule_id}' as rule_id, '{r.metric_id}' as metric_id, '{r.severity}' as severity, {_r(f'cast(({_RULE_VALUES[r.rule_id]}) as double)', 9)} as value, cast({r.threshold} as double) as threshold" for r in RULES
    ) + ")",
    "evaluated as (select *, coalesce(value > threshold, false) as fires from ruled)",
]
_RULE_TABLES = "raw_events user_profiles latest_scores enforcement_actions threshold_history abuse_clusters time_window_activity"


def _message(r) -> str:
    """The rendered message of a rule, of each channel."""
    before, digits, after = re.fullmatch(r"(.*)\{value:\.(\d)f\}(.*)", r.message_template).groups()
    return f"select rule_id, severity, unnest({list(r.channels)}) as channel, '{before}' || printf('%.{digits}f', value) || '{after}' as message from evaluated where fires and rule_id = '{r.rule_id}'"


# -- features ----------------------------------------------------------------

_WINDOWS = (5, 15, 60)
_ROLLED = "rolled as (select user_id, " + ", ".join(
    f"count(action) over (partition by user_id order by ts range between interval '{w * 60 - 1}.999999 seconds' preceding and current row) - (count(action) over (partition by user_id, ts) - count(action) over (partition by user_id, ts order by event_id rows between unbounded preceding and current row)) as n{w}"
    for w in _WINDOWS
) + " from feature_events)"
_FREQ = "freq as (select user_id, " + ", ".join(f"avg(n{w}) as action_freq_{w}m_mean, cast(max(n{w}) as double) as action_freq_{w}m_max" for w in _WINDOWS) + " from rolled group by user_id)"
_ENTROPY = [
    "per_ip as (select user_id, ip_address, count(action) as n from feature_events where ip_address is not null group by 1, 2)",
    "totals as (select user_id, count(action) as total, count(distinct ip_address) as unique_ip_count from feature_events group by 1)",
    "entropy as (select t.user_id, case when t.total >= 3 then coalesce(-sum(n / cast(t.total as double) * log2(n / cast(t.total as double))), 0) else 0 end as ip_entropy, t.unique_ip_count from totals t left join per_ip p on t.user_id = p.user_id and p.n > 0 group by t.user_id, t.total, t.unique_ip_count)",
]
_DEVICE = [
    "owned as (select distinct user_id, device_id from feature_events)",
    "sharing as (select device_id, count(*) - 1 as excess from owned where device_id is not null group by 1)",
    "per_owner as (select user_id, avg(excess) as m, cast(max(excess) as double) as max_device_sharing from owned o left join sharing s on o.device_id = s.device_id group by user_id)",
    "device as (select user_id, case when (select max(m) from per_owner) > 0 then m / (select max(m) from per_owner) else m end as device_reuse_score, max_device_sharing from per_owner)",
]
_SESSION = [
    f"marked as (select user_id, ts, action, case when {_micro.format('ts', 'lag(ts) over (partition by user_id order by ts)')} <= 1800000000 then 0 else 1 end as is_new from feature_events)",
    "numbered as (select *, sum(is_new) over (partition by user_id order by ts rows between unbounded preceding and current row) as seq from marked)",
    "spans as (select user_id, seq, count(action) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / cast(1000000 as double) as dur from numbered group by 1, 2)",
    "velocity as (select user_id, avg(least(case when dur > 0 then (n - 1) / dur else 0 end, 1000)) as session_velocity_mean, max(least(case when dur > 0 then (n - 1) / dur else 0 end, 1000)) as session_velocity_max, count(*) as session_count from spans group by 1)",
]
_ENFORCED = [f"enforced as (select user_id, case when count(action) > 0 then sum(enforced) / cast(count(action) as double) else 0 end as enforcement_rate, {_sum('enforced')} as total_enforcements, count(action) as total_events from feature_events group by 1)"]
_FEATURES = [*(f"action_freq_{w}m_{x}" for w in _WINDOWS for x in ("mean", "max")), "ip_entropy", "unique_ip_count", "device_reuse_score", "max_device_sharing", "session_velocity_mean", "session_velocity_max", "session_count", "enforcement_rate", "total_enforcements", "total_events"]
_COUNTS = {"unique_ip_count", "session_count", "total_enforcements", "total_events"}


def _group(ctes: list[str], table: str, columns: list[str]) -> str:
    return _with("feature_events", *ctes, f"select user_id, {', '.join(c if c in _COUNTS else f'{_r(c, 9)} as {c}' for c in columns)} from {table}")


_ALL = [_ROLLED, _FREQ, *_ENTROPY, *_DEVICE, *_SESSION, *_ENFORCED]
_MATRIX = [*_ALL, "matrix as (select f.user_id, " + ", ".join(f"cast({c} as double) as {c}" for c in _FEATURES) + " from freq f join entropy e on f.user_id = e.user_id join device d on f.user_id = d.user_id join velocity v on f.user_id = v.user_id join enforced x on f.user_id = x.user_id)"]


def _z(limit: float) -> str:
    stats = ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) > 1e-9 then stddev_pop({c}) else 1 end as s_{c}" for c in _FEATURES)
    over = " + ".join(f"case when abs(({c} - m_{c}) / s_{c}) > {limit} then cast(1 as double) else 0 end" for c in _FEATURES)
    return f"stats as (select {stats} from matrix), zs as (select user_id, ({over}) / cast(16 as double) as zscore_share from matrix cross join stats)"


_BLEND = "blended as (select user_id, zscore_share, cast(least(greatest(0.45::double * zscore_share * 100, 0), 100) as float) as risk_score from zs)"

# -- graph -------------------------------------------------------------------

_GRAPH = [
    "signals as (select distinct 'ip' as kind, ip_address as value, user_id from feature_events where ip_address is not null union select distinct 'device', device_id, user_id from feature_events where device_id is not null and device_id <> 'unknown')",
    "pairs as (select a.user_id as src, b.user_id as dst, cast(sum(case when a.kind = 'ip' then 1 else 0 end) as bigint) as shared_ips, cast(sum(case when a.kind = 'device' then 1 else 0 end) as bigint) as shared_devices, count(*) as total_shared from signals a join signals b on a.kind = b.kind and a.value = b.value and a.user_id < b.user_id group by 1, 2)",
    "nodes as (select user_id, count(*) as event_count, count(distinct ip_address) as unique_ips, count(distinct device_id) as unique_devices from feature_events group by 1)",
]
_EDGES = [
    *_GRAPH,
    f"close as (select src, dst, count(*) as n from pairs p join feature_events a on a.user_id = p.src join feature_events b on b.user_id = p.dst and abs({_micro.format('a.ts', 'b.ts')}) <= 86400000000 group by 1, 2)",
    "edges as (select p.*, coalesce(c.n, 0) / (cast(x.event_count as double) * y.event_count) as temporal_overlap from pairs p join nodes x on x.user_id = src join nodes y on y.user_id = dst left join close c on c.src = p.src and c.dst = p.dst)",
    "weighed as (select *, tanh(cast(total_shared as double)) * (0.5::double + 0.5::double * temporal_overlap) as weight from edges)",
]
_MEMBERS = [
    "reach as (select user_id as a, user_id as b from nodes union select r.a, e.b from reach r join (select src as x, dst as b from pairs union all select dst, src from pairs) e on e.x = r.b)",
    "members as (select a as user_id, min(b) as cluster_id from reach group by a)",
]
_SCORED = [
    *_EDGES, *_MEMBERS,
    "p95 as (select case when quantile_cont(cast(event_count as double), 0.95) = 0 then 1 else quantile_cont(cast(event_count as double), 0.95) end as p from nodes)",
    "groups as (select cluster_id, count(*) as size, avg(event_count) as me from members m join nodes n on m.user_id = n.user_id group by 1)",
    "within as (select cluster_id, count(*) as ne, avg(weight) as mw from weighed w join members m on m.user_id = w.src group by 1)",
    "parts as (select g.cluster_id, size, case when size > 1 then cast(2 as double) * coalesce(ne, 0) / (cast(size as double) * (size - 1)) else 0 end as density, coalesce(mw, 0) as mw, least(log2(cast(size as double) + 1) / log2(cast(101 as double)), 1) as ss, least(me / p, 1) as es from groups g left join within w on g.cluster_id = w.cluster_id cross join p95)",
    "scored as (select cluster_id, size, density, mw, 100 * (ss + density + mw + es) / 4 as risk from parts)",
]


def _recursive(*parts: str) -> str:
    return _with("feature_events", *parts).replace("with ", "with recursive ", 1)


_SCORE_COLUMNS = "cluster_id, size, round_even(density, 4) as density, round_even(mw, 4) as mean_edge_weight, round_even(risk, 2) as risk_score"

# -- calibration -------------------------------------------------------------

_CURVE = [
    "per as (select y_score as threshold, sum(y_true) as p, sum(1 - y_true) as n from scored_labels group by 1)",
    "curve as (select threshold, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as np, sum(n) over () as nn from per window w as (order by threshold desc rows between unbounded preceding and current row))",
    "bent as (select *, lag(tp) over o as tp0, lead(tp) over o as tp1, lag(fp) over o as fp0, lead(fp) over o as fp1 from curve window o as (order by threshold desc))",
    "roc as (select threshold, fp / cast(nn as double) as fpr, tp / cast(np as double) as tpr from bent where tp0 is null or tp1 is null or tp1 - 2 * tp + tp0 <> 0 or fp1 - 2 * fp + fp0 <> 0)",
    "best as (select * from roc where fpr <= 0.2 order by tpr desc, threshold desc limit 1)",
    "areas as (select sum((fp - coalesce(fp0, 0)) * cast(tp + coalesce(tp0, 0) as double)) / 2 / max(cast(np as double) * nn) as roc_auc, sum((tp - coalesce(tp0, 0)) / cast(np as double) * (tp / cast(tp + fp as double))) as ap from bent)",
]
_CHECKS = {
    "user_profiles": "account_age_days < 0",
    "aggregated_user_metrics": "action_count < 0 or success_rate < 0 or success_rate > 1",
    "anomaly_scores": "isolation_score < 0 or isolation_score > 1 or combined_risk_score < 0 or combined_risk_score > 1 or model_version is null",
    "enforcement_actions": "resolved_at < triggered_at",
    "abuse_clusters": "cluster_size <= 0 or avg_risk_score < 0 or avg_risk_score > 1",
    "threshold_history": "false_positive_rate < 0 or false_positive_rate > 1 or false_negative_rate < 0 or false_negative_rate > 1",
}
_WIDTHS = {"1min": 60, "5min": 300, "15min": 900, "1hr": 3600, "24hr": 86400}

ORACLE_SQL: dict[str, str] = {
    "q1_burst_defaults": _with("raw_events user_profiles", _dense(20), *_burst("dense", 1)),
    "q2_ip_clusters_defaults": _with("raw_events anomaly_scores", _dense(200), *_clusters("dense", "time_bucket(interval '10 minutes', ts)", "10 minutes")),
    "q4_session_success_defaults": _q4(-2.0),
    "q5_resource_density_defaults": _with("raw_events aggregated_user_metrics user_profiles", _dense(5000), *_density("dense", "time_bucket(interval '2 minutes', ts)", "2 minutes", 10, 3)),
    "q1_burst": _Q1, "q2_ip_clusters": _Q2, "q3_device_reuse": _Q3, "q4_session_success": _Q4, "q5_resource_density": _Q5, "q6_cohort_abuse": _Q6, "q7_weekly_enforcement": _Q7,
    **{f"dash_{k}": v for k, v in _DASH.items()},
    "feat_action_frequency": _group([_ROLLED, _FREQ], "freq", _FEATURES[:6]),
    "feat_ip_entropy": _group(_ENTROPY, "entropy", _FEATURES[6:8]),
    "feat_device_reuse": _group(_DEVICE, "device", _FEATURES[8:10]),
    "feat_session_velocity": _group(_SESSION, "velocity", _FEATURES[10:13]),
    "feat_enforcement_rate": _group(_ENFORCED, "enforced", _FEATURES[13:]),
    "feature_matrix": _with("feature_events", *_MATRIX, f"select user_id, {', '.join(f'{_r(c, 9)} as {c}' for c in _FEATURES)} from matrix"),
    "score_zscore": _with("feature_events", *_MATRIX, _z(1.5), f"select user_id, {_r('zscore_share', 9)} as zscore_share from zs"),
    "score_blend_z_only": _with("feature_events", *_MATRIX, _z(3.0), _BLEND, f"select user_id, {_r('zscore_share', 4)} as zscore_share, {_r('cast(risk_score as double)', 4)} as risk_score from blended"),
    "score_threshold": _with("feature_events", *_MATRIX, _z(3.0), _BLEND, f"select {_r('quantile_cont(cast(risk_score as double), 0.99)', 4)} as quantile, {_r('greatest(quantile_cont(cast(risk_score as double), 0.99), 0)', 4)} as threshold from blended"),
    "scored_events": _with("feature_events", *_MATRIX, _z(3.0), _BLEND, f"select f.user_id, event_id, {_r('coalesce(cast(risk_score as double), 0)', 4)} as risk_score, coalesce(risk_score >= 2, false) as is_anomaly from feature_events f left join blended b on f.user_id = b.user_id"),
    "graph_nodes": _with("feature_events", *_GRAPH, "select * from nodes"),
    "graph_edges": _with("feature_events", *_EDGES, f"select src, dst, shared_ips, shared_devices, total_shared, {_r('temporal_overlap', 9)} as temporal_overlap, {_r('weight', 9)} as weight from weighed"),
    "graph_components": _recursive(*_GRAPH, *_MEMBERS, "select user_id, cluster_id from members"),
    "graph_signal_components": _recursive(*_GRAPH, *_MEMBERS, "select user_id, cluster_id from members"),
    "graph_cluster_scores": _recursive(*_SCORED, f"select {_SCORE_COLUMNS} from scored"),
    "graph_escalated": _recursive(*_SCORED, f"select {_SCORE_COLUMNS}, true as escalated from scored where round_even(risk, 2) >= 40"),
    "cal_rates_at_threshold": _with("scored_labels", "select cast(50 as double) as threshold, sum(case when y_score >= 50 and y_true = 0 then 1 else 0 end) / cast(sum(1 - y_true) as double) as fpr, sum(case when y_score < 50 and y_true = 1 then 1 else 0 end) / cast(sum(y_true) as double) as fnr from scored_labels"),
    "cal_roc": _with("scored_labels", *_CURVE, "select threshold, fpr, tpr from roc union all select cast('infinity' as double), 0, 0"),
    "cal_pr": _with("scored_labels", *_CURVE, "select threshold, tp / cast(tp + fp as double) as precision, tp / cast(np as double) as recall from curve union all select null, 1, 0"),
    "cal_auc_ap": _with("scored_labels", *_CURVE, f"select {_r('roc_auc', 9)} as roc_auc, {_r('ap', 9)} as average_precision from areas"),
    "cal_optimal_threshold": _with("scored_labels", *_CURVE, "select threshold, fpr, tpr from best"),
    "cal_auto_adjust": _with("threshold_history", "select threshold_id, metric_name, threshold_value as \"current\", false_positive_rate as observed, 0.02::double as target, greatest(0::double, least(100::double, threshold_value + greatest(-5::double, least(5::double, (false_positive_rate - 0.02::double) / 0.02::double * 2::double)))) as adjusted from threshold_history"),
    "cal_report": _with("scored_labels", *_CURVE, "select round(threshold, 6) as optimal_threshold, cast(0.2 as double) as max_fpr_constraint, round(fpr, 6) as fpr, round(tpr, 6) as tpr, round(1 - tpr, 6) as fnr, round(roc_auc, 6) as roc_auc, round(ap, 6) as average_precision, '1.0.0' as model_version from best cross join areas"),
    "dash_alert_rules": _with(_RULE_TABLES, *_RULES, "select * from evaluated"),
    "dash_alert_messages": _with(_RULE_TABLES, *_RULES, " union all ".join(map(_message, RULES))),
    "alert_fold": _with("anomaly_scores",
        """candidates as (select *, row_number() over (order by tt, entity, details) as i from (
            select 'user_high_risk' as alert_type, cast(user_id as varchar) as entity, cast(epoch(computed_at) as double) as tt,
                   '{"user_id":' || user_id || ',"risk_score":' || cast(combined_risk_score * 100 as varchar) || ',"threshold":70.0}' as details from anomaly_scores where combined_risk_score * 100 >= 70) c)""",
        """folded(i, outcome, sent) as (
            select 0::bigint, '', []::struct(k varchar, t double)[]
            union all
            select i, outcome, case when outcome = 'sent' then list_append(kept, {'k': entity, 't': tt}) else kept end from (
                select c.i, c.entity, c.tt, list_filter(f.sent, lambda x: c.tt - x.t < 2592000) as kept,
                       case when len(list_filter(f.sent, lambda x: x.k = c.entity and c.tt - x.t < 2592000)) > 0 then 'deduplicated' when len(list_filter(f.sent, lambda x: c.tt - x.t < 60)) >= 5 then 'rate_limited' else 'sent' end as outcome
                from folded f join candidates c on c.i = f.i + 1) step)""",
        "select alert_type, entity, tt as at, details, outcome from folded join candidates using (i)").replace("with ", "with recursive ", 1),
    "alert_candidates_user": _with("latest_scores", "select 'user_high_risk' as alert_type, cast(user_id as varchar) as entity, cast(0 as double) as at from latest_scores where combined_risk_score * 100 >= 70"),
    "alert_candidates_cluster": _with("abuse_clusters", "select 'cluster_high_risk' as alert_type, cast(cluster_id as varchar) as entity, cast(0 as double) as at from abuse_clusters where case when avg_risk_score <= 1 then avg_risk_score * 100 else avg_risk_score end >= 70"),
    "alert_spike": _with("enforcement_actions",
        "counts as (select date_trunc('month', triggered_at) as period, count(*) as n from enforcement_actions group by 1)",
        "s as (select avg(cast(n as double)) as m, stddev_samp(cast(n as double)) as sd from counts where period < (select max(period) from counts))",
        "select period, n as enforcement_count, round(m, 2) as rolling_mean, round(sd, 2) as rolling_std, round((n - m) / sd, 4) as z_score, (n - m) / sd > 3 as is_spike from counts cross join s where period = (select max(period) from counts)"),
    "src_validate": _with(" ".join(_CHECKS), " union all ".join(f"select '{t}' as table_name, count(*) as violations from {t} where {c}" for t, c in _CHECKS.items())),
    "src_dedup_events": _with("feature_events", "select event_id, user_id, timestamp, action, ip_address, device_id, enforced from (select *, date_trunc('day', ts) as timestamp, row_number() over (partition by user_id, date_trunc('day', ts), action order by event_id) as rn from feature_events) e where rn = 1"),
    "src_weekly_spine": _with("enforcement_actions", "counted as (select date_trunc('week', triggered_at) as w, count(*) as n from enforcement_actions where triggered_at is not null group by 1)",
        "spine as (select unnest(generate_series((select min(w) from counted), (select max(w) from counted), interval '7 days')) as week_start)",
        "select cast(week_start as timestamp) as week_start, coalesce(n, 0) as events from spine left join counted on w = week_start"),
    "ext_aum_daily": _with("aggregated_user_metrics", "select *, window_start + interval '1' day as window_end from aggregated_user_metrics"),
    "ext_window_activity": _with("raw_events", "counted as (" + " union all ".join(f"select user_id, '{k}' as window_type, make_timestamp((epoch_us(ts) // {s * 1_000_000}) * {s * 1_000_000}) as window_start, count(*) as action_count from raw_events group by 1, 2, 3" for k, s in _WIDTHS.items()) + ")",
        "select user_id, window_type, window_start, action_count, cast(action_count as double) / max(action_count) over (partition by window_type) as burst_score from counted"),
    "ext_stream_alerts": """with recursive candidates as (
            select event_type as alert_type, cast(user_id as varchar) as entity, epoch_us(ts) / 1e6::double as tt from events
        ), firsts(alert_type, entity, tt) as (
            select alert_type, entity, min(tt) from candidates group by 1, 2
            union all
            select f.alert_type, f.entity, min(c.tt) from firsts f join candidates c on c.alert_type = f.alert_type and c.entity = f.entity and c.tt - f.tt >= 86400 group by f.alert_type, f.entity, f.tt
        ) select c.alert_type, c.entity, c.tt as at, case when f.tt is not null and c.n = 1 then 'sent' else 'deduplicated' end as outcome
        from (select *, row_number() over (partition by alert_type, entity, tt) as n from candidates) c left join firsts f on f.alert_type = c.alert_type and f.entity = c.entity and f.tt = c.tt""",
    "ext_stream_windows": "select user_id, date_trunc('day', ts) as window_start, count(*) as action_count from events group by 1, 2",
}
