import datetime as dt
import json

from riskloom import registry, schemas
from riskloom.plans import dashboards, metadata
from riskloom.plans import investigations as q
from riskloom.sources.fixtures import Tables

EVENTS = "event_id long, user_id long, ts timestamp_ntz, session_id string, ip_address string, device_id string, action_type string, resource_id string, success_flag boolean, enforcement_action string"
T0 = dt.datetime(2024, 1, 1)


def event(i, user, minutes, ip="ip", device="dev", ok=True):
    return (i, user, T0 + dt.timedelta(minutes=minutes), "s", ip, device, "view", f"r{i}", ok, None)


def test_burst_window_is_closed_and_has_peers(spark):
    df = spark.createDataFrame([event(i, 1, m) for i, m in enumerate((0, 5, 5, 11, 400))], EVENTS)
    people = spark.createDataFrame([(1, "X", 5, False)], "user_id long, country string, account_age_days int, is_flagged boolean")
    got = {(r.burst_peak_ts - T0).total_seconds() / 60: r.events_in_5min_window for r in q.q1_burst(df, people).collect()}
    assert got == {0: 1, 5: 3, 11: 1, 400: 1}


def test_device_switches_count_only_accounts_left(spark):
    df = spark.createDataFrame([event(0, 1, 0), event(1, 2, 10), event(2, 1, 45), event(3, 2, 75), event(4, 1, 200)], EVENTS)
    row = q.q3_device_reuse(df, min_accounts=1).first()
    assert (row.accounts_seen, row.total_switches, row.involved_accounts) == (1, 2, "1") or (row.accounts_seen, row.total_switches) == (1, 2)


def test_generic_devices_are_left_out(spark):
    df = spark.createDataFrame([event(0, 1, 0, device="unknown"), event(1, 2, 1, device="unknown"), event(2, 1, 2, device="unknown")], EVENTS)
    assert q.q3_device_reuse(df, min_accounts=1).count() == 0


def test_default_parameters_run_on_the_fixture(spark, data):
    t = Tables(spark, data)
    assert q.q1_burst(t.raw_events, t.user_profiles).count() == 1000
    assert q.q2_ip_clusters(t.raw_events, t.anomaly_scores).count() == 0
    assert q.q4_session_success(t.raw_events, t.aggregated_user_metrics, t.user_profiles).count() == 0
    assert q.q5_resource_density(t.raw_events, t.aggregated_user_metrics, t.user_profiles).count() == 0
    assert q.q2_ip_clusters(t.raw_events, t.anomaly_scores, width="1 day", mode="mean_latest", min_risk=0.0).count() > 0


def test_an_empty_week_is_one_row(spark):
    actions = spark.createDataFrame([(1, 1, "ban", T0)], "action_id long, user_id long, action_type string, triggered_at timestamp_ntz")
    people = spark.createDataFrame([(1, "X", 5, False)], "user_id long, country string, account_age_days int, is_flagged boolean")
    got = q.q7_weekly_enforcement(actions, people, q.Lookback(T0, T0 + dt.timedelta(days=7)), T0 + dt.timedelta(days=8)).orderBy("week_start").collect()
    assert [(r.account_cohort, r.action_type, r.enforcement_count, r.is_complete_week) for r in got] == [("new", "ban", 1, True), ("all", "all", 0, False)]


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = registry.QUERIES["q3_device_reuse"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,props:string>" in plan


def test_metadata(tmp_path):
    assert len(metadata.EXECUTIVE) == 8 and len(metadata.ANALYST) == 10 and len(metadata.CHARTS) == 18 and len(metadata.RULES) == 8
    ids = {m.metric_id for m in metadata.EXECUTIVE + metadata.ANALYST}
    assert ids == set(dashboards.EXTRACTS) == {c.metric_id for c in metadata.CHARTS} and {r.metric_id for r in metadata.RULES} <= ids
    metadata.export(tmp_path / "a" / "spec.json", T0)
    spec = json.loads((tmp_path / "a" / "spec.json").read_text())
    assert spec["generated_at"] == "2024-01-01T00:00:00Z" and len(spec["alert_rules"]) == 8


def test_rules_fire(spark, data):
    got = {r.rule_id: r for r in metadata.evaluate_rules(Tables(spark, data), dt.datetime(2024, 1, 31)).collect()}
    assert len(got) == 8 and got["exec_high_risk_rate"].fires and not got["analyst_burst_heatmap_saturation"].fires


def test_constraints(spark):
    rows = spark.createDataFrame([("a", -1), ("b", 0), ("c", None)], "user_id string, account_age_days int")
    assert [(r.user_id, r.violated) for r in schemas.violations("user_profiles", rows).collect()] == [("a", ["account_age_days"])]
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "user_id string")
    assert [(r.user_id, r.n) for r in schemas.duplicate_keys("user_profiles", twice).collect()] == [("a", 2)]
    assert len(schemas.SCHEMAS) == 8


def test_messages_of_rules_that_fire(spark, data):
    t, at = Tables(spark, data), dt.datetime(2024, 1, 31)
    fired = {r.rule_id: r.value for r in metadata.evaluate_rules(t, at).collect() if r.fires}
    rules = {r.rule_id: r for r in metadata.RULES}
    got = {(r.rule_id, r.channel): r.message for r in metadata.alert_messages(t, at).collect()}
    assert got == {(i, c): rules[i].message_template.format(value=v) for i, v in fired.items() for c in rules[i].channels}
    low = metadata.Rule("any", "total_flagged_users", "gt", -1.0, "warning", 60, "{value:.1f}% of 100%", ("a", "b"), "total_flagged_users")
    assert {r.message[-8:] for r in metadata.alert_messages(t, at, [low]).collect()} == {" of 100%"}
