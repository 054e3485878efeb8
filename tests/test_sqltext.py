import datetime as dt
import json

import pytest

from riskloom import registry
from riskloom.plans import dashboards, metadata, sqltext
from riskloom.plans import investigations as q
from riskloom.sources.fixtures import Tables


@pytest.fixture(scope="module")
def tables(spark, data):
    t = Tables(spark, data)
    sqltext.views(t)
    return t


def rows(df, columns):
    plain = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)


WIDER = {
    "burst_activity_heatmap": {"window_type": "1hr", "hours": 24 * 31},
    "ip_multi_account_signals": {"width": "1 day", "hours": 24 * 7},
    "device_reuse_signals": {"hours": 24 * 31},
    "session_success_rate_anomalies": {"hours": 24 * 31, "baseline_days": 31, "min_events": 2, "below": 9.0},
    "active_abuse_clusters": {"days": 3000},
    "cluster_risk_leaderboard": {"days": 3000, "top": 9},
    "enforcement_actions_24h": {"hours": 24 * 300},
    "enforcement_action_breakdown": {"hours": 24 * 300},
    "top_risk_users_live": {"top": 7},
}
ON_EVENTS = {"active_abuse_clusters", "burst_activity_heatmap", "cluster_risk_leaderboard", "ip_multi_account_signals", "device_reuse_signals", "session_success_rate_anomalies"}


@pytest.mark.parametrize("name", sorted(dashboards.EXTRACTS))
def test_text_and_plan_give_the_same_rows(spark, tables, name):
    as_of = registry.NOW_EVENTS if name in ON_EVENTS else registry.NOW_ORDERS
    plan = dashboards.EXTRACTS[name](tables, as_of, **WIDER.get(name, {}))
    text = sqltext.run(spark, name, as_of, **WIDER.get(name, {}))
    assert text.columns == plan.columns
    got = rows(text, plan.columns)
    assert got == rows(plan, plan.columns) and got


CASES = {
    "q1_burst": (registry.EVENTS, {"min_window_count": 2}),
    "q2_ip_clusters": (registry.EVENTS, {"width": "1 day"}),
    "q3_device_reuse": (registry.EVENTS, {}),
    "q4_session_success": (registry.EVENTS, {"below": 9.0, "min_events": 2}),
    "q5_resource_density": (registry.EVENTS, {"width": "1 day", "min_resources": 5, "factor": 2.0}),
    "q6_cohort_abuse": (registry.ORDERS, {}),
    "q7_weekly_enforcement": (registry.ORDERS, {}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_investigations_give_the_rows_of_their_plans(spark, tables, name):
    import inspect

    when, given = CASES[name]
    plan = getattr(q, name)
    frames = {"events": "raw_events", "profiles": "user_profiles", "scores": "anomaly_scores", "metrics": "aggregated_user_metrics", "actions": "enforcement_actions"}
    own = {p: getattr(tables, frames[p]) for p in inspect.signature(plan).parameters if p in frames}
    at = {"as_of": registry.NOW_ORDERS} if "as_of" in inspect.signature(plan).parameters else {}
    want = plan(**own, when=when, **at, **given)
    got = sqltext.investigate(spark, name, when, **at, **given)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, want.columns) == rows(want, want.columns) and not got.isEmpty()


def test_defaults_are_those_of_the_plans():
    import inspect

    for name, plan in dashboards.EXTRACTS.items():
        own = {k: p.default for k, p in inspect.signature(plan).parameters.items() if p.default is not inspect.Parameter.empty}
        assert sqltext.DEFAULTS.get(name, {}) == own, name


def test_markers_are_bound_not_pasted(spark, tables):
    assert sqltext.run(spark, "burst_activity_heatmap", registry.NOW_EVENTS, window_type="1hr' or '1' = '1", hours=744).isEmpty()
    with pytest.raises(ValueError):
        sqltext.run(spark, "total_flagged_users", registry.NOW_EVENTS, days=3)


def test_export_carries_the_texts(tmp_path):
    metadata.export(tmp_path / "spec.json", dt.datetime(2024, 1, 1))
    extracts = json.loads((tmp_path / "spec.json").read_text())["extracts"]
    assert set(extracts) == set(dashboards.EXTRACTS) and all(x["sql"] == sqltext.SQL[n] and f":{p}" in x["sql"] for n, x in extracts.items() for p in x["parameters"] if p != "as_of")
