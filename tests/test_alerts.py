import json
import random

import pytest

from riskloom.config import AlertParams
from riskloom.operators import alerts
from riskloom.sources.sinks import IncidentLog, Webhook

P = AlertParams(rate_limit_per_minute=5, dedup_window_seconds=300)


def test_thresholds(spark):
    scores = spark.createDataFrame([("a", 69.9), ("b", 70.0)], "user_id string, risk_score double")
    assert [r.entity for r in alerts.user_candidates(scores).collect()] == ["b"]
    clusters = spark.createDataFrame([(0, 0.7), (1, 0.69), (2, 71.0), (3, 1.0)], "cluster_id long, cluster_score double")
    assert sorted(r.entity for r in alerts.cluster_candidates(clusters).collect()) == ["0", "2", "3"]


def test_dedup_and_metrics():
    sent = []
    d = alerts.Dispatcher(lambda x: sent.append(x) or True, P)
    assert [d("user_high_risk", {"user_id": "u"}, t) for t in (0, 299, 300, 301)] == ["sent", "deduplicated", "sent", "deduplicated"]
    assert d.metrics == {"sent": 2, "deduplicated": 2, "failed": 0} and len(sent) == 2


def test_rate_limit():
    d = alerts.Dispatcher(lambda _: True, P)
    assert [d("t", {"user_id": i}, i) for i in range(7)].count("rate_limited") == 2
    assert d("t", {"user_id": 6}, 60.0) == "sent"  # the first place is free again
    assert d.metrics["failed"] == 2


def test_failures_use_a_place_but_do_not_mark():
    d = alerts.Dispatcher(lambda _: False, P)
    assert [d("t", {"user_id": 1}, t) for t in range(6)] == ["failed"] * 5 + ["rate_limited"]


def test_entity_keeps_zero():
    assert alerts.entity_of({"cluster_id": 0}) == "0" and alerts.entity_of({}) == "global"


def test_spike(spark):
    schema = "period int, enforcement_count int"
    rows = [(i, 10 + i % 2) for i in range(20)]
    assert alerts.spike(spark.createDataFrame([*rows, (99, 60)], schema)).first().is_spike
    assert not alerts.spike(spark.createDataFrame([*rows, (99, 11)], schema)).first().is_spike
    assert not alerts.spike(spark.createDataFrame([(1, 5), (2, 50)], schema)).first().is_spike
    assert alerts.spike_candidates(spark.createDataFrame([*rows, (99, 60)], schema)).first().entity == "99"
    with pytest.raises(ValueError):
        alerts.spike(spark.createDataFrame([(1, 5)], schema))
    with pytest.raises(ValueError):
        alerts.spike(spark.createDataFrame([(1,)], "enforcement int"))


def test_fold_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [("t", f"u{rng.randrange(8)}", float(rng.randrange(2000)), "{}") for _ in range(200)]
    got = alerts.fold(spark.createDataFrame(rows, alerts.CANDIDATE).repartition(4), P).collect()
    d = alerts.Dispatcher(lambda _: True, P)
    want = [(*r, d(r[0], json.loads(r[3]), r[2], r[1])) for r in sorted(rows, key=lambda r: (r[2], r[0], r[1]))]
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize(("per_segment", "limit", "window"), [(10_000, 3, 300.0), (12, 2, 45.0), (7, 5, 1e9)])
def test_segments_of_any_length_give_the_same(spark, per_segment, limit, window):
    rng = random.Random(per_segment)
    rows = [(rng.choice("ab"), f"u{rng.randrange(6)}", rng.choice([float(rng.randrange(900)), 100.0, 101.0]), json.dumps(i % 3)) for i in range(45)]
    p = AlertParams(rate_limit_per_minute=limit, dedup_window_seconds=window)
    got = alerts.fold(spark.createDataFrame(rows, alerts.CANDIDATE).repartition(3), p, per_segment).collect()
    d = alerts.Dispatcher(lambda _: True, p)
    want = [(*r, d(r[0], {}, r[2], r[1])) for r in sorted(rows, key=lambda r: (r[2], r[0], r[1], r[3]))]
    assert [tuple(r) for r in got] == want and len({r.outcome for r in got}) >= 2


def test_nothing_to_fold(spark):
    assert alerts.fold(spark.createDataFrame([], alerts.CANDIDATE), P).count() == 0


def test_webhook_retries_with_growing_pauses():
    answers, pauses = [500, OSError("down"), 200], []

    def post(url, body, timeout):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert Webhook("http://x", 3, 5.0, post=post, sleep=pauses.append)({"a": 1})
    assert pauses == [5, 10]
    assert not Webhook("http://x", 2, 1.0, post=lambda *_: 500, sleep=pauses.append)({})


def test_incident_log(tmp_path):
    log = IncidentLog(str(tmp_path / "incidents.jsonl"))
    d = alerts.Dispatcher(lambda _: True, P, log)
    d("t", {"user_id": 1}, 0.0)
    d("t", {"user_id": 1}, 1.0)
    lines = (tmp_path / "incidents.jsonl").read_text().splitlines()
    assert [json.loads(x) for x in lines] == [{"timestamp": "1970-01-01T00:00:00Z", "alert_type": "t", "details": {"user_id": 1}}]
