import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from riskloom.config import ClusterParams
from riskloom.operators import graph, pairs

T0 = dt.datetime(2024, 1, 1)


def plain(rows, least):
    held = {}
    for kind, value, user in rows:
        held.setdefault(user, set()).add((kind, value))
    out = {}
    for a, b in combinations(sorted(held), 2):
        both = held[a] & held[b]
        if len(both) >= least:
            out[a, b] = (sum(k == "ip" for k, _ in both), sum(k == "device" for k, _ in both))
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("heavy", [0, 4, 12, 1000])
def test_same_as_all_pairs(spark, least, heavy):
    rng = random.Random(least * 100 + heavy)
    rows = {(rng.choice(["ip", "device"]), f"v{min(rng.randrange(40), rng.randrange(40))}", rng.randrange(45)) for _ in range(260)}
    rows |= {("ip", f"hot{i}", u) for i in range(3) for u in range(0, 45, i + 1)}
    got = pairs.shared(spark.createDataFrame(sorted(rows), "kind string, value string, user_id int").repartition(3), least, heavy).collect()
    assert {(r.src, r.dst): (r.ip, r.device) for r in got} == plain(rows, least) and len(got) == len(plain(rows, least))


def test_a_signal_of_all_users_makes_no_pairs_alone(spark):
    """Two of 30,000 users share a second signal: one edge, where the signal alone has 450 million pairs."""
    users = spark.range(30_000).select(F.lit("ip").alias("kind"), F.lit("nat").alias("value"), F.col("id").alias("user_id"))
    other = spark.createDataFrame([("device", "d", 7), ("device", "d", 19_999)], "kind string, value string, user_id long")
    assert [tuple(r) for r in pairs.shared(users.unionByName(other), 2, 1000).collect()] == [(7, 19_999, 1, 1)]


def test_large_classes_are_expanded_in_blocks(spark):
    users = spark.range(900).select(F.lit("ip").alias("kind"), F.lit("nat").alias("value"), F.col("id").alias("user_id"))
    got = pairs.shared(users, 1, 100)
    assert got.count() == 900 * 899 // 2 == got.select("src", "dst").distinct().count()
    assert got.where("src >= dst or ip <> 1 or device <> 0").isEmpty()


@pytest.mark.parametrize(("hours", "chunk"), [(0.5, 4096), (3, 5), (24, 2)])
def test_overlap_at_the_edges_of_bins(spark, monkeypatch, hours, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(chunk)
    step = int(hours * 1800)
    rows = [(rng.randrange(4), "x", "d", T0 + dt.timedelta(seconds=rng.randrange(-9, 9) * step, microseconds=rng.choice([0, 0, 1, -1]))) for _ in range(150)] + [(9, "x", "d", None)]
    times = {}
    for u, _, _, t in rows:
        times.setdefault(u, []).extend([] if t is None else [t])
    events = spark.createDataFrame(rows, "user_id int, ip_address string, device_id string, timestamp timestamp_ntz")
    got = {(r.src, r.dst): r.temporal_overlap for r in graph.edges(events, ClusterParams(temporal_window_hours=hours)).collect()}
    assert len(got) == 10
    for (a, b), share in got.items():
        near = sum(abs(x - y) <= dt.timedelta(hours=hours) for x in times[a] for y in times[b])
        assert share == pytest.approx(near / (len(times[a]) * len(times[b]) or 1))


def test_edges_do_not_depend_on_what_is_heavy(spark, data):
    from riskloom.registry import CLUSTERS
    from riskloom.sources import events as ev
    from riskloom.sources.fixtures import Tables

    view = ev.feature_view(Tables(spark, data).raw_events)
    a, b = (graph.shared_signals(view, CLUSTERS, heavy).collect() for heavy in (2, 10**9))
    assert sorted(a) == sorted(b) and a
