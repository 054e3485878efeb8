import contextlib
import datetime as dt
import io
import random

import pytest

from riskloom.config import ClusterParams
from riskloom.operators import graph
from riskloom.sources.synthetic import Model, Ring, ring_events

SCHEMA = "user_id string, ip_address string, device_id string, timestamp timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def micro():
    ips = {"A": "1", "B": "1", "C": "2", "D": "2", "E": "3"}
    return [(u, ip, f"d{u}", T0 + dt.timedelta(minutes=10 * i)) for u, ip in ips.items() for i in range(5)]


def test_micro_graph(spark):
    events = spark.createDataFrame(micro(), SCHEMA)
    nodes, edges = graph.nodes(events), graph.edges(events)
    assert nodes.count() == 5
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("A", "B"), ("C", "D")]
    members = graph.components(nodes, edges)
    assert {r.user_id: r.cluster_id for r in members.collect()} == {"A": "A", "B": "A", "C": "C", "D": "C", "E": "E"}
    scores = graph.with_members(graph.cluster_scores(nodes, edges, members), members).toPandas().set_index("cluster_id")
    assert scores["risk_score"].between(0, 100).all()
    assert (scores.loc["A", "density"], scores.loc["E", "density"]) == (1, 0)
    assert list(scores.loc["C", "members"]) == ["C", "D"]
    assert {r.cluster_id for r in graph.escalate(graph.cluster_scores(nodes, edges, members)).collect()} == {"A", "C"}


def test_overlap_is_the_share_of_event_pairs(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(6)}", "x", "d", T0 + dt.timedelta(hours=rng.randrange(100))) for _ in range(120)]
    events = spark.createDataFrame(rows, SCHEMA)
    times = {}
    for u, _, _, t in rows:
        times.setdefault(u, []).append(t)
    got = graph.edges(events, ClusterParams(temporal_window_hours=5)).collect()
    assert len(got) == 15
    for r in got:
        near = sum(abs((a - b).total_seconds()) <= 5 * 3600 for a in times[r.src] for b in times[r.dst])
        assert r.temporal_overlap == pytest.approx(near / len(times[r.src]) / len(times[r.dst]))


def test_components_of_random_graphs_and_a_chain(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = [(min(a, b), max(a, b)) for a, b in links if a != b]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(1100).toDF("user_id")
    got = {r.user_id: r.cluster_id for r in graph.components(nodes, spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: top(x) for x in range(1100)}


def test_rings_are_found(spark):
    events = ring_events(spark)
    members = graph.signal_components(events).toPandas().groupby("cluster_id")["user_id"].apply(list)
    sizes = sorted((len(x) for x in members), reverse=True)
    assert sizes[:4] == [12, 7, 3, 1] and len(sizes) == 43
    edges = graph.edges(events)
    by_pairs = graph.components(graph.nodes(events), edges).toPandas().groupby("cluster_id")["user_id"].apply(list)
    assert sorted(map(sorted, members)) == sorted(map(sorted, by_pairs))


def test_excluded_signals_and_minimum(spark):
    rows = [("A", "1", "unknown", T0), ("B", "2", "unknown", T0), ("C", "2", "d", T0), ("D", None, None, T0)]
    events = spark.createDataFrame(rows, SCHEMA)
    assert graph.shared_signals(events).count() == 2
    assert [(r.src, r.dst) for r in graph.shared_signals(events, ClusterParams(exclude_signals=("unknown",))).collect()] == [("B", "C")]
    assert graph.shared_signals(events, ClusterParams(min_shared_signals=2)).count() == 0
    with pytest.raises(ValueError):
        graph.signal_components(events, ClusterParams(min_shared_signals=2))


def test_no_events(spark):
    events = spark.createDataFrame([], SCHEMA)
    nodes, edges = graph.nodes(events), graph.edges(events)
    assert graph.cluster_scores(nodes, edges, graph.components(nodes, edges)).count() == 0


def test_synthetic_events(spark):
    model = Model(singles=5, rings=(Ring("r", 4, 2, 1, 2.0),), events=10)
    rows = ring_events(spark, model).collect()
    assert sorted(map(str, rows)) == sorted(map(str, ring_events(spark, model).repartition(3).collect()))
    assert len({r.event_id for r in rows}) == len(rows) and len({r.user_id for r in rows}) == 9
    ring = [r for r in rows if r.user_id.startswith("r-")]
    assert max(r.timestamp for r in ring) - min(r.timestamp for r in ring) <= dt.timedelta(hours=2)
    assert len({r.ip_address for r in ring}) == 2 and len({r.device_id for r in ring}) == 1
    assert not {r.ip_address for r in ring} & {r.ip_address for r in rows if r not in ring}


def plain_modularity(edges, label):
    total, inside, degree = 0.0, {}, {}
    for a, b, w in edges:
        total += 2 * w
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0.0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0.0) + 2 * w
    return sum(inside.get(c, 0.0) / total - (k / total) ** 2 for c, k in degree.items())


def test_louvain_parts_cliques_that_a_bridge_links(spark):
    cliques = [list(range(10 * c, 10 * c + n)) for c, n in enumerate((6, 5, 7, 4))]
    edges = [(a, b, 1.0) for x in cliques for a in x for b in x if a < b] + [(cliques[i][-1], cliques[(i + 1) % 4][0], 0.5) for i in range(4)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(x,) for c in cliques for x in c] + [(99,)], "user_id long")
    got = {r.user_id: r.cluster_id for r in graph.communities(nodes, df, "louvain").collect()}
    want = {x: c[0] for c in cliques for x in c}
    assert plain_modularity(edges, got) >= plain_modularity(edges, want) - 1e-9 and got == want | {99: 99}
    assert {r.cluster_id for r in graph.communities(nodes, df).collect()} == {0, 99}
    with pytest.raises(ValueError):
        graph.communities(nodes, df, "other")
    assert graph.communities(nodes, df.where("false"), "louvain").where("user_id <> cluster_id").count() == 0


def estimates(df):
    """The plan of ``df`` with the sizes that the planner takes it to have."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("cost")
    assert "sizeInBytes" in out.getvalue()
    return out.getvalue()


def test_estimated_sizes_do_not_grow_round_by_round(spark):
    """Joins multiply estimates, so those of labels made of earlier labels must not be carried on: sizes beyond 2 ** 63 are printed with an exponent."""
    chain = spark.range(60).selectExpr("id as src", "id + 1 as dst", "1.0D as weight")
    nodes = spark.range(61).toDF("user_id")
    for method in ("components", "louvain"):
        got = graph.communities(nodes, chain, method)
        assert "E+" not in estimates(got), method
        assert got.count() == 61


def test_louvain_without_weights_moves_nobody(spark):
    df = spark.createDataFrame([(1, 2, 0.0), (2, 3, None)], "src long, dst long, weight double")
    got = graph.communities(spark.createDataFrame([(1,), (2,), (3,)], "user_id long"), df, "louvain").collect()
    assert sorted((r.user_id, r.cluster_id) for r in got) == [(1, 1), (2, 2), (3, 3)]
