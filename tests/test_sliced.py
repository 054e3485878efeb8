import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import sliced

MINUTE = 60_000_000


@pytest.fixture
def events(spark):
    """One user with half of the rows, ties, gaps of exactly the limit, null keys and times."""
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([0, 0, 30, 60, 60, 300, 1800, 1801, 9000]) * 1_000_000
        rows.append((0 if i % 2 else rng.choice([1, 2, 3, None]), t if rng.random() < 0.97 else None, rng.choice(["a", None]), i))
    rows += [(0, -5 * MINUTE, "a", 1000), (0, -1, "a", 1001), (0, 0, "a", 1002)]
    return spark.createDataFrame(rows, "user_id int, t long, action string, event_id int").repartition(4)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("length", [5 * MINUTE, 7 * MINUTE, 60 * MINUTE, 10_000 * MINUTE])
def test_trailing_counts_are_those_of_a_window(events, length):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-5 * MINUTE, 0)
    want = events.select("event_id", F.count("action").over(w).alias("n"), F.count(F.lit(1)).over(w).alias("m"))
    got = sliced.trailing(sliced.cut(events, F.col("t"), length, 5 * MINUTE), "user_id", n=(F.col("action"), 5 * MINUTE), m=(F.lit(1), 5 * MINUTE))
    assert same(got.select("event_id", "n", "m"), want)


def test_a_window_longer_than_slices(events):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-50 * MINUTE, 0)
    got = sliced.trailing(sliced.cut(events, F.col("t"), 7 * MINUTE, 50 * MINUTE), "user_id", n=(F.lit(1), 50 * MINUTE))
    assert same(got.select("event_id", "n"), events.select("event_id", F.count(F.lit(1)).over(w).alias("n")))


@pytest.mark.parametrize("length", [MINUTE, 60 * MINUTE, 10_000 * MINUTE])
def test_rows_before_are_those_of_lag(events, length):
    known = events.where("user_id is not null")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    want = known.select("event_id", F.lag("event_id").over(w).alias("previous"), F.lag("action").over(w).alias("done"))
    got = sliced.before(sliced.cut(known, F.col("t"), length), "user_id", ["t", "event_id"], previous="event_id", done="action")
    assert same(got.select("event_id", "previous", "done"), want)


@pytest.mark.parametrize("length", [MINUTE, 45 * MINUTE, 10_000 * MINUTE])
def test_sessions_are_those_of_a_walk(events, length):
    gap, want = 30 * MINUTE, []
    rows = events.collect()
    for user in {r.user_id for r in rows}:
        last = None
        for r in sorted((r for r in rows if r.user_id == user and r.t is not None), key=lambda r: r.t):
            if last is None or r.t - last[2] > gap:
                last = [user, r.t, r.t, 0]
                want.append(last)
            last[2], last[3] = r.t, last[3] + (r.action is not None)
    got = sliced.sessions(sliced.cut(events, F.col("t"), length), "user_id", gap, F.col("action")).collect()
    assert sorted(map(str, ([r.user_id, r._start, r._end, r._n] for r in got))) == sorted(map(str, want))


def test_a_hot_key_is_the_work_of_many_groups(spark):
    one = spark.range(20_000).select(F.lit(1).alias("user_id"), (F.col("id") * 10_000_000).alias("t"))
    groups = [r["count"] for r in sliced.cut(one, F.col("t"), 8 * 60 * MINUTE, 60 * MINUTE).groupBy("user_id", "_slice").count().collect()]
    assert len(groups) > 6 and max(groups) < 20_000 / 5 and sum(groups) < 20_000 * 1.2


def test_empty(spark):
    none = spark.createDataFrame([], "user_id int, t long, action string, event_id int")
    part = sliced.cut(none, F.col("t"), MINUTE, MINUTE)
    assert sliced.trailing(part, "user_id", n=(F.lit(1), MINUTE)).count() == 0
    assert sliced.before(sliced.cut(none, F.col("t"), MINUTE), "user_id", ["t"], p="t").count() == 0
    assert sliced.sessions(sliced.cut(none, F.col("t"), MINUTE), "user_id", MINUTE, F.col("action")).count() == 0
