import datetime as dt
import random

from riskloom.config import AlertParams
from riskloom.operators.alerts import Dispatcher
from riskloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long"


def files(spark, path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m), u) for e, m, u in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    return jobs.read(spark, f"{path}/*", SCHEMA)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    stream = files(spark, tmp_path, [(1, 0, 1), (2, 30, 1), (3, 61, 2)], [(4, 600, 1)])
    got = jobs.run_to_end(jobs.window_counts(stream, "1 hour", late="1 hour")).collect()
    assert sorted((r.user_id, r.action_count) for r in got) == [(1, 2), (2, 1)]


def test_duplicates(spark, tmp_path):
    stream = files(spark, tmp_path, [(1, 0, 1), (1, 1, 1), (2, 2, 1)])
    assert jobs.run_to_end(jobs.without_duplicates(stream)).count() == 2


def test_bursts_and_sessions(spark, tmp_path):
    stream = files(spark, tmp_path, [(1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 50, 1)], [(5, 600, 2)])
    assert max(r.action_count for r in jobs.run_to_end(jobs.bursts(stream, at_least=2)).collect()) == 3
    assert sorted(r.n_events for r in jobs.run_to_end(jobs.session_counts(stream)).collect()) == [1, 3]


def test_alert_state_and_sink(spark, tmp_path):
    from pyspark.sql import functions as F

    stream = files(spark, tmp_path, [(1, 0, 1), (2, 1, 1), (3, 6, 1), (4, 0, 2)])
    candidates = stream.select(F.lit("t").alias("alert_type"), F.col("user_id").cast("string").alias("entity"), F.unix_seconds("ts").cast("double").alias("at"))
    got = jobs.run_to_end(jobs.deduplicated_alerts(candidates, AlertParams(dedup_window_seconds=300)))
    assert sorted((r.entity, r.at - 1704067200, r.outcome) for r in got.collect()) == [("1", 0, "sent"), ("1", 60, "deduplicated"), ("1", 360, "sent"), ("2", 0, "sent")]
    sent = []
    jobs.sink(Dispatcher(lambda x: sent.append(x) or True, AlertParams(dedup_window_seconds=0)))(got, 0)
    assert len(sent) == 3


def test_state_ends_behind_the_watermark(spark, tmp_path):
    """Two entities are stored; when the watermark has passed their dedup windows, only that of the last event is left."""
    from pyspark.sql import functions as F

    stream = files(spark, tmp_path, [(1, 0, 1), (2, 1, 1), (3, 2, 2)], [(4, 3, 2), (5, 500, 3)], [(6, 501, 3)])
    candidates = stream.select(F.lit("t").alias("alert_type"), F.col("user_id").cast("string").alias("entity"), F.unix_seconds("ts").cast("double").alias("at"))
    got, query = jobs.run(jobs.deduplicated_alerts(candidates, AlertParams(dedup_window_seconds=600), late="10 minutes"))
    assert sorted((r.entity, r.outcome) for r in got.collect()) == [("1", "deduplicated"), ("1", "sent"), ("2", "deduplicated"), ("2", "sent"), ("3", "deduplicated"), ("3", "sent")]
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(sizes) > sizes[-1] and all(r is not None for r in sizes)


def test_updated_windows_keep_their_last_row(spark, tmp_path):
    from pyspark.sql import functions as F

    stream = files(spark, tmp_path, [(1, 0, 1), (2, 1, 2)], [(3, 2, 1)], [(4, 3000, 1)])
    counts = stream.withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")
    got, query = jobs.run(counts, mode="update", keys=("user_id", "start"))
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1] == 1


def test_entities_share_the_keys_of_the_store(spark, tmp_path):
    """300 entities, one of them null, in 8 keys; over batches, with windows that end between and in them, as in one ordered pass."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    batches = [[(1000 * b + i, 300 * b + rng.randrange(300), rng.choice([None, *range(299)])) for i in range(900)] for b in range(3)]
    stream = files(spark, tmp_path, *batches)
    candidates = stream.select(F.lit("t").alias("alert_type"), F.col("user_id").cast("string").alias("entity"), F.unix_seconds("ts").cast("double").alias("at"))
    got, query = jobs.run(jobs.deduplicated_alerts(candidates, AlertParams(dedup_window_seconds=7200), buckets=8))
    want, last = [], {}
    for _, m, u in sorted((x for b in batches for x in b), key=lambda x: x[1]):
        fresh = m - last.get(u, -1000) >= 120
        last[u] = m if fresh else last[u]
        want.append(("" if u is None else str(u), m * 60, "sent" if fresh else "deduplicated"))
    assert sorted((r.entity or "", int(r.at) - 1704067200, r.outcome) for r in got.collect()) == sorted(want)
    stored = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 0 < max(stored) <= 3 * 8  # a value and its timer, which is stored twice
