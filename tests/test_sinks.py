import json

from pyspark.sql import functions as F
from test_streaming import files

from riskloom.config import AlertParams
from riskloom.sources.sinks import EpochSink
from riskloom.streaming import jobs


def appender(folder):
    """Writes each payload to a file of its own, and refuses those of entity 3."""

    def make():
        import uuid

        def send(payload):
            (folder / f"{uuid.uuid4().hex}.json").write_text(json.dumps(payload))
            return payload["details"] != {"entity": "3"}

        return send

    return make


def sent(folder):
    return sorted((x["alert_type"], x["timestamp"], x["alert_id"]) for x in (json.loads(f.read_text()) for f in folder.glob("*.json")))


def test_a_replayed_epoch_sends_and_logs_nothing_twice(spark, tmp_path):
    box = tmp_path / "sent"
    box.mkdir()
    sink = EpochSink(f"{tmp_path}/log", appender(box))
    batch = spark.createDataFrame([("t", str(i), float(i), '{"user_id": 1}' if i == 1 else None) for i in range(5)], "alert_type string, entity string, at double, details string")
    sink(batch, 0)
    sink(batch, 0)
    assert len(sent(box)) == 5 and len({x[2] for x in sent(box)}) == 5
    sink(batch.withColumn("at", F.col("at") + 100).drop("details"), 1)
    log = sink.incidents(spark).collect()
    assert len(log) == len(sent(box)) == 10 and {r.epoch for r in log} == {0, 1} and [r.entity for r in log if not r.delivered] == ["3", "3"]
    assert {r.alert_id for r in log} == {x[2] for x in sent(box)}


def test_an_epoch_that_was_not_committed_is_sent_again_under_the_same_ids(spark, tmp_path):
    box = tmp_path / "sent"
    box.mkdir()
    sink = EpochSink(f"{tmp_path}/log", appender(box))
    batch = spark.createDataFrame([("t", "1", 1.0), ("t", "2", 2.0)], "alert_type string, entity string, at double")
    sink(batch, 7)
    (tmp_path / "log" / "epoch=7" / "_SUCCESS").unlink()
    sink(batch, 7)
    assert len(sent(box)) == 4 and len(set(sent(box))) == 2 and sink.incidents(spark).count() == 2


def test_as_the_sink_of_a_stream(spark, tmp_path):
    box = tmp_path / "sent"
    box.mkdir()
    stream = files(spark, tmp_path / "in", [(1, 0, 1), (2, 1, 1)], [(3, 20, 1), (4, 21, 2)])
    candidates = stream.select(F.lit("t").alias("alert_type"), F.col("user_id").cast("string").alias("entity"), F.unix_seconds("ts").cast("double").alias("at"))
    sink = EpochSink(f"{tmp_path}/log", appender(box))
    fresh = jobs.deduplicated_alerts(candidates, AlertParams(dedup_window_seconds=600)).where("outcome = 'sent'").drop("outcome")
    from riskloom.streaming.jobs import STATE

    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        fresh.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k in STATE:
            spark.conf.unset(k)
    assert sorted((r.entity, r.at - 1704067200) for r in sink.incidents(spark).collect()) == [("1", 0), ("1", 1200), ("2", 1260)] and len(sent(box)) == 3
