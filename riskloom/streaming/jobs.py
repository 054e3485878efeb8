"""Streams of events: windowed counts with late data, sliding bursts, deduplication, and the alert fold as keyed state."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..config import AlertParams
from ..operators.alerts import Dispatcher
from ..operators.durable import shared_dir

RAW = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = RAW, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files; ``ts`` gets a zone, which watermarks need."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def without_duplicates(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """user_id, window_start, window_end, action_count; a window appears once the watermark has passed it."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width, slide))
    return grouped.agg(F.count("*").alias("action_count")).select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "action_count")


def bursts(events: DataFrame, minutes: int = 5, at_least: int = 2, late: str = "10 minutes") -> DataFrame:
    """Sliding windows with many events: an approximation of the exact trailing window, to one minute."""
    return window_counts(events, f"{minutes} minutes", "1 minute", late).where(F.col("action_count") >= at_least)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("n_events")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


#: State in RocksDB, on the executors' disks and in the checkpoint, which ``transformWithState`` needs.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LastSent(StatefulProcessor):
    """The state of a bucket of entities: the time of the last alert sent of each, until the watermark has passed its dedup window.

    A call into the store is a message between the worker and the JVM, and a key has several of them, so entities share a key:
    what a batch costs besides its rows is a few messages for each bucket that it meets.
    """

    def __init__(self, window: float) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "types array<string>, entities array<string>, at array<double>, timer long")

    def _read(self) -> tuple[dict[tuple[str | None, str | None], float], int | None]:
        found = self.state.get()
        if found is None:
            return {}, None
        return dict(zip(zip(found[0], found[1], strict=True), found[2], strict=True)), found[3]

    def _ends(self, at: float) -> int:
        return math.ceil((at + self.window) * 1000)

    def _write(self, last: dict[tuple[str | None, str | None], float], timer: int | None, now: int) -> None:
        """Leaves out what the watermark ``now`` has passed; a bucket has one timer, at the end of an entity's window or before it."""
        last = {k: at for k, at in last.items() if self._ends(at) > now}
        first = self._ends(min(last.values())) if last else None
        if timer is not None and (first is None or first < timer):
            self.handle.deleteTimer(timer)
            timer = None
        if first is None:
            self.state.clear()
            return
        if timer is None:
            self.handle.registerTimer(first)
            timer = first
        self.state.update(([k[0] for k in last], [k[1] for k in last], list(last.values()), timer))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, timer = self._read()
        batch = pd.concat(list(rows))[["alert_type", "entity", "at"]].sort_values("at")
        named = batch[["alert_type", "entity"]].astype(object)
        named = named.where(named.notna(), None)
        outcome, sent = [], False
        for kind, entity, at in zip(named["alert_type"], named["entity"], batch["at"].tolist(), strict=True):
            fresh = at - last.get((kind, entity), float("-inf")) >= self.window
            outcome.append("sent" if fresh else "deduplicated")
            if fresh:
                last[kind, entity] = at
                sent = True
        if sent:
            self._write(last, timer, timerValues.getCurrentWatermarkInMs())
        yield batch.assign(outcome=outcome)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """No row that is still to come is within the window of what is left out, as rows behind the watermark are."""
        self._write(self._read()[0], None, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def deduplicated_alerts(candidates: DataFrame, p: AlertParams = AlertParams(), late: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """Alerts (alert_type, entity, at in seconds) with outcome, by a state for each entity: the time of the last alert sent.

    Dedup is per entity and runs in parallel; the global rate limit belongs to the sink (see ``sink``).  Entities are dealt by
    a hash to ``buckets``, each a key of the store, whose number has to stay for as long as a checkpoint is used.  A state ends
    when the watermark passes its dedup window, by the bucket's timer, so the store holds the entities of the last window only.
    Candidates later than ``late`` are left out.
    """
    out = "alert_type string, entity string, at double, outcome string"
    bucket = F.pmod(F.xxhash64("alert_type", "entity"), F.lit(buckets)).alias("_bucket")
    timed = candidates.select(bucket, "alert_type", "entity", "at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("_time")).withWatermark("_time", late)
    return timed.groupBy("_bucket").transformWithStateInPandas(LastSent(p.dedup_window_seconds), out, "append", "eventTime")


def sink(dispatcher: Dispatcher):
    """For ``foreachBatch``: sends the alerts of a batch in order, with the global rate limit.  Batches are small: only fresh alerts pass."""

    def send(batch: DataFrame, epoch: int) -> None:
        for row in batch.where("outcome = 'sent'").orderBy("at", "alert_type", "entity").toLocalIterator():
            dispatcher(row["alert_type"], {"entity": row["entity"]}, row["at"], row["entity"])

    return send


def run(stream: DataFrame, name: str | None = None, mode: str = "append", keys: tuple[str, ...] = ()) -> tuple[DataFrame, StreamingQuery]:
    """Runs a stream over what is there; its output, written to the shared folder, one part a batch, and the query that ended.

    In update mode the last row of each of ``keys`` counts, whichever batch it came in; in complete mode the last batch.
    """
    spark, name = stream.sparkSession, name or f"out_{uuid.uuid4().hex}"
    folder, schema, done = f"{shared_dir(spark)}/{name}", stream.schema, []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/parts/{epoch}")
        done.append(epoch)

    kept = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    parts = done[-1:] if mode == "complete" else sorted(set(done))
    if not parts:
        return spark.createDataFrame([], schema), query
    if mode != "update":
        return spark.read.schema(schema).parquet(*(f"{folder}/parts/{e}" for e in parts)), query
    every = [spark.read.schema(schema).parquet(f"{folder}/parts/{e}").withColumn("_epoch", F.lit(e)) for e in parts]
    rows = functools.reduce(DataFrame.unionByName, every)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_last")).select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns)), query


def run_to_end(stream: DataFrame, name: str | None = None, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """The output of a stream over what is there (see ``run``)."""
    return run(stream, name, mode, keys)[0]


def stream_windows_query(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts a user from the event file read as a stream; in update mode, so open windows are there, and closed ones leave the store."""
    events = _one_file(spark, folder).withWatermark("ts", "1 day")
    counts = events.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("action_count"))
    out = counts.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "action_count")
    return run_to_end(out, mode="update", keys=("user_id", "window_start"))


def stream_alerts_query(spark: SparkSession, folder: str) -> DataFrame:
    """Dedup of one alert for every event, by user and kind, over the event file read as a stream."""
    events = _one_file(spark, folder)
    candidates = events.select(F.col("event_type").alias("alert_type"), F.col("user_id").cast("string").alias("entity"), (F.unix_micros("ts") / 1e6).alias("at"))
    return run_to_end(deduplicated_alerts(candidates, AlertParams(dedup_window_seconds=86_400.0)))


def _one_file(spark: SparkSession, folder: str) -> DataFrame:
    out = spark.readStream.schema(RAW).option("pathGlobFilter", "events.parquet").parquet(folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))
