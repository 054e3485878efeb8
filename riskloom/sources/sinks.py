"""Outputs: merged events, threshold rows, alerts to a webhook, incident lines."""

from __future__ import annotations

import datetime as dt
import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from logging.handlers import RotatingFileHandler

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS


def merge_scores(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Events with risk_score and is_anomaly of their user; 0 and false where there is none."""
    added = scores.select("user_id", "risk_score", "is_anomaly")
    return events.join(added, "user_id", "left").withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0))).withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))


def threshold_row(spark: SparkSession, metric: str, value: float, fpr: float, fnr: float, at: dt.datetime, by: str = "threshold_calibrator", threshold_id: int | None = None) -> DataFrame:
    """One typed row, to be appended to the threshold history."""
    raw = spark.createDataFrame([(threshold_id, metric, float(value), float(fpr), float(fnr), at, by)], "threshold_id long, metric_name string, threshold_value double, false_positive_rate double, false_negative_rate double, updated_at timestamp, updated_by string")
    return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["threshold_history"]))


def threshold_insert_sql(metric: str, value: float, fpr: float, fnr: float, by: str = "threshold_calibrator") -> str:
    """The same as SQL text; quotes in names are doubled."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return (
        "INSERT INTO threshold_history (metric_name, threshold_value, false_positive_rate, false_negative_rate, updated_by) "
        f"VALUES ({quoted(metric)}, {value:.6f}, {fpr:.6f}, {fnr:.6f}, {quoted(by)});"
    )


class Webhook:
    """Posts JSON, with retries after base, 2 base, 4 base ... seconds; true once an attempt is answered by 2xx."""

    def __init__(self, url: str, attempts: int = 3, backoff: float = 5.0, timeout: float = 10.0, post: Callable[[str, bytes, float], int] | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.url, self.attempts, self.backoff, self.timeout, self.sleep = url, attempts, backoff, timeout, sleep
        self.post = post or self._post

    @staticmethod
    def _post(url: str, body: bytes, timeout: float) -> int:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as e:
            return e.code

    def __call__(self, payload: dict) -> bool:
        body = json.dumps(payload).encode()
        for attempt in range(self.attempts):
            try:
                if 200 <= self.post(self.url, body, self.timeout) < 300:
                    return True
            except OSError:
                logging.getLogger(__name__).warning("attempt %d failed", attempt + 1, exc_info=True)
            if attempt + 1 < self.attempts:
                self.sleep(self.backoff * 2**attempt)
        return False


class IncidentLog:
    """JSON lines in a rotating file."""

    def __init__(self, path: str, max_bytes: int = 10 << 20, backups: int = 5) -> None:
        self.handler = RotatingFileHandler(path, maxBytes=max_bytes, backupCount=backups, encoding="utf-8")

    def __call__(self, alert_type: str, details: dict, now: float) -> None:
        at = dt.datetime.fromtimestamp(now, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        line = json.dumps({"timestamp": at, "alert_type": alert_type, "details": details})
        self.handler.emit(logging.LogRecord("incident", logging.INFO, "", 0, line, None, None))


LOGGED = "alert_id string, alert_type string, entity string, at double, details string, delivered boolean"


@dataclass(frozen=True)
class EpochSink:
    """For ``foreachBatch``: a batch's alerts are sent by tasks and logged as JSON lines in a shared folder, once an epoch.

    The log of an epoch is committed as a whole by Spark's writer.  An epoch that is replayed after that neither sends nor logs
    anything; one that fell over before is sent again, and so may be a task that is run again, with the same ``alert_id`` in each
    payload, a hash of type, entity and time, by which the receiver can tell.  ``sender`` makes the function that sends, in each
    task; its answer is logged as ``delivered``.  Nothing passes through the driver.
    """

    folder: str
    sender: Callable[[], Callable[[dict], bool]]

    def path(self, epoch: int) -> str:
        return f"{self.folder}/epoch={epoch}"

    def committed(self, spark: SparkSession, epoch: int) -> bool:
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(epoch)}/_SUCCESS")
        return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        """``batch``: alert_type, entity, at (seconds) and, if there is one, details (JSON)."""
        if self.committed(batch.sparkSession, epoch):
            return
        make = self.sender
        details = F.col("details") if "details" in batch.columns else F.lit(None).cast("string")
        rows = batch.select(F.sha2(F.to_json(F.struct("alert_type", "entity", "at")), 256).alias("alert_id"), "alert_type", "entity", F.col("at").cast("double").alias("at"), details.alias("details"))

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            deliver = make()
            for pdf in batches:
                payloads = [{"alert_id": i, "alert_type": t, "timestamp": a, "details": json.loads(d) if d else {"entity": e}} for i, t, e, a, d in pdf.itertuples(index=False)]
                yield pdf.assign(delivered=[bool(deliver(x)) for x in payloads])

        rows.mapInPandas(send, LOGGED).write.mode("overwrite").json(self.path(epoch))

    def incidents(self, spark: SparkSession) -> DataFrame:
        """The log: ``LOGGED`` and epoch."""
        return spark.read.schema(f"{LOGGED}, epoch long").json(self.folder)
